import math

import pytest
from pyspark.sql import functions as F

from memscan.functions import numeric as N
from memscan.functions import text as X


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_clean_text(spark):
    got = one(spark, X.clean_text(F.col("t")), [("Ab\n\tc 9é  d(1).,  x-y ",), ("",), ("123 456",)], "t string")
    assert got == ["Abc d()., xy", "", ""]


def test_token_array_empty_and_lower(spark):
    got = one(spark, X.token_array(F.col("t")), [("Hello  World.",), ("",), ("ééé",)], "t string")
    assert got == [["hello", "world", "."], [], ["ééé"]]


def test_token_array_loses_no_character_class(spark):
    from .reference_impl import tokens
    cases = ["alpha\nbeta", "東京は2024年", "a1 b-2, c_d", "naïve café!!", "x\u00a0y\u3000z", "e\u0301t\u00e9", "$%&", "\t"]
    got = one(spark, X.token_array(F.col("t")), [(c,) for c in cases], "t string")
    assert got == [tokens(c) for c in cases]
    assert got[0] == ["alpha", "beta"] and got[1] == ["東京は2024年"]
    assert one(spark, X.token_array(F.col("t")), [(None,)], "t string") == [None]


def test_word_count_matches_python(spark):
    cases = ["a b", "a b", "a　b\x1cc", "\nleading", "", "  x  ", "a b​c"]
    got = one(spark, X.word_count(F.col("t")), [(c,) for c in cases], "t string")
    assert got == [len(c.split()) for c in cases]


def test_format_percent(spark):
    vals = [0.0625, 0.0025, 1.0, 0.93149, 0.0]
    got = one(spark, X.format_percent(F.col("x")), [(v,) for v in vals], "x double")
    assert got == [f"{v:.1%}" for v in vals]


def test_compressed_length(spark):
    import zlib
    texts = ["hello world", "", "ééé" * 50]
    got = one(spark, X.compressed_length(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [len(zlib.compress(t.encode("utf-8"))) for t in texts]


def test_clamps_keep_nan(spark):
    rows = [(float("nan"),), (float("inf"),), (-1e9,), (3.0,)]
    got = one(spark, N.clamp(F.col("x"), -50.0, 50.0), rows, "x double")
    assert math.isnan(got[0]) and got[1:] == [50.0, -50.0, 3.0]
    got = one(spark, N.clamp_min(F.col("x"), -100.0), rows, "x double")
    assert math.isnan(got[0]) and got[1:] == [float("inf"), -100.0, 3.0]


def test_safe_div_and_sqrt(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 0.0), (6.0, 3.0), (1.0, float("nan"))]
    got = one(spark, N.safe_div(F.col("a"), F.col("b")), rows, "a double, b double")
    assert got[0] == float("inf") and got[1] == float("-inf")
    assert math.isnan(got[2]) and math.isnan(got[3]) and got[4] == 2.0 and math.isnan(got[5])
    got = one(spark, N.safe_sqrt(F.col("x")), [(-1e-9,), (4.0,), (float("nan"),)], "x double")
    assert math.isnan(got[0]) and got[1] == 2.0 and math.isnan(got[2])


def test_nan_to_num(spark):
    got = one(spark, N.nan_to_num(F.col("x")), [(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)],
              "x double")
    assert got == [0.0, 1.7976931348623157e308, -1.7976931348623157e308, 2.0]


@pytest.mark.parametrize("n", [90, 170, 180, 330, 7, 0, 1, 2000])
def test_k_is_binary_floating_point(spark, n):
    from memscan.constants import RATIOS
    rows = [(n, r) for r in RATIOS]
    got = one(spark, N.k_of(F.col("n"), F.col("r")), rows, "n int, r double")
    assert got == [int(n * r) for r in RATIOS]
