"""Stage paths, missing texts and split sorts."""

import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from memscan.constants import method_names
from memscan.operators import scores as sc
from memscan.operators.tokens import doc_tokens
from memscan.plans import catalog as cat
from memscan.session import checkpoint_root

from .conftest import SF001


def _folder(spark, name, texts):
    path = f"{tempfile.mkdtemp(prefix='memscan-sf-')}/{name}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_two_folders_of_one_name(spark):
    a = _folder(spark, "x", ["one two three", "four five"])
    b = _folder(spark, "x", ["six", "seven eight nine ten"])
    da, db = cat.docs(spark, a), cat.docs(spark, b)
    assert sorted(r["T"] for r in da.collect()) == [2, 3]
    assert sorted(r["T"] for r in db.collect()) == [1, 4]


def test_changed_table_is_read_again(spark):
    a = _folder(spark, "x", ["one two three"])
    assert [r["T"] for r in cat.docs(spark, a).collect()] == [3]
    shutil.rmtree(f"{a}/documents.parquet")
    spark.createDataFrame([(0, "one two")], "doc_id long, text string").write.parquet(f"{a}/documents.parquet")
    os.utime(f"{a}/documents.parquet", (1, 1))
    assert [r["T"] for r in cat.docs(spark, a).collect()] == [2]


def test_missing_text_gives_every_name(spark):
    m = cat.model(spark, SF001)
    sn = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "the of and in", 1)], "doc_id long, text string, label int")
    from memscan.streaming.stream_score import score_batch
    got = {}
    for r in score_batch(sn, m).collect():
        got.setdefault(r["doc_id"], {})[r["method"]] = r["score"]
    assert set(got[1]) == set(method_names()) and set(got[1].values()) == {0.0}
    assert len(got[2]) == 22 and set(got[3]) == set(method_names())


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_hot_value_in_split_sort(spark, split):
    """Most values of a group are equal: they collapse to one row of a range."""
    rows = [("g", float(v), 1.0) for v in [0.0] * 40 + [-1.0, 2.0, 3.0, float("inf"), float("nan"), -5.0]]
    rows += [("h", float(v), 2.0) for v in range(5)]
    df = spark.createDataFrame(rows, "g string, v double, raw double")
    df = df.join(df.groupBy("g").agg(F.count("*").cast("int").alias("n")), "g")
    want = {(r["g"], r["r_ix"]): (r["kmean"], r["tot"]) for r in sc.smallest_k_mean(df, ["g"], split_rows=10**9, array_rows=0).collect()}
    got = {(r["g"], r["r_ix"]): (r["kmean"], r["tot"]) for r in sc.smallest_k_mean(df, ["g"], split_rows=split).collect()}
    assert got.keys() == want.keys()
    for k, (a, t) in want.items():
        assert (a != a and got[k][0] != got[k][0]) or got[k][0] == pytest.approx(a), k
        assert got[k][1] == pytest.approx(t)


def test_scores_do_not_probe_the_positions(spark):
    """The largest group comes from the document table: one column of it."""
    d = spark.createDataFrame([(1, "a b c", 1), (2, None, 0)], "doc_id long, text string, label int")
    assert sc.largest_group(doc_tokens(d, with_clen=False)) == 2
    assert sc.largest_group(doc_tokens(d.filter("doc_id = 2"), with_clen=False)) == 0


def test_shared_folder_is_needed_off_local_mode():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())
