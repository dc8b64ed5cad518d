import os
import tempfile

import pytest
from pyspark.sql import functions as F

from memscan.operators import profile as prof
from memscan.sources import load_snippets, results_name, write_results

from .conftest import SF001


def test_load_snippets_routes_by_name(spark):
    base = tempfile.mkdtemp(prefix="memscan-src-")
    for src, v in [("plain", "WikiMIA_length32"), ("para", "WikiMIA_length32_paraphrased")]:
        spark.createDataFrame([(1, f"text of {src}", 1)], "doc_id long, input string, label int") \
            .write.parquet(f"{base}/{src}/{v}")
    a = load_snippets(spark, "WikiMIA_length32", f"{base}/plain", f"{base}/para").first()
    b = load_snippets(spark, "WikiMIA_length32_paraphrased", f"{base}/plain", f"{base}/para").first()
    assert a["text"] == "text of plain" and b["text"] == "text of para"
    with pytest.raises(ValueError):
        load_snippets(spark, "nope", base, base)


def test_load_snippets_without_id_and_with_schema(spark):
    base = tempfile.mkdtemp(prefix="memscan-src-")
    spark.createDataFrame([("a", 1), ("b", 0)], "input string, label int").write.json(f"{base}/p/WikiMIA_length64")
    got = load_snippets(spark, "WikiMIA_length64", f"{base}/p", base, fmt="json", schema="input string, label int").collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("a", 1), ("b", 0)]
    assert len({r["doc_id"] for r in got}) == 2


def test_results_name_rules():
    assert results_name("org/model-7b", "WikiMIA_length64", half=True, clip_inf=True) == \
        "model-7b_WikiMIA_length64_optimized_half_clipped_results"
    assert results_name("m", "d", half=True, int8=True) == "m_d_optimized_half_results"
    assert results_name("m", "d", optimized=False, mixed_precision=True) == "m_d_original_mixed_results"


def test_write_results(spark):
    from memscan.operators import report as rep
    m = spark.createDataFrame([("loss", 0, 0.93149, 0.1, 0.0625)],
                              "method string, method_order int, auroc double, fpr95 double, tpr05 double")
    out = tempfile.mkdtemp(prefix="memscan-out-")
    path = write_results(rep.result_table(m), out, "a/b", "WikiMIA_length64")
    row = spark.read.option("header", True).csv(path).first()
    assert (row["method"], row["auroc"], row["tpr05"]) == ("loss", "93.1%", "6.2%")
    assert os.path.isdir(path.replace(".csv", ".parquet"))
    assert os.path.basename(path) == "b_WikiMIA_length64_optimized_results.csv" and os.path.isfile(path)
    assert open(path).read() == "method,auroc,fpr95,tpr05\nloss,93.1%,10.0%,6.2%\n"


def test_one_named_file(spark):
    """A second run replaces the file; a failed one leaves it, and no scraps."""
    from memscan.sources.sinks import write_one_file
    out = tempfile.mkdtemp(prefix="memscan-one-")
    path = f"{out}/new/table.csv"
    rows = spark.range(50).repartition(4).orderBy("id")
    write_one_file(rows, path, header="true")
    assert open(path).read().split() == ["id", *map(str, range(50))]
    write_one_file(rows.limit(3), path, header="true")
    assert open(path).read().split() == ["id", "0", "1", "2"]
    with pytest.raises(Exception):
        write_one_file(rows.withColumn("bad", F.raise_error(F.lit("no"))), path, header="true")
    assert open(path).read().split() == ["id", "0", "1", "2"]
    assert sorted(x for x in os.listdir(f"{out}/new") if not x.endswith(".crc")) == ["table.csv"]


def test_dataset_statistics(spark):
    from memscan.sources import documents_snippets
    r = prof.dataset_statistics(documents_snippets(spark, SF001)).first()
    assert r["total"] == 200 and r["members"] == 100 and r["member_share"] == 0.5
    empty = documents_snippets(spark, SF001).filter(F.lit(False))
    assert prof.dataset_statistics(empty).count() == 0
