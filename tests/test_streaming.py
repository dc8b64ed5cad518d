"""stream_score: documents arriving as files, scored per micro-batch, equal
the batch scores; a restarted query with the same checkpoint adds nothing."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from memscan.plans import catalog as cat
from memscan.streaming import start_stream_score

from .conftest import SF001


def test_stream_matches_batch(spark):
    src = tempfile.mkdtemp(prefix="memscan-stream-src-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(
        "doc_id", "text", F.expr("CAST(pmod(doc_id, 2) = 0 AS INT)").alias("label"))
    for k in range(3):                      # three arriving files
        docs.filter(F.pmod("doc_id", 3) == k).coalesce(1).write.parquet(f"{src}/part{k}")
    files = tempfile.mkdtemp(prefix="memscan-stream-files-")
    for k in range(3):
        spark.read.parquet(f"{src}/part{k}").coalesce(1).write.mode("append").parquet(files)
    sink = tempfile.mkdtemp(prefix="memscan-stream-sink-")
    ckpt = tempfile.mkdtemp(prefix="memscan-stream-ckpt-")
    model = cat.model(spark, SF001)
    q = start_stream_score(spark, files, model, sink, checkpoint=ckpt)
    q.awaitTermination()
    got = spark.read.parquet(sink)
    assert got.select("batch_id").distinct().count() == 3
    want = cat.scores(spark, SF001)
    a = {(r["doc_id"], r["method"]): r["score"] for r in want.collect()}
    b = {(r["doc_id"], r["method"]): r["score"] for r in got.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1e-9 * max(1.0, abs(a[k])) for k in a)
    # restart from the same checkpoint: nothing new to process, output unchanged
    q2 = start_stream_score(spark, files, model, sink, checkpoint=ckpt)
    q2.awaitTermination()
    assert spark.read.parquet(sink).count() == len(b)


def test_restart_without_explicit_checkpoint(spark):
    """The checkpoint lies beside the output: a second run finds it."""
    files = tempfile.mkdtemp(prefix="memscan-stream-files-")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(20).select(
        "doc_id", "text", F.expr("CAST(pmod(doc_id, 2) = 0 AS INT)").alias("label"))
    docs.coalesce(1).write.mode("append").parquet(files)
    sink = tempfile.mkdtemp(prefix="memscan-stream-sink-")
    model = cat.model(spark, SF001)
    start_stream_score(spark, files, model, sink).awaitTermination()
    n = spark.read.parquet(sink).count()
    docs.withColumn("doc_id", F.col("doc_id") + 1000).coalesce(1).write.mode("append").parquet(files)
    start_stream_score(spark, files, model, sink).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.count() == 2 * n and got.select("batch_id").distinct().count() == 2


def test_query_streams_a_table_that_is_a_folder_of_files(spark, tmp_path):
    """A large table is a folder of part files: the stream finds all of them."""
    rows = [(i, t, i) for i, t in enumerate(["the cat saw the dog", "a dog saw the cat and ran", "the cat", "one two three four five"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/many/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/part")
    (tmp_path / "one").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "one" / "documents.parquet")
    key = lambda name: sorted(map(tuple, entry.queries()["stream_score"](spark, f"{tmp_path}/{name}").collect()))
    got = key("many")
    assert {r[0] for r in got} == set(range(12)) and got == key("one")
