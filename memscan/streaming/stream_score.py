"""Structured Streaming: score snippets as they arrive.

The per-snippet loop becomes a streaming query over a file source of
snippets.  Each micro-batch is scored against static model tables inside
``foreachBatch`` and written under its batch id with overwrite, so a batch
replayed after a failure replaces its own output (idempotent sink).  All
score state is per snippet, so no watermark or streaming state is needed;
ROC evaluation stays a batch job over the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngram
from ..operators import scores as sc
from ..operators import token_stats as ts_op
from ..operators import tokens as tk

STREAM_SCHEMA = "doc_id long, text string, label int"


def score_batch(batch: DataFrame, model: ngram.BigramModel, clip_inf: bool = False,
                partitions: int | None = None, keep=None) -> DataFrame:
    """Sanitised scores of one micro-batch (doc_id, label, method, score).
    ``keep`` may hold on to the tokens, which several branches read."""
    d = tk.doc_tokens(batch.select("doc_id", "text", "label"))
    if keep is not None:
        d = keep(d)
    ts = ts_op.token_stats(d, model, ["label", "clen"], partitions, words=False)
    pv = sc.position_values(ts, clip_inf)
    raw = sc.raw_scores(pv, d.select("doc_id", "T", "clen", "label"), ["label"])
    return sc.sanitize_scores(raw)


def start_stream_score(spark: SparkSession, source: str, model: ngram.BigramModel, sink: str,
                       checkpoint: str | None = None, clip_inf: bool = False,
                       max_files_per_trigger: int = 1, available_now: bool = True,
                       source_format: str = "parquet", select_expr: list[str] | None = None,
                       file_glob: str | None = None):
    """Start the streaming query over the folder ``source`` (files matching
    ``file_glob`` if given); returns the StreamingQuery."""
    # beside the output, so that a restarted job finds it (readers skip "_" folders)
    checkpoint = checkpoint or f"{sink.rstrip('/')}/_checkpoint"
    rd = spark.read.format(source_format)
    rs = spark.readStream.format(source_format)
    if file_glob:
        rd, rs = rd.option("pathGlobFilter", file_glob), rs.option("pathGlobFilter", file_glob)
    stream = (rs.schema(rd.load(source).schema)
              .option("maxFilesPerTrigger", max_files_per_trigger).load(source))
    if select_expr:
        stream = stream.selectExpr(*select_expr)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batch: DataFrame, batch_id: int) -> None:
        held: list[DataFrame] = []

        def keep(d: DataFrame) -> DataFrame:
            held.append(d.persist())
            return held[-1]

        out = score_batch(batch, model, clip_inf, parts, keep).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        for d in held:
            d.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
