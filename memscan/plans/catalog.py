"""Named stage tables of one data folder, built once per Spark application.

Every registered query reads the driver's tables (or what Spark derives from
them); the expensive shared stages -- document tokens, the model, the scores
-- are materialised once per (application, folder, option) in the shared
checkpoint folder and then reused by the queries that need them.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SCORE_DECIMALS
from ..operators import ngram
from ..operators import scores as sc
from ..operators import token_stats as ts_op
from ..operators import tokens as tk
from ..operators.numbered import raw_scores_by_rounds
from ..session import StageStore, by_shuffle, tune
from ..sources import benchmark_snippets, documents_snippets, table
from ..sources.count_ledger import CountLedger

_cache: dict[tuple, object] = {}


def _key(spark: SparkSession, *parts) -> tuple:
    parts = tuple(p.rstrip("/") if isinstance(p, str) else p for p in parts)
    return (spark.sparkContext.applicationId, *parts)


def store(spark: SparkSession) -> StageStore:
    k = _key(spark, "store")
    if k not in _cache:
        tune(spark)
        _cache[k] = StageStore(spark)
    return _cache[k]


def _memo(spark, key, build):
    k = _key(spark, *key, _version(spark, key[1]))
    if k not in _cache:
        _cache[k] = build()
    return _cache[k]


def _version(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the folder's path and of its entries' names, sizes and times,
    so that equal folder names or changed tables never share a stage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path))
    return hashlib.md5(repr((sf_dir.rstrip("/"), seen)).encode()).hexdigest()[:16]


def tag(spark: SparkSession, sf_dir: str) -> str:
    """Folder name of the stages of one data folder."""
    return sf_dir.rstrip("/").split("/")[-1].replace(".", "_") + "_" + _version(spark, sf_dir)


def for_roc(scores: DataFrame) -> DataFrame:
    """Scores as the registered queries evaluate them (zlib, which no query
    compares between engines, is left exact)."""
    return scores.withColumn("score", F.when(F.col("method") == "zlib", F.col("score"))
                             .otherwise(F.round("score", SCORE_DECIMALS)))


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _spread(spark: SparkSession, snippets: DataFrame) -> DataFrame:
    """Hash-partition the raw texts by doc_id when the source has fewer
    splits than the cluster has task slots (e.g. one unsplittable row group),
    so tokenising and compressing run in parallel.  A source that is already
    split finely is left alone: no shuffle of the raw text at scale."""
    n = parallelism(spark)
    if snippets.rdd.getNumPartitions() >= n:
        return snippets
    return snippets.repartition(n, "doc_id")


def load_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus the model is estimated from: member documents' tokens."""
    return docs(spark, sf_dir).filter(F.col("label") == 1)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_tokens of the documents table (label = member split), written
    partitioned by label so the training scan prunes to the member half."""
    return _memo(spark, ("docs", sf_dir), lambda: store(spark).put(
        f"{tag(spark, sf_dir)}/docs", tk.doc_tokens(_spread(spark, documents_snippets(spark, sf_dir))),
        partition_by=["label"]).select("doc_id", "label", "toks", "clen", "T"))


def model(spark: SparkSession, sf_dir: str) -> ngram.BigramModel:
    def build():
        st = store(spark)
        prefix = tag(spark, sf_dir)
        return ngram.fit_bigram(spark, load_corpus(spark, sf_dir), st.within(f"{prefix}/model"))
    return _memo(spark, ("model", sf_dir), build)


def count_ledger(spark: SparkSession, sf_dir: str) -> CountLedger:
    """Versioned counts: 1 documents outside the corpus, 2 all documents,
    3 the corpus alone (the others taken out again), 4 a snapshot of it."""
    def build():
        ledger = CountLedger(spark, store(spark).path(f"{tag(spark, sf_dir)}/ledger"))
        others = docs(spark, sf_dir).filter(F.col("label") == 0)
        ledger.add(others)
        ledger.add(load_corpus(spark, sf_dir))
        ledger.remove(others)
        ledger.compact()
        return ledger
    return _memo(spark, ("ledger", sf_dir), build)


def merged_model(spark: SparkSession, sf_dir: str) -> ngram.BigramModel:
    """The model from merged counts; no document is counted for it."""
    def build():
        st, prefix = store(spark), tag(spark, sf_dir)
        return ngram.fit_from_counts(spark, count_ledger(spark, sf_dir).counts(), st.within(f"{prefix}/merged"))
    return _memo(spark, ("merged", sf_dir), build)


def backoff(spark: SparkSession, sf_dir: str, order: int = 3):
    """The back-off model of a higher order over the same corpus."""
    from ..operators.backoff import fit_backoff

    def build():
        st, prefix = store(spark), tag(spark, sf_dir)
        return fit_backoff(spark, load_corpus(spark, sf_dir), order, st.within(f"{prefix}/backoff{order}"), model(spark, sf_dir))
    return _memo(spark, ("backoff", sf_dir, order), build)


def token_stats_plan(spark: SparkSession, sf_dir: str, words: bool = True) -> DataFrame:
    return ts_op.token_stats(docs(spark, sf_dir), model(spark, sf_dir), ["label", "clen"],
                             parallelism(spark), words)


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-position table, written out (for users who read it)."""
    return _memo(spark, ("ts", sf_dir), lambda: store(spark).put(
        f"{tag(spark, sf_dir)}/token_stats", token_stats_plan(spark, sf_dir)))


def _put_scores(spark: SparkSession, sf_dir: str, name: str, d: DataFrame, clip_inf: bool = False, **changes) -> DataFrame:
    """Scores straight from the documents ``d``, under ``name``: the position
    table is not written out in between."""
    st, m, n = store(spark), model(spark, sf_dir), parallelism(spark)
    name, parts = f"{tag(spark, sf_dir)}/{name}", f"{tag(spark, sf_dir)}/{name}_parts"
    n_tokens = ts_op.tokens_by_chunks(d, m)
    if n_tokens is not None:
        out = st.put(name, raw_scores_by_rounds(d, m, ["label"], n_tokens, st.within(parts), n, clip_inf, **changes))
        st.drop(parts)
        return out
    pv = sc.position_values(ts_op.token_stats(d, m, ["label", "clen"], n, words=False), clip_inf)
    return st.put(name, sc.raw_scores(pv, d.select("doc_id", "T", "clen", "label"), ["label"]))


def raw_scores(spark: SparkSession, sf_dir: str, clip_inf: bool = False) -> DataFrame:
    def build():
        return _put_scores(spark, sf_dir, f"raw_scores_clip{int(clip_inf)}", docs(spark, sf_dir), clip_inf)
    return _memo(spark, ("raw", sf_dir, clip_inf), build)


def scores(spark: SparkSession, sf_dir: str, clip_inf: bool = False) -> DataFrame:
    return sc.sanitize_scores(raw_scores(spark, sf_dir, clip_inf))


def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages scored by the model of the member documents."""
    def build():
        bd = tk.doc_tokens(_spread(spark, benchmark_snippets(spark, sf_dir)))
        bd = store(spark).put(f"{tag(spark, sf_dir)}/bench_docs", bd)
        return _put_scores(spark, sf_dir, "bench_raw", bd)
    return sc.sanitize_scores(_memo(spark, ("bench", sf_dir), build))


def masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored with the text taken away where labels has no row."""
    def build():
        lab = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
        sn = (documents_snippets(spark, sf_dir).join(by_shuffle(lab, "shuffle_hash"), "doc_id", "left")
              .withColumn("text", F.when(F.col("has"), F.col("text"))).drop("has"))
        d = store(spark).put(f"{tag(spark, sf_dir)}/masked_docs", tk.doc_tokens(sn))
        return _put_scores(spark, sf_dir, "masked_raw", d)
    return sc.sanitize_scores(_memo(spark, ("masked", sf_dir), build))


def _scaled_rows(ts: DataFrame) -> DataFrame:
    ts = ts.drop("lp_next", "mu_next", "var_next", "doc_key")
    var = (F.when(F.col("pos") % 7 == 0, F.lit(0.0)).when(F.col("pos") % 11 == 0, F.lit(-1e-9))
           .otherwise(F.col("var") * 0.001))
    return ts.withColumns({"lp": F.col("lp") * 15, "lp_xhat": F.col("lp_xhat") * 15, "lp_alt": F.col("lp_alt") * 15,
                           "var": var, "var_alt": F.col("var_alt") * 0.001})


def scaled(pos: np.ndarray, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``_scaled_rows`` of arrays."""
    var = np.where(pos % 7 == 0, 0.0, np.where(pos % 11 == 0, -1e-9, x["var"] * 0.001))
    return x | {k: x[k] * 15 for k in ("lp", "lp_xhat", "lp_alt")} | {"var": var, "var_alt": x["var_alt"] * 0.001}


def scaled_scores(spark: SparkSession, sf_dir: str, clip_inf: bool) -> DataFrame:
    """Scores of statistics blown up so that every clip bound and guard binds:
    log-probs times 15, variances a thousandth, zero or slightly negative."""
    def build():
        d, name = docs(spark, sf_dir), f"scaled_clip{int(clip_inf)}"
        if ts_op.tokens_by_chunks(d, model(spark, sf_dir)) is not None:
            return _put_scores(spark, sf_dir, name, d, clip_inf, changed=scaled, changed_rows=_scaled_rows)
        pv = sc.position_values(_scaled_rows(token_stats(spark, sf_dir)), clip_inf)
        return store(spark).put(f"{tag(spark, sf_dir)}/{name}", sc.raw_scores(pv, d.select("doc_id", "T", "clen", "label"), ["label"]))
    return sc.sanitize_scores(_memo(spark, ("scaled", sf_dir, clip_inf), build))


def row_count(spark: SparkSession, sf_dir: str, clip_inf: bool = False) -> int:
    """Rows of the materialised raw score table (Parquet metadata)."""
    return _memo(spark, ("raw_n", sf_dir, clip_inf), lambda: raw_scores(spark, sf_dir, clip_inf).count())


def metrics(spark: SparkSession, sf_dir: str, clip_inf: bool = False) -> DataFrame:
    """All 122 methods evaluated, written once per application."""
    from ..operators.roc import all_methods, evaluate_methods

    def build():
        m = evaluate_methods(for_roc(scores(spark, sf_dir, clip_inf)), row_bound=row_count(spark, sf_dir, clip_inf))
        return store(spark).put(f"{tag(spark, sf_dir)}/metrics_clip{int(clip_inf)}", all_methods(spark, m))
    return _memo(spark, ("metrics", sf_dir, clip_inf), build)
