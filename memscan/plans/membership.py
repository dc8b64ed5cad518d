"""End-to-end membership scoring: corpus -> model -> scores -> metrics.

One lazy plan per stage; the stage tables that several consumers read are
written once through a StageStore (shared checkpoint folder) when one is
given, so a retry or a second consumer never recomputes the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ngram, scores as sc, token_stats as ts_op, tokens as tk
from ..operators.roc import all_methods, evaluate_methods
from ..session import StageStore


@dataclass
class ScoreRun:
    docs: DataFrame            # doc_id, label, toks, T, clen
    model: ngram.BigramModel
    token_stats: DataFrame
    raw: DataFrame             # doc_id, label, method, score (unsanitised)
    scores: DataFrame          # doc_id, label, method, score (finite)
    extra: list[str] = field(default_factory=list)


def prepare_docs(snippets: DataFrame, store: StageStore | None = None) -> DataFrame:
    dt = tk.doc_tokens(snippets)
    return store.put("docs", dt) if store is not None else dt


def fit_model(spark: SparkSession, train_docs: DataFrame, store: StageStore | None = None) -> ngram.BigramModel:
    return ngram.fit_bigram(spark, train_docs, store)


def score_documents(docs: DataFrame, model: ngram.BigramModel, clip_inf: bool = False,
                    store: StageStore | None = None, stats_name: str = "token_stats",
                    scores_name: str = "raw_scores") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(token_stats, raw scores, sanitised scores) of every document."""
    extra = ["label", "clen"]
    ts = ts_op.token_stats(docs, model, extra)
    if store is not None:
        ts = store.put(stats_name, ts)
    pv = sc.position_values(ts, clip_inf)
    raw = sc.raw_scores(pv, docs.select("doc_id", "T", "clen", "label"), ["label"])
    if store is not None:
        raw = store.put(scores_name, raw)
    return ts, raw, sc.sanitize_scores(raw)


def run(spark: SparkSession, snippets: DataFrame, clip_inf: bool = False,
        store: StageStore | None = None, train_filter=None) -> ScoreRun:
    """Estimate the model on the member snippets, score every snippet."""
    docs = prepare_docs(snippets, store)
    train = docs.filter(train_filter if train_filter is not None else F.col("label") == 1)
    model = fit_model(spark, train, store)
    ts, raw, scores = score_documents(docs, model, clip_inf, store)
    return ScoreRun(docs, model, ts, raw, scores, ["label"])


def metrics(spark: SparkSession, scores: DataFrame, n_ranges: int | None = None) -> DataFrame:
    return all_methods(spark, evaluate_methods(scores, n_ranges))
