"""Lookups by chunks: the statistics of the broadcast plan, without a broadcast,
and without tables that the driver could not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memscan.operators import backoff, lookup, ngram
from memscan.operators import token_stats as ts_op
from memscan.operators.scores import position_values
from memscan.operators.tokens import doc_tokens
from memscan.session import SETTINGS

TEXTS = ["the cat saw the dog and the cat ran", "the dog saw the cat", "a cat", "alone", "", None,
         "the the the the", "zebra quagga the cat saw okapi", "the cat saw the dog and the cat ran"]


@pytest.fixture
def docs(spark):
    rows = [(i % 7, t, i % 2) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 0), (None, TEXTS[7], 1)]
    return doc_tokens(spark.createDataFrame(rows, "doc_id long, text string, label int")).persist()


def key(df):
    return sorted((tuple((v is None, v) for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, lookup.SEGMENT])
def test_chunks_equal_broadcast(spark, docs, size):
    model = ngram.fit_bigram(spark, docs.filter("label = 0"))
    assert model.broadcastable()
    want = ts_op.token_stats(docs, model, ["label", "clen"])
    got = lookup.token_stats_by_chunks(docs, model, ["label", "clen"], 40, 3, size=size)
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert key(got) == key(want)
    short = lookup.token_stats_by_chunks(docs, model, ["label", "clen"], 40, 3, words=False, size=size)
    assert key(short) == key(want.drop("ctx", "tok", "next_tok", "xhat"))


def test_mixed_plan_of_documents_that_come_twice(spark, docs):
    """Documents that share an id and a length: each takes its own next position."""
    twice = docs.unionByName(docs)
    model = ngram.fit_bigram(spark, docs.filter("label = 0"))
    of = lambda: position_values(ts_op.token_stats(twice, model, ["label", "clen"], words=False))
    want = of()
    model.n_bigrams = 10 ** 9
    got = of()
    assert model.fits("contexts") and model.fits("unigram") and not model.fits("bigram")
    cols = ["doc_id", "T", "pos", "lp", "z", "r0", "r1"]
    assert got.count() and key(got.select(cols)) == key(want.select(cols))


def test_default_bounds_spare_the_driver(spark, docs):
    model = ngram.fit_bigram(spark, docs.filter("label = 0"))
    model.n_bigrams = model.n_contexts = model.s.V = 150_000         # vocabulary of 0.1 GB of documents: more
    assert not any(model.fits(t) for t in ("unigram", "contexts", "bigram"))
    assert SETTINGS["spark.sql.autoBroadcastJoinThreshold"] == SETTINGS["spark.sql.adaptive.autoBroadcastJoinThreshold"] == "10m"
    plan = ts_op.token_stats(docs, model, ["label", "clen"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "strategy=broadcast" not in plan


def joins(df):
    """Names of the joins as Spark means to run them, with thresholds that let it broadcast all."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [j for j in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin", "ShuffledHashJoin") if j in plan]


def test_no_table_that_grows_goes_through_the_driver(spark, docs, tmp_path):
    """Small files of a model, that the size of the files would broadcast."""
    class Store:
        def put(self, name, df):
            seen.append(joins(df))
            df.write.parquet(f"{tmp_path}/{name}")
            return spark.read.parquet(f"{tmp_path}/{name}")
    seen = []
    model = backoff.fit_backoff(spark, docs.filter("label = 0"), 3, Store())
    seen += [joins(lookup.answers(lookup.segments(docs, [], 2), model.bigram)), joins(backoff.log_probs(docs, model))]
    assert {j for s in seen for j in s} == {"SortMergeJoin"}


def test_queries_join_documents_by_shuffle(spark, docs, tmp_path, monkeypatch):
    scores = docs.select("doc_id", "label", F.lit("zlib").alias("method"), F.lit(0.5).alias("score"))
    docs.select("doc_id", F.lit("a b").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(entry.cat, "scores", lambda *a: scores)
    monkeypatch.setattr(entry.cat, "docs", lambda *a: docs)
    assert joins(entry.queries()["all_scores"](spark, str(tmp_path))) == ["ShuffledHashJoin"]
    assert joins(entry.queries()["zlib_score"](spark, str(tmp_path))) == ["SortMergeJoin"]
