"""Scores of large inputs by packed lookups: those of the broadcast plan, with
no row for a position, and stages that are deleted when nothing reads them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from memscan.operators import ngram
from memscan.operators import numbered as nb
from memscan.operators import scores as sc
from memscan.operators import token_stats as ts_op
from memscan.operators.tokens import doc_tokens
from memscan.plans import catalog as cat
from memscan.session import StageStore

TEXTS = ["the cat saw the dog and the cat ran", "the dog saw the cat", "a cat", "alone", "", None,
         "the the the the", "zebra quagga the cat saw okapi", "the cat saw the dog and the cat ran",
         "cat cat dog saw ran and the dog and a cat ran and saw the dog " * 4, "zebra okapi gnu yak ox"]
ROWS = [(i % 9, t, i % 2) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], 0), (None, TEXTS[7], 1), (50, TEXTS[9], 0)]


@pytest.fixture
def small(monkeypatch):
    """Several rounds, chunks, rows and buckets, and documents too long for a chunk."""
    for name, n in (("CHUNK", 20), ("ROW", 7), ("BUCKET", 4), ("ROUND_TOKENS", 100), ("TABLE", 100)):
        monkeypatch.setattr(nb, name, n)


def key(df):
    return sorted(((str(r[0]), r["label"], r["method"], repr(round(r["score"], 9))) for r in df.collect()))


@pytest.mark.parametrize(("clip", "twice", "longest"), [(False, False, 10), (True, True, nb.LONGEST)])
def test_equal_to_the_broadcast_plan(spark, small, monkeypatch, clip, twice, longest):
    monkeypatch.setattr(nb, "LONGEST", longest)
    docs = doc_tokens(spark.createDataFrame(ROWS * (1 + twice), "doc_id long, text string, label int")).persist()
    model = ngram.fit_bigram(spark, docs.filter("label = 0"))
    pv = sc.position_values(ts_op.token_stats(docs, model, ["label", "clen"]), clip)
    want = sc.raw_scores(pv, docs.select("doc_id", "T", "clen", "label"), ["label"])
    store = StageStore(spark)
    got = nb.raw_scores_by_rounds(docs, model, ["label"], 240, store, 3, clip)
    assert got.columns == want.columns and key(got) == key(want)
    assert os.listdir(store.base.removeprefix("file:")) == ["means"]        # what the result reads


@pytest.mark.parametrize("clip", [False, True])
def test_scaled_statistics_equal_those_of_rows(spark, small, clip):
    """Zero and negative variances, bounds that bind: the query's own change of the statistics."""
    docs = doc_tokens(spark.createDataFrame([(100 + i, *r[1:]) for i, r in enumerate(ROWS)], "doc_id long, text string, label int")).persist()
    model = ngram.fit_bigram(spark, docs.filter("label = 0"))
    pv = sc.position_values(cat._scaled_rows(ts_op.token_stats(docs, model, ["label", "clen"])), clip)
    want = sc.raw_scores(pv, docs.select("doc_id", "T", "clen", "label"), ["label"])
    got = nb.raw_scores_by_rounds(docs, model, ["label"], 120, StageStore(spark), 3, clip, cat.scaled, cat._scaled_rows)
    close = lambda df: {(r["doc_id"], r["method"]): r["score"] for r in df.collect()}
    a, b = close(want), close(got)
    assert a.keys() == b.keys() and len(a) > 1000
    assert all(x == pytest.approx(b[k], rel=1e-9, nan_ok=True) for k, x in a.items())


def test_packed_arrays_come_back():
    arrays = [np.array([3, -1, 2 ** 40], np.int64), np.zeros(0, np.int32), np.array([0.5, np.nan, -np.inf]), np.arange(300, dtype=np.int32)]
    for a, b in zip(arrays, nb.unpack(nb.pack(*arrays), *[a.dtype for a in arrays]), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b, equal_nan=a.dtype.kind == "f")


@pytest.fixture
def large(spark, tmp_path, monkeypatch):
    """A folder whose model counts as too large to broadcast."""
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS * 2 if t is not None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.memscan.broadcastMaxBytes", "0")
    monkeypatch.setattr(ts_op, "token_stats_by_chunks", lambda *a, **b: pytest.fail("a row for each position"))
    yield str(tmp_path)
    spark.conf.unset("spark.memscan.broadcastMaxBytes")


def test_scores_of_a_large_table_make_no_positions(spark, large):
    """Neither a position nor its lookups are shuffled."""
    n = cat.scores(spark, large).filter(F.col("method") == "loss").count()
    assert n == spark.read.parquet(f"{large}/documents.parquet").count()
    assert cat.scaled_scores(spark, large, True).count() == cat.scores(spark, large).count()


def test_stages_that_nothing_reads_are_deleted(spark, large):
    cat.backoff(spark, large)
    cat.scores(spark, large).count()
    at = f"{cat.store(spark).base}/{cat.tag(spark, large)}".removeprefix("file:")
    assert set(os.listdir(at)) == {"docs", "model", "backoff3", "raw_scores_clip0"}
    assert set(os.listdir(f"{at}/model")) == {"token_counts", "bigram_full", "contexts"}
    assert set(os.listdir(f"{at}/backoff3")) == {"order3_grams", "order3_contexts"}
