"""The driver contract and the end-to-end user API."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from memscan.plans import membership as mb
from memscan.session import StageStore
from memscan.sources import documents_snippets

from .conftest import SF001


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 122
    assert set(df.columns) == {"method", "method_order", "auroc", "fpr95", "tpr05", "auroc_pct", "fpr95_pct",
                               "tpr05_pct"}
    best = max(r["auroc"] for r in rows)
    assert 0.9 < best <= 1.0


def test_every_query_has_a_plan(spark):
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    cheap = ["clean_text", "dataset_statistics", "vocabulary", "top_methods"]
    for name in cheap:
        assert q[name](spark, SF001).count() >= 1


def test_membership_run(spark):
    r = mb.run(spark, documents_snippets(spark, SF001), store=StageStore(spark))
    m = mb.metrics(spark, r.scores)
    assert m.count() == 122
    assert r.scores.filter(F.col("method") == "loss").count() == 200
