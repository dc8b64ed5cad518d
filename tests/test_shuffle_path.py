"""Beyond the broadcast bound: the lookups become shuffle joins (no explicit
broadcast of the model) and the scores stay identical."""

from pyspark.sql import functions as F

from memscan.operators import scores as sc
from memscan.operators import token_stats as ts_op
from memscan.plans import catalog as cat

from .conftest import SF001


def _plan(df):
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", old)


def test_shuffle_join_path_matches(spark):
    d = cat.docs(spark, SF001)
    m = cat.model(spark, SF001)
    docs = d.select("doc_id", "T", "clen", "label")
    want = sc.raw_scores(sc.position_values(ts_op.token_stats(d, m, ["label", "clen"]), False), docs, ["label"])
    spark.conf.set("spark.memscan.broadcastMaxBytes", "0")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert not m.broadcastable()
        got = sc.raw_scores(sc.position_values(ts_op.token_stats(d, m, ["label", "clen"]), False), docs,
                            ["label"])
        a = {(r["doc_id"], r["method"]): r["score"] for r in want.collect()}
        b = {(r["doc_id"], r["method"]): r["score"] for r in got.collect()}
        assert a.keys() == b.keys()
        for k, v in a.items():
            assert (v != v and b[k] != b[k]) or abs(v - b[k]) <= 1e-9 * max(1.0, abs(v)), k
        plan = _plan(got)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset("spark.memscan.broadcastMaxBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")


def test_broadcast_path_keeps_one_exchange(spark):
    d = cat.docs(spark, SF001)
    m = cat.model(spark, SF001)
    assert m.broadcastable()
    raw = sc.raw_scores(sc.position_values(ts_op.token_stats(d, m, ["label", "clen"]), False),
                        d.select("doc_id", "T", "clen", "label"), ["label"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(raw)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one hash exchange of the token arrays by doc_id; the windows reuse it
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_mixed_path_broadcasts_small_tables(spark):
    """Only the bigram table beyond the bound: contexts and unigram stay
    broadcast, the two bigram lookups become shuffle joins."""
    d = cat.docs(spark, SF001)
    m = cat.model(spark, SF001)
    bound = (max(m.n_contexts, m.s.V + 1) + 1) * 96
    assert m.n_bigrams * 96 > bound
    want = {(r["doc_id"], r["pos"]): (r["lp"], r["lp_alt"])
            for r in ts_op.token_stats(d, m, ["label", "clen"]).collect()}
    spark.conf.set("spark.memscan.broadcastMaxBytes", str(bound))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert m.fits("contexts") and m.fits("unigram") and not m.fits("bigram")
        ts = ts_op.token_stats(d, m, ["label", "clen"])
        plan = _plan(ts)
        assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") == 4
        got = {(r["doc_id"], r["pos"]): (r["lp"], r["lp_alt"]) for r in ts.collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.memscan.broadcastMaxBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
