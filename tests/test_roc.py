"""ROC metrics against the definition, including the multi-range prefix sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memscan.operators import roc

from .reference_impl import roc_metrics


def frame(spark, per_method):
    rows = [(m, i, float(s), int(y)) for m, (ss, ys) in per_method.items() for i, (s, y) in enumerate(zip(ss, ys))]
    return spark.createDataFrame(rows, "method string, doc_id long, score double, label int")


def check(spark, per_method, n_ranges):
    got = {r["method"]: (r["auroc"], r["fpr95"], r["tpr05"])
           for r in roc.evaluate_methods(frame(spark, per_method), n_ranges=n_ranges).collect()}
    for m, (ss, ys) in per_method.items():
        want = roc_metrics(np.round(np.asarray(ss, float), 9), ys) \
            if np.isfinite(ss).sum() else (0.0, 1.0, 0.0)
        if m not in got:       # no finite score at all: the method has no row
            assert not np.isfinite(np.asarray(ss, float)).any()
            continue
        assert got[m] == pytest.approx(want, abs=1e-12), m


def cases():
    rng = np.random.default_rng(1)
    c = {}
    y = rng.integers(0, 2, 300)
    c["random"] = (rng.normal(size=300) + y, y)
    c["ties"] = (np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300))
    c["all_tied"] = (np.zeros(50), rng.integers(0, 2, 50))
    c["pairs20"] = (np.repeat(np.arange(20.0), 2), np.tile([1, 0], 20))
    c["one_class"] = (rng.normal(size=30), np.ones(30, int))
    c["one_row"] = (np.array([0.5]), np.array([1]))
    c["specials"] = (np.array([np.nan, np.inf, -np.inf, 1.0, 2.0, 3.0, 0.5, 1e12]), np.array([1, 0, 1, 0, 1, 1, 0, 1]))
    return c


@pytest.mark.parametrize("n_ranges", [1, 7])
def test_roc_against_definition(spark, n_ranges):
    check(spark, cases(), n_ranges)


def test_twenty_tied_pairs(spark):
    m = roc.evaluate_methods(frame(spark, {"p": (np.repeat(np.arange(20.0), 2), np.tile([1, 0], 20))}), n_ranges=3)
    r = m.first()
    assert r["fpr95"] == 1.0 and r["tpr05"] == pytest.approx(0.05)


def test_auroc_symmetry(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    s = rng.normal(size=200) + y
    m = {r["method"]: r["auroc"] for r in roc.evaluate_methods(frame(spark, {"a": (s, y), "b": (-s, y)}), n_ranges=4).collect()}
    assert m["a"] + m["b"] == pytest.approx(1.0, abs=1e-12)


def test_roc_points_are_monotone(spark):
    c = cases()
    p = roc.roc_points(frame(spark, {"random": c["random"], "ties": c["ties"]}), n_ranges=5)
    for meth in ["random", "ties"]:
        pts = sorted((r["fpr"], r["tpr"]) for r in p.filter(F.col("method") == meth).collect())
        assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
        assert all(b[1] >= a[1] for a, b in zip(pts, pts[1:]))


def test_guard_for_methods_without_rows(spark):
    m = roc.all_methods(spark, roc.evaluate_methods(frame(spark, {"loss": ([1.0, 2.0], [0, 1])})))
    rows = {r["method"]: r for r in m.collect()}
    assert len(rows) == 122
    assert rows["loss"]["auroc"] == 1.0
    assert (rows["zlib"]["auroc"], rows["zlib"]["fpr95"], rows["zlib"]["tpr05"]) == (0.0, 1.0, 0.0)


def test_ranges_equal_single_range_on_real_scores(spark):
    from memscan.plans import catalog as cat

    from .conftest import SF001
    s = cat.scores(spark, SF001)
    one = {r["method"]: (r["auroc"], r["fpr95"], r["tpr05"]) for r in roc.evaluate_methods(s, n_ranges=1).collect()}
    many = {r["method"]: (r["auroc"], r["fpr95"], r["tpr05"]) for r in roc.evaluate_methods(s, n_ranges=6).collect()}
    assert one.keys() == many.keys() and len(one) == 122
    for m, v in one.items():
        assert many[m] == pytest.approx(v, abs=1e-12), m
