"""Property test: the one-sort, ten-ratio kernel equals sorting each group in
NumPy and averaging its first int(n*r) values, with NaN and +-inf present."""

import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from memscan.constants import RATIOS
from memscan.operators.scores import smallest_k_mean

values = st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.just(float("nan")),
                   st.just(float("inf")), st.just(float("-inf")))
groups = st.lists(st.lists(values, min_size=0, max_size=25), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups)
def test_smallest_k_mean_matches_numpy(spark, gs):
    rows = [(g, float(v), len(vs)) for g, vs in enumerate(gs) for v in vs]
    if not rows:
        return
    df = spark.createDataFrame(rows, "g int, v double, n int")
    got = {(r["g"], r["r_ix"]): r["kmean"] for r in smallest_k_mean(df, ["g"]).collect()}
    for g, vs in enumerate(gs):
        arr = np.sort(np.asarray(vs, dtype=float))
        for j, r in enumerate(RATIOS):
            k = int(len(vs) * r)
            if k == 0:
                assert (g, j) not in got
                continue
            with np.errstate(all="ignore"):
                want = float(np.mean(arr[:k]))
            have = got[(g, j)]
            if math.isnan(want):
                assert math.isnan(have)
            elif math.isinf(want):
                assert have == want
            else:
                assert have == __import__("pytest").approx(want, rel=1e-9, abs=1e-9)
