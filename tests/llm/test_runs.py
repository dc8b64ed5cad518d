import hashlib
import random

import numpy as np
import pytest

from memscan.llm import common, queries, runs

from . import brute
from .conftest import SF, odd_texts


def periodic(rng):
    """Words with runs, some of whose periods are themselves nearly periodic."""
    kinds = rng.choice([1, 2, 3, 5, 50])
    n = rng.randint(0, 120)
    if rng.random() < 0.3:
        return [rng.randint(0, kinds) for _ in range(n)]
    out = []
    while len(out) < n:
        root = [rng.randint(0, kinds) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.5:
            root = [1] * rng.randint(0, 12) + root
        if rng.random() < 0.3:
            root = root * rng.randint(1, 5) + [7]
        x = root * rng.randint(1, 7)
        out += x[:len(x) - rng.randint(0, len(root)) or None] + [rng.randint(0, kinds) for _ in range(rng.randint(0, 3))]
    return out


def found(texts):
    counts = np.array([len(t) for t in texts], np.int64)
    words = common.mix(np.array([x for t in texts for x in t], np.int64).astype(np.uint64))
    s, e, q = runs.word_runs(words, counts)
    at = np.append(0, np.cumsum(counts))
    return [[(int(a - at[i]), int(b - a), int(c)) for a, b, c in zip(s, e, q, strict=True) if at[i] <= a < at[i + 1]]
            for i in range(len(texts))]


def test_runs_equal_the_definition():
    rng = random.Random(3)
    for _ in range(150):
        texts = [periodic(rng) for _ in range(rng.randint(1, 12))]
        assert found(texts) == [brute.word_runs(t) for t in texts]


def test_long_runs_and_fibonacci_words():
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    cube = [1, 2, 3] * 400 + [4] + [9] * 700 + b + [5] * 5
    for t in (b, b * 4, cube, [1] * 5, [1] * 6, [1, 2] * 4, [1, 2] * 3 + [1], []):
        assert found([t]) == [brute.word_runs(t)]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 300):
        v = rng.permutation(n)
        w = runs.WaveletMatrix(v)
        lo = rng.integers(0, n, 50)
        hi = np.minimum(lo + rng.integers(1, n + 1, 50), n)
        x, k = rng.integers(0, n + 1, 50), (hi - lo) // 2
        assert w.below(lo, hi, x).tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x, strict=True)]
        assert w.quantile(lo, hi, k).tolist() == [sorted(v[a:b])[c] for a, b, c in zip(lo, hi, k, strict=True)]


def test_exponents_below_four_are_refused():
    with pytest.raises(ValueError):
        runs.word_runs(np.ones(9, np.uint64), np.array([9]), min_exponent=3)


def expected(doc_id, text, rearrange=None):
    w = brute.WORD.findall(text or "")
    if rearrange is not None:
        w = [w[i] for i in rearrange([doc_id], np.array([len(w)])).tolist()]
    r = brute.word_runs(w)
    gone = {i for s, n, q in r for i in range(s + q, s + n)}
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in r)
    return r, left, (doc_id, len(r), *best, 1000 * best[1] // best[2] if r else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_frames(odd, nothing):
    texts = list(enumerate(odd_texts()))
    want = {i: expected(i, t) for i, t in texts}
    rows = runs.find_runs(odd).collect()
    assert sorted((r.doc_id, r.start, r.length, r.period) for r in rows) == \
        sorted((i, *r) for i, (found_runs, *_) in want.items() for r in found_runs)
    out = runs.collapse(odd).collect()
    assert {r.doc_id: r.text for r in out} == {i: x[1] for i, x in want.items()}
    assert {r.doc_id: r.n_dropped for r in out} == \
        {i: len(brute.WORD.findall(t or "")) - len(brute.WORD.findall(want[i][1])) for i, t in texts}
    for f in (runs.find_runs, runs.collapse, runs.run_digests):
        assert f(nothing).count() == 0


def test_missing_ids_and_repeated_rows(spark):
    text = "a b " * 5 + "c"
    d = spark.createDataFrame([(None, text), (None, None), (3, text), (3, text)], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in runs.run_digests(d, queries.copied_tails).collect())))
    assert got == sorted(str(expected(i, t, queries.copied_tails)[2]) for i, t in ((None, text), (None, None), (3, text), (3, text)))


def test_query(spark, documents):
    got = sorted(tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect())
    assert got == sorted(expected(r.doc_id, r.text, queries.copied_tails)[2] for r in documents.collect())
    assert sum(r[1] > 0 for r in got) > 10
