import pytest
from pyspark.sql import functions as F

from memscan.llm import common, linededup, neardup, repeats, setjoin

from . import brute
from .conftest import frame, odd_texts


def pairs(d):
    return [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]


def mutated(n=60):
    """One text with more and more words changed: a dense group with outsiders."""
    import random
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(100)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(100)] = f"m{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 20])
def test_near_duplicates(spark, odd, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    monkeypatch.setattr(setjoin, "LOCAL_HOT", 8)
    d = odd.select("doc_id", "text").unionAll(frame(spark, [(100 + i, t) for i, t in enumerate(mutated())]).select("doc_id", "text"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d).collect()}
    assert got == brute.near_duplicates(pairs(d))


def packed_sets(col):
    """Sets that stand in the column as packed hashes."""
    import numpy as np

    buf, off = common.text_buffer(col)
    return np.ascontiguousarray(buf).view(np.uint64), np.diff(off) // 8


def test_pairs_stay_together_in_branching_nodes(spark, monkeypatch):
    """200 pairs of similarity 0.75 that all start in one node, which branches twice."""
    import numpy as np

    monkeypatch.setattr(setjoin, "BLOCK", 20)
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(1, 2**64, n, dtype=np.uint64)
    hot, sets = draw(90), []
    for _ in range(200):
        both = draw(30)
        sets += [np.sort(np.concatenate([hot, both, draw(20)])) for _ in range(2)]
    h, n = np.concatenate(sets), np.array([len(x) for x in sets])
    sig = setjoin.brief(setjoin.minwise(h, np.cumsum(n) - n, 64))
    rows = [(i, np.uint64(1).tobytes(), sig[i].tobytes(), sets[i].tobytes()) for i in range(400)]
    d = spark.createDataFrame([(i, bytearray(k), bytearray(b), bytearray(e)) for i, k, b, e in rows],
                              "id long, keys binary, brief binary, text binary")
    common.prepare(spark)
    got = setjoin.links(d.select("id", "keys", "brief"), lambda ids: d.select("id", "text").join(ids, "id", "leftsemi"),
                        packed_sets)
    found = {r.id: r.component for r in got.collect()}
    assert all(c == i - i % 2 for i, c in found.items())
    assert len(found) >= 0.93 * 400


def test_outsiders_meet_the_whole_component(spark, monkeypatch):
    """One node that a component fills but for a few rows: some are near one
    member alone, two are near each other, the others near nothing."""
    import numpy as np

    monkeypatch.setattr(setjoin, "BLOCK", 20)
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(1, 2**64, n, dtype=np.uint64)

    def changed(x, n):
        return np.concatenate([rng.permutation(x)[n:], draw(n)])

    base, other = draw(100), draw(100)
    sets = [base] + [changed(base, 4) for _ in range(60)]
    sets += [changed(base, 13) for _ in range(3)]                     # 61 to 63: near the first alone
    sets += [other, changed(other, 5)] + [draw(100) for _ in range(4)]
    sets = [np.sort(x) for x in sets]
    h, n = np.concatenate(sets), np.array([len(x) for x in sets])
    sig = setjoin.brief(setjoin.minwise(h, np.cumsum(n) - n, 64))
    d = spark.createDataFrame([(i, bytearray(np.uint64(1).tobytes()), bytearray(sig[i].tobytes()), bytearray(x.tobytes()))
                               for i, x in enumerate(sets)], "id long, keys binary, brief binary, text binary")
    common.prepare(spark)
    met = []
    kept = setjoin.against_bodies
    monkeypatch.setattr(setjoin, "against_bodies", lambda *a: met.append(1) or kept(*a))
    got = setjoin.links(d.select("id", "keys", "brief"), lambda ids: d.select("id", "text").join(ids, "id", "leftsemi"),
                        packed_sets)
    found = {r.id: r.component for r in got.collect()}
    assert met
    assert found == dict.fromkeys(range(64), 0) | {64: 64, 65: 64}


def test_near_duplicates_of_documents(documents, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(documents).collect()}
    want = brute.near_duplicates(pairs(documents))
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert neardup.near_duplicates(nothing).count() == 0
    assert neardup.keep_first(documents).count() == len({c for _, c in want.values()})


def test_near_duplicates_null_and_repeated_ids(spark):
    t = odd_texts()
    rows = [(1, t[6]), (1, t[6]), (2, t[8]), (None, t[6]), (3, None), (3, ""), (4, t[20])]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True)] or got == [
        (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True)]
    kept = neardup.keep_first(frame(spark, rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 4]
    assert kept.columns == frame(spark, rows).columns


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in common.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert common.components(e.filter("a < 0")).count() == 0


def test_fuzzy_lines(spark, odd, documents, nothing):
    extra = [(200 + i, "\n".join(t[j:j + 90] for j in range(0, 270, 90))) for i, t in enumerate(mutated(20))]
    d = odd.select("doc_id", "text").unionAll(documents.select(F.col("doc_id") + 1000, "text")).unionAll(
        frame(spark, extra).select("doc_id", "text"))
    got = {(r.doc_id, r.line_no): (r.rep_doc_id, r.rep_line_no) for r in linededup.line_classes(d).collect()}
    assert got == brute.fuzzy_lines(pairs(d), linededup.SHINGLE)
    assert linededup.line_classes(nothing).count() == 0


@pytest.mark.parametrize("common_, left, right", [(3, 0, 1), (6, 1, 1), (6, 0, 2), (9, 0, 3), (12, 2, 2)])
def test_short_lines_meet_in_a_band(common_, left, right):
    """Lines of few shingles at similarity 0.75 are missed hardly more often than long ones."""
    import numpy as np

    n, spread = 20_000, linededup.TOKENS // 3
    bands = [[b, b + spread, b + 2 * spread] for b in range(0, spread, spread // linededup.BANDS)][:linededup.BANDS]
    u = np.random.default_rng(1).integers(0, 2**64, (n, common_ + left + right), dtype=np.uint64)
    sides = [u[:, :common_ + left], np.delete(u, np.s_[common_:common_ + left], 1)]
    sig = [setjoin.one_permutation(x.ravel(), np.repeat(np.arange(n), x.shape[1]), n, linededup.TOKENS) for x in sides]
    a, b = (setjoin.band_keys(s, bands) for s in sig)
    near = (setjoin.brief(sig[0]) == setjoin.brief(sig[1])).mean(1) >= linededup.LEAST
    assert 1 - ((a == b).any(1) & near).mean() < 0.01


def test_drop_repeated_lines(spark, odd, nothing):
    want = brute.fuzzy_lines(pairs(odd), linededup.SHINGLE)
    out = linededup.drop_repeated_lines(odd)
    assert out.columns == odd.columns
    kept = {}
    for i, t in pairs(odd):
        x = "\n".join(x for n, x in enumerate((t or "").split("\n")) if want[i, n] == (i, n))
        if x.strip():
            kept[i] = x
    assert {r.doc_id: r.text for r in out.collect()} == kept
    assert linededup.drop_repeated_lines(nothing).count() == 0


@pytest.mark.parametrize("variants", [512, 1])
def test_without_repeats(spark, odd, documents, monkeypatch, variants):
    monkeypatch.setattr(repeats, "VARIANTS", variants)
    monkeypatch.setattr(repeats, "LOCAL_HOT", 64 if variants > 1 else 1)
    texts = [t[40 * i:] + "-" * i + t for i, t in enumerate([odd_texts()[6]] * 12)]
    d = odd.select("doc_id", "text").unionAll(documents.limit(60).select(F.col("doc_id") + 1000, "text")).unionAll(
        frame(spark, [(500 + i, t) for i, t in enumerate(texts)]).select("doc_id", "text"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(d).collect()}
    assert got == brute.without_repeats(pairs(d))


def test_repeats_edges(spark, nothing):
    t = odd_texts()[6]
    rows = [(1, t), (1, t), (None, t), (None, None), (2, t[:50])]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.without_repeats(frame(spark, rows)).collect())
    n = len(t.encode())
    assert got == [(0, 0, 0), (0, n, 0), (1, n, n), (1, n, n), (2, len(t[:50].encode()), 0)]
    assert repeats.without_repeats(nothing).count() == 0
    out = repeats.cut_repeats(frame(spark, [(1, "é" * 120), (2, "x" + "é" * 130)]))
    assert out.columns == nothing.columns
    assert {r.doc_id: set(r.text) for r in out.collect()}[2] <= {"x", "é"}


def test_maximal_repeats_of_a_small_array():
    import numpy as np
    text = np.frombuffer(b"xabcyabcz", np.uint8)
    room = np.arange(9, 0, -1)
    sa, lcp = repeats.enhanced_suffix_array(text, room, np.arange(9))
    order = sorted(range(9), key=lambda i: text[i:].tobytes())
    assert sa.tolist() == order
    before = np.append(-1, text[:-1].astype(np.int64))
    found = {(n, tuple(sorted(o.tolist()))) for n, o in repeats.maximal_repeats(sa, lcp, before, 2)}
    assert found == {(3, (1, 5))}       # "bc" is not left-diverse
