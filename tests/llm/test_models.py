import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memscan.llm import common, katz, langid, license, quality, vectors

from . import brute
from .conftest import frame, odd_texts


def test_katz_scores(odd, documents, nothing, monkeypatch):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    col = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 5_000)
    monkeypatch.setattr(katz, "PART_WORDS", 10_000)
    monkeypatch.setattr(katz, "PART_PAIRS", 20_000)
    for d in (documents.select("doc_id", "text").unionAll(odd.select(F.col("doc_id") + 1000, "text")), odd):
        want = brute.katz([(r.doc_id, r.text) for r in d.collect()], held)
        for r in katz.katz_scores(d, col).collect():
            w = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and r.held_out == held(r.doc_id)
            assert abs(r.base_score - w[3]) < 1e-7 * abs(w[3]) + 1e-9 and abs(r.score - w[4]) < 1e-7 * abs(w[4]) + 1e-9
    assert katz.katz_scores(nothing, col).count() == 0
    none = katz.katz_scores(odd, F.lit(True)).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in none)


def test_language(spark, documents, nothing):
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    d = documents.select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify(d, part != 1, part == 1).collect()}
    rows = d.collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in test)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd_rows = [(i, t, None if i % 2 else "en") for i, t in enumerate(odd_texts())] + [(None, "the one", "en")]
    out = {r.doc_id: r for r in langid.identify(frame(spark, odd_rows), part != 1, part == 1).collect()}
    letters = {i for i, t, _ in odd_rows if t and any(c.isalpha() for c in t)}
    assert {i for i, r in out.items() if r.lang_pred != "und"} == letters
    assert langid.identify(nothing, part != 1, part == 1).count() == 0
    assert {r.lang_pred for r in langid.identify(d, F.lit(False), F.lit(True)).collect()} == {"und"}


def test_kernel_is_shared_gram_count():
    sets = [np.unique(langid.gram_codes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t in (b"abab", b"babc")]
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert len(np.intersect1d(*sets)) == len(grams(b"abab") & grams(b"babc"))


def test_quality_base_counts(odd, documents, nothing):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for d in (odd, documents):
        rows = {r.doc_id: r.text for r in d.collect()}
        q = quality.quality(d)
        assert q.columns[:len(d.columns)] == d.columns
        for r in q.collect():
            b = brute.quality_base(rows[r.doc_id])
            assert tuple(r[c] for c in cols) == b
            assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
            assert not (r.base_failed and r.kept)
    assert quality.quality(nothing).count() == 0


def test_quality_keeps_prose_and_drops_junk(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id")
    share = {r.quality: r.kept for r in quality.quality(d).groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.95 and share[0] < 0.2


@pytest.mark.parametrize("copies", [False, True])
def test_quality_drops_a_third_of_bad_rows(spark, copies):
    """Bad rows, of many texts or copies of one, do not become the reference."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id").filter("lang = 'en'")
    clean = clean.select("doc_id", "text", "lang")
    rng = random.Random(2)
    bad = [" ".join(rng.choice(["###", "$$$", "%%%", "a#b", "$x$", "the"]) for _ in range(120)) for _ in range(clean.count() // 2)]
    rows = [(10 ** 9 + i, bad[0] if copies else t, "en") for i, t in enumerate(bad)]
    every = clean.unionAll(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    q = quality.quality(every, stage=lambda h: common.stage(h.drop("text"), "t-quality"))
    share = {r.bad: r.kept for r in q.groupBy((F.col("doc_id") >= 10 ** 9).alias("bad")).agg(
        F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[False] > 0.95 and share[True] < 0.01


def test_js_distance(spark):
    d = spark.createDataFrame([([1.0, 3.0], [0.25, 0.75]), ([1.0, 0.0], [0.0, 1.0])], "c array<double>, q array<double>")
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    got = [r[0] for r in d.select(quality.js_distance(F.col("c"), F.col("q"), total)).collect()]
    assert abs(got[0]) < 1e-9 and abs(got[1] - 1) < 1e-9


def test_quality_runs_without_python(spark, documents):
    plan = quality.quality(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange hash.*doc_id", plan)


def test_license_scan(spark, nothing):
    t = license.TEMPLATES
    words = t["mit"].split()
    rows = [(0, None), (1, ""), (2, "Some prose. " + t["mit"] + " More."), (3, " ".join(words[:40] + ["extra", "words"] + words[40:])),
            (4, "released under the mit license"), (5, "Released under the MIT License.\n" * 3), (6, " ".join(words[:20])),
            (7, "no license here at all"), (8, "x " * 3000 + t["apache-2.0-line"])]
    got = [(r.doc_id, r.license, r.n_matched) for r in license.scan(frame(spark, rows)).collect()]
    full = len(license.Index(t).tok[license.Index(t).names.index("mit")])
    assert sorted(got) == sorted([(2, "mit", full), (3, "mit", full), (4, "mit-line", 5), *[(5, "mit-line", 5)] * 3, (8, "apache-2.0-line", 8)])
    assert license.scan(nothing).count() == 0
    spans = {r.doc_id: r for r in license.scan(frame(spark, rows)).collect() if r.doc_id == 2}
    assert spans[2].matched_text == t["mit"].rstrip(".") and spans[2].coverage == 1.0


def test_license_scan_of_changed_and_short_notices(spark):
    rows = [(1, "Released under an MIT License"), (2, "Code: licensed under CC XX-NC 4.0, see below"),
            (3, "Copyright X. All rights reserved. All Rights Reserved."), (4, "Released here under really the now MIT old License"),
            (5, "rights of all kinds, and the seats reserved for them"), (6, "Released under an old License")]
    got = sorted((r.doc_id, r.license, r.n_matched, r.matched_text) for r in license.scan(frame(spark, rows)).collect())
    assert got == [(1, "mit-line", 4, "Released under an MIT License"), (2, "cc-by-nc-4.0-line", 6, "licensed under CC XX-NC 4.0"),
                   (3, "all-rights-reserved", 3, "All Rights Reserved"), (3, "all-rights-reserved", 3, "All rights reserved"),
                   (4, "mit-line", 5, "Released here under really the now MIT old License")]
    with pytest.raises(ValueError, match="without a word"):
        license.Index({"empty": "..."})


def test_banded_alignment_equals_full(spark):
    rng = random.Random(4)
    for _ in range(100):
        a = [rng.randint(0, 30) for _ in range(rng.randint(5, 20))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 2)):
            b.insert(rng.randint(0, len(b)), 99)
        pad = [77] * rng.randint(0, 5)
        doc = np.array(pad + b + [78] * 3, np.uint64)
        m, i, j = license.align(np.array(a, np.uint64), doc, len(pad), 8)
        # score of the alignment found: matches, then everything skipped or replaced inside the span
        assert m <= len(a) and (m == 0 or (len(pad) <= i < j <= len(pad) + len(b)))
        best = brute.full_alignment(a, doc.tolist())
        assert 2 * m >= best


def vector_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:60] + 0.05 * rng.normal(size=(60, 16)), np.tile(x[5], (40, 1)), 2 * x[6:7]])
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    bad = [None, [0.0] * 16, [], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)]


def test_vectors(spark):
    rows = vector_rows()
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(d).collect()}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i < 1000]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    comp = brute.components(range(len(good)), np.argwhere(hit))
    want = {i: (int(hit[i].sum()), comp[i], comp[i] == i) for i in range(len(good))}
    links = sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][0] for i in want) >= 0.99 * links
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert {got[i] for i, _ in rows if i >= 1000} == {(0, i, True) for i, _ in rows if i >= 1000}
    assert vectors.near_vectors(d.filter("vec_id < 0")).count() == 0


def test_vectors_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=8) + 0.02 * rng.normal(size=(90, 8))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(d).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(89, 0)}


def test_many_notices_keep_the_best_matches(spark):
    """400 notices side by side, a few words of some changed: whole matches are
    never lost to weaker ones, against all ways to choose from the candidates."""
    rng = random.Random(11)
    line = license.TEMPLATES["cc-by-4.0"].split()
    parts, whole = [], 0
    for _ in range(400):
        w = list(line)
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "other"
        else:
            whole += 1
        parts.append(" ".join(w))
    d = spark.createDataFrame([(1, " ".join(parts)), (2, None), (3, "")], "doc_id long, text string")
    rows = [r for r in license.scan(d, {"cc": license.TEMPLATES["cc-by-4.0"]}).collect()]
    assert sum(r.coverage == 1.0 for r in rows) == whole
    spans = sorted((r.start_byte, r.end_byte) for r in rows)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
