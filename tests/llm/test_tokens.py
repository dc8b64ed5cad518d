import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memscan.llm import bpe, packing
from memscan.llm.queries import vocabulary_file

from .conftest import odd_texts

BYTE, WORDS = vocabulary_file("byte_bpe_50k.json"), vocabulary_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def libs():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORDS)


def texts():
    rng = random.Random(1)
    pool = [chr(x) for x in [*range(1, 0x250), 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x4E00, 0xBD, 0x2160, 0x1F600, 0x301, 0x660]]
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(rng.choice("aehinrst .,'") for _ in range(80)) for _ in range(200)]
    out += ["a" * n for n in range(1, 40)] + ["=" * 70, " " * 90, "Word... WORD, don't I'LL", "ΟΔΟΣ İ", "ab" * 200]
    return out + [t for t in odd_texts() if t]


def test_words_equal_the_library(libs):
    m, enc = bpe.model(BYTE), packing.encoder(WORDS)
    for t in texts():
        ids = libs[0].encode(t, add_special_tokens=False).ids
        assert m.encode(t) == ids
        assert m.decode(ids) == libs[0].decode(ids, skip_special_tokens=False)
        got = np.frombuffer(enc.encode_all([t])[0], "<u4").tolist()
        assert got == libs[1].encode(t, add_special_tokens=False).ids


def test_only_failing_words_need_merging():
    m = bpe.model(BYTE)
    words = ["hello", " the", "thonerly", "zzzzzz"]
    for w, ids in zip(words, m.encode_words(words), strict=True):
        assert ids == m.exact(w.encode()) == m.exact_all([w.encode()])[0]
    a, b = np.array([m.id_of[b"t"], m.id_of[b"q"]]), np.array([m.id_of[b"h"], m.id_of[b"z"]])
    assert m.apart(a, b).tolist() == [False, True]


def test_round_trip_digests(libs, odd, documents, nothing):
    for d in (odd, documents):
        rows = {r.doc_id: r.text for r in d.collect()}
        for r in bpe.round_trip_digests(d, BYTE).collect():
            ids = libs[0].encode(rows[r.doc_id] or "", add_special_tokens=False).ids
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()
    assert bpe.round_trip_digests(nothing, BYTE).count() == 0


def test_encode_decode_frames(odd):
    ids = bpe.encode(odd, BYTE)
    back = {r.doc_id: r.text for r in bpe.decode(ids, BYTE).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd_texts())}


def check_packs(rows, capacity):
    packs = {}
    for r in rows:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in packs.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= capacity
    return len(packs)


def test_pack_documents(spark, libs, odd, documents, nothing):
    d = odd.select("doc_id", "text").unionAll(documents.select(F.col("doc_id") + 1000, "text"))
    d = d.unionAll(d.filter("doc_id in (5, 1003)"))      # repeated rows
    want = {r.doc_id: libs[1].encode(r.text or "", add_special_tokens=False).ids + [2] for r in d.collect()}
    rows = packing.pack_documents(d, WORDS).collect()
    n = check_packs(rows, 4096)
    covered = {}
    for r in rows:
        part = want[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and len(part) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {i: len(x) * (2 if i in (5, 1003) else 1) for i, x in want.items()}
    assert sum(r.length for r in rows) > 0.95 * 4096 * (n - 1)
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_patterns_hold_the_histogram():
    rng = random.Random(2)
    for h in ({rng.randint(1, 64): rng.randint(1, 10 ** 9) for _ in range(40)}, {7: 10 ** 12}, {64: 3}, {}):
        p = packing.pack_patterns(h, 64)
        got = {}
        for packs, runs in p:
            assert packs > 0 and sum(a * b for a, b in runs) <= 64
            for a, b in runs:
                got[a] = got.get(a, 0) + packs * b
        assert got == h and len(p) <= 3 * 64
