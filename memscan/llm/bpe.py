"""BPE encoding by speculation and verification, and decoding.

A word's tokens are proposed by greedy longest match.  A sequence of tokens is
the BPE result exactly if every adjacent pair is one that BPE leaves apart;
that test runs vectorised over all pairs of all new words at once.  Only words
with a failing pair are merged exactly.  Words repeat, so each worker encodes
a word once and keeps it in a bounded cache.

Edge cases: null text is empty (no ids, empty decoded text); whole texts of
any length; strings of added special tokens in a text become their single id;
repeated rows are encoded one by one; an empty table gives an empty result;
extra columns are not read."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common

CACHE_WORDS = 600_000
LONG_WORD = 64            # longer words are not cached
NEVER = np.int64(1) << np.int64(60)
SHORT_WORD = 32


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others are shifted behind U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """Splits text into words as the byte-level pre-tokenizer does."""

    #: Fixed value: the published split pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    #: characters whose class the standard library's patterns can state as ranges
    OUTSIDE = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ‐-‧]")

    def __init__(self):
        import regex

        self.full = regex.compile(self.PATTERN, flags=regex.VERSION1 | regex.UNICODE)
        a = self.LETTER
        self.fast = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{a}]+| ?[0-9]+| ?[^\s{a}0-9]+|\s+(?!\S)|\s+")

    def words(self, text: str) -> list[str]:
        return (self.full if self.OUTSIDE.search(text) else self.fast).findall(text)


class Bpe:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * self.size
        self.id_of: dict[bytes, int] = {}
        for s, i in vocab.items():
            self.bytes_of[i] = raw(s)
            self.id_of[raw(s)] = i
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.split = Splitter()
        # merges: rank of a pair, and of each token the merge that makes it
        n = self.size
        self.born = np.full(n, -1, np.int64)
        self.left = np.zeros(n, np.int64)
        self.right = np.zeros(n, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, c = self.id_of[raw(a)], self.id_of[raw(b)], self.id_of[raw(a) + raw(b)]
            self.merge.setdefault((a, b), (rank, c))
            if self.born[c] < 0:
                self.born[c], self.left[c], self.right[c] = rank, a, b
        pairs = np.array(list(self.merge), np.int64).reshape(-1, 2)
        key = pairs[:, 0] * n + pairs[:, 1]
        rank = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], rank[order]
        self.made_by = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
        self.made_by[rank] = [c for _, c in self.merge.values()]
        self.byte_id = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)], np.int64)
        # tokens that BPE makes from their own bytes; greedy proposes only these
        ids = np.arange(n)
        made = self.born >= 0
        ok = np.ones(n, bool)
        ok[made] = self.apart(self.left[made], self.right[made], self.born[made])
        for i in ids[made][np.argsort(self.born[made])]:
            ok[i] &= ok[self.left[i]] and ok[self.right[i]]
        single = np.array([len(b) == 1 for b in self.bytes_of])
        ok &= made | single
        self.greedy = {self.bytes_of[i]: int(i) for i in ids if ok[i] and i not in self.special.values()}
        self.longest = max(map(len, self.greedy))
        # per word: its ids joined by commas, the bytes that its ids decode to
        self.joined: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, k), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == k, self.pair_rank[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does BPE on their joint bytes leave them
        apart (before merge ``until``)?

        Walks back through the merges that made the two tokens, newest first.
        While tokens x | y face each other, their merge must not come before
        the merge that grows x to the left (leftmost goes first on ties) nor,
        ties included, before the one that grows y to the right."""
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        result = np.ones(len(a), bool)
        grow_a = np.full(len(a), NEVER) if until is None else until.astype(np.int64).copy()
        grow_b = grow_a.copy() if until is None else until - 1
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            q = self.rank_of(x, y)
            bad = (q < grow_a[live]) & (q <= grow_b[live])
            result[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            back_a = go & (bx > by)
            back_b = go & ~back_a
            i = live[back_a]
            grow_a[i] = bx[back_a]
            a[i] = self.right[x[back_a]]
            i = live[back_b]
            grow_b[i] = by[back_b]
            b[i] = self.left[y[back_b]]
            live = live[go]
        return result

    def propose(self, word: bytes) -> list[int]:
        out, i, n, get = [], 0, len(word), self.greedy.get
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges lowest rank first, leftmost on ties; O(n log n)."""
        ids = [self.id_of[word[i:i + 1]] for i in range(len(word))]
        nxt = list(range(1, len(ids) + 1))
        prv = list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j] = self.merge[x, y][1], -1
            nxt[i] = nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = i
            for p in (prv[i], i):
                if p >= 0 and nxt[p] < len(ids) and (m := self.merge.get((ids[p], ids[nxt[p]]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[nxt[p]]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Speculate for all words, verify all pairs at once, merge the rest."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = [self.propose(w) for w in raw]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(lens.sum()))
        if len(flat) > 1:
            of = np.repeat(np.arange(len(ids)), lens)
            inner = of[:-1] == of[1:]
            bad = ~self.apart(flat[:-1][inner], flat[1:][inner])
            failing = np.unique(of[:-1][inner][bad])
            for k, x in zip(failing, self.exact_all([raw[k] for k in failing]), strict=True):
                ids[k] = x
        return ids

    def exact_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words: short ones row by row of a matrix, one
        merge in every row per step; long ones singly."""
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= SHORT_WORD]
        for k, w in enumerate(words):
            if len(w) > SHORT_WORD:
                out[k] = self.exact(w)
        for at in range(0, len(short), 20_000):
            rows = short[at:at + 20_000]
            width = max(len(words[k]) for k in rows)
            flat = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in rows), np.uint8)
            lens = np.array([len(words[k]) for k in rows])
            tok = np.where(np.arange(width) < lens[:, None], self.byte_id[flat].reshape(-1, width), -1)
            for k, x in zip(rows, self._merge_rows(tok), strict=True):
                out[k] = x
        return out

    def _merge_rows(self, tok: np.ndarray) -> list[list[int]]:
        n, width = tok.shape
        tok = np.concatenate([tok, np.full((n, 1), -1)], 1)
        rank = np.full((n, width), NEVER)
        there = tok[:, 1:] >= 0
        rank[there] = self.rank_of(tok[:, :-1][there], tok[:, 1:][there])
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(1)          # the first of equal ranks
            go = rank[live, best] < NEVER
            live, best = live[go], best[go]
            if not len(live):
                break
            tok[live, best] = self.made_by[rank[live, best]]
            # close the gap behind the merged pair
            cols = np.arange(width)
            src = cols + (cols > best[:, None])
            t = tok[live[:, None], np.minimum(src, width)]
            r = np.where(src < width, rank[live[:, None], np.minimum(src, width - 1)], NEVER)
            tok[live, :width] = t
            tok[live, width] = -1
            for c, ok in ((best, tok[live, best + 1] >= 0), (best - 1, best > 0)):
                i = np.flatnonzero(ok)
                r[i, c[i]] = self.rank_of(tok[live[i], c[i]], tok[live[i], c[i] + 1])
            r[tok[live, 1:width + 1] < 0] = NEVER
            rank[live] = r
        return [x[x >= 0].tolist() for x in tok]

    def lookup(self, words: set[str]) -> tuple[dict[str, str], dict[str, bytes]]:
        """Joined ids and decoded bytes of all ``words``."""
        joined, decoded = self.joined, self.decoded
        new = [w for w in words if w not in joined]
        if len(joined) + len(new) > CACHE_WORDS:
            joined.clear()
            decoded.clear()
            new = list(words)
        if len(new) > CACHE_WORDS or any(len(w) > LONG_WORD for w in new):      # not to be kept
            joined = {w: joined[w] for w in words if w in joined}
            decoded = {w: decoded[w] for w in joined}
        ids = self.encode_words(new)
        joined.update(zip(new, [",".join(map(str, x)) for x in ids], strict=True))
        decoded.update(zip(new, [self.decode_bytes(x) for x in ids], strict=True))
        return joined, decoded

    def segments(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.special_re is None or not self.special_re.search(text):
            return self.split.words(text)
        out = []
        for part in self.special_re.split(text):
            out += [part] if part in self.special else self.split.words(part)
        return out

    def encode(self, text: str) -> list[int]:
        out = []
        words = self.segments(text)
        got = dict(zip(set(words), self.encode_words(list(set(words))), strict=True))
        for w in words:
            out += [self.special[w]] if w in self.special else got[w]
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_models: dict[str, Bpe] = {}


def model(path: str) -> Bpe:
    if path not in _models:
        _models[path] = Bpe(path)
    return _models[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer)
        for b in common.chunks(batches, "t"):
            ids = [m.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    common.prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text of rows with an array of ids (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer)
        for b in batches:
            out = [m.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    common.prepare(rows.sparkSession)
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same encoder and decoder, word by word: joined ids and decoded bytes
    of a word are kept with it, so ids never become Python objects per token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in common.chunks(batches, "t", max_bytes=2 << 20):
            n, a, d = [], [], []
            texts = [m.segments(t or "") for t in b.column(1).to_pylist()]
            joined, decoded = m.lookup(set(itertools.chain.from_iterable(texts)).difference(m.special))
            for words in texts:
                if m.special and not m.special.keys().isdisjoint(words):
                    ids = ",".join([joined[w] if w not in m.special else str(m.special[w]) for w in words])
                    raw = b"".join([decoded[w] if w not in m.special else w.encode() for w in words])
                else:
                    ids = ",".join(map(joined.__getitem__, words))
                    raw = b"".join(map(decoded.__getitem__, words))
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(sha(ids.encode()))
                d.append(sha(raw.decode("utf-8", "replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
