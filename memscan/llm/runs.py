"""Periodic runs of words: internal pattern matching over dyadic blocks.

A run is a stretch of words with smallest period q that no neighbour extends
and that is at least max(MIN_WORDS, MIN_EXPONENT * q) words long.  For the
level k with B = 2^k <= q < 2B, the run holds an aligned block of B words (its
start a multiple of B) that occurs again exactly q words on.  So every block
that is not unique in its text asks for its occurrences in the neighbouring
window of starts [s + B, s + 2B):

* a suffix array of the words, by prefix doubling, keeps the rank of every
  block of 2^k words; the occurrences of a block are an interval of it;
* a wavelet matrix over the suffix array answers range-successor queries: the
  first, second and last occurrence in the window, for all blocks at once;
* up to two occurrences are candidate periods.  Three or more overlap and are
  one arithmetic progression, whose difference d is the block's own period;
  both the block and the progression lie in stretches of period d, and a run
  of period q shifts the end of the one onto the end of the other, so the
  distance of these ends is the only further candidate;
* a candidate is extended to both sides by comparing ranks of halving blocks.

Why the first aligned block of a run suffices: it starts at most B - 1 words
after the run, and s + 2q + B/2 <= start + 4q, so its copy and both ends of the
d-periodic stretches lie inside.  An exponent below 4 is therefore refused.

The work is one pass over the texts, each within a task, with no shuffle; memory is
about 8 * log2(words) bytes for each word of a text, for a slice of texts of
about 1 MB or one longer text.

Edge cases: null, empty and blank texts have no words and no runs; the words are
compared by 64-bit hashes within one text; repeated rows give repeated rows; a
null doc_id is kept; an empty table gives an empty result; extra columns are
not read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common

MIN_WORDS = 6
MIN_EXPONENT = 4
_U = np.uint64


# ---------------------------------------------------------------- suffix array
class BlockRanks:
    """Ranks of all blocks of 2^k words by prefix doubling.

    ``level[k][i]`` is the place of the group of i's block in the suffix array
    ``sa``; equal ranks are equal blocks of one text (a block cut off by the
    end of its text is equal to no other).  ``repeated[k]`` holds the starts
    whose block occurs again with their group sizes."""

    def __init__(self, key: np.ndarray, end: np.ndarray):
        n = len(key)
        self.sa = np.argsort(key)
        self.level: list[np.ndarray] = []
        self.repeated: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(n)
        members, keys = self.sa, key[self.sa]
        rank = np.empty(n, np.int32)
        while len(members):
            first = np.empty(len(keys), bool)
            first[0] = True
            np.not_equal(keys[1:], keys[:-1], out=first[1:])
            heads = np.flatnonzero(first)
            sizes = np.diff(heads, append=len(keys))
            rank = rank.copy()
            rank[members] = np.repeat(at[heads], sizes)
            again = np.repeat(sizes > 1, sizes)
            members, at = members[again], at[again]
            self.level.append(rank)
            self.repeated.append((members, np.repeat(sizes, sizes)[again]))
            if not len(members):
                break
            width = 1 << (len(self.level) - 1)
            nxt = members + width
            inside = nxt < end[members]
            second = np.where(inside, rank[np.minimum(nxt, n - 1)] + 1, 0)
            keys = rank[members].astype(np.int64) * (n + 1) + second
            order = np.argsort(keys)
            members, keys = members[order], keys[order]
            self.sa[at] = members

    def forward(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of equal words from a and from b > a on."""
        a, b, last = a.copy(), b.copy(), len(self.sa) - 1
        start = a.copy()
        for k in range(len(self.level) - 1, -1, -1):
            rank = self.level[k]
            step = ((b < end) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Number of equal words up to and with a and b > a."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.level) - 1, -1, -1):
            rank, back = self.level[k], (1 << k) - 1
            x, y = a - back, b - back
            step = ((x >= begin) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return start - a


class WaveletMatrix:
    """Range counts and range quantiles over a permutation of 0..n-1, for
    arrays of queries at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        v = values
        for b in range(self.bits - 1, -1, -1):
            one = (v >> b) & 1 == 1
            z = np.zeros(len(v) + 1, np.int32)
            np.cumsum(~one, out=z[1:])
            self.zeros.append(z)
            v = np.concatenate([v[~one], v[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less than x."""
        total = np.zeros(len(lo), np.int64)
        for b, z in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, h0 = z[lo], z[hi]
            one = (x >> b) & 1 == 1
            total += np.where(one, h0 - l0, 0)
            lo = np.where(one, z[-1] + lo - l0, l0)
            hi = np.where(one, z[-1] + hi - h0, h0)
        return total

    def quantile(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of [lo, hi) with k smaller ones in it."""
        out = np.zeros(len(lo), np.int64)
        for b, z in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            l0, h0 = z[lo], z[hi]
            one = k >= h0 - l0
            out += one.astype(np.int64) << b
            k = np.where(one, k - (h0 - l0), k)
            lo = np.where(one, z[-1] + lo - l0, l0)
            hi = np.where(one, z[-1] + hi - h0, h0)
        return out


# ---------------------------------------------------------------- runs
def candidates(ranks: BlockRanks, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block start, candidate period) of every aligned block."""
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    wavelet = None
    for k, (members, sizes) in enumerate(ranks.repeated):
        block = 1 << k
        s = members
        take = ((s - begin[s]) % block == 0) & (s + 2 * block <= end[s])
        s, sizes = s[take], sizes[take]
        if not len(s):
            continue
        wavelet = wavelet or WaveletMatrix(ranks.sa)
        lo = ranks.level[k][s].astype(np.int64)
        hi = lo + sizes
        before = wavelet.below(lo, hi, s + block)
        upto = wavelet.below(lo, hi, np.minimum(s + 2 * block, end[s]))
        found = upto - before
        hit = found > 0
        s, lo, hi, before, found = s[hit], lo[hit], hi[hit], before[hit], found[hit]
        first = wavelet.quantile(lo, hi, before)
        last = wavelet.quantile(lo, hi, before + found - 1)
        starts += [s, s]
        periods += [first - s, last - s]
        many = found > 2
        if many.any():
            s, lo, hi, before, first = s[many], lo[many], hi[many], before[many], first[many]
            d = wavelet.quantile(lo, hi, before + 1) - first
            tail = ranks.forward(s, s + d, end[s])
            there = ranks.forward(first, first + d, end[s])
            q = first + there - (s + tail)
            fits = (q >= block) & (q < 2 * block)
            starts.append(s[fits])
            periods.append(q[fits])
    return np.concatenate(starts), np.concatenate(periods)


def word_runs(words: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS,
              min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a slice of texts, by start, then
    period; ``words`` are word hashes, ``counts`` the words of each text.
    Starts and ends count from the first word of the slice."""
    if min_exponent < 4:
        raise ValueError("runs of an exponent below 4 are not found by aligned blocks")
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    stop = np.cumsum(counts)
    begin, end = np.repeat(stop - counts, counts), np.repeat(stop, counts)
    text = np.repeat(np.arange(len(counts)), counts).astype(_U)
    ranks = BlockRanks(common.mix(words + text * common.BASE), end)
    s, q = candidates(ranks, begin, end)
    if not len(s):
        return none, none, none
    start = s - ranks.backward(s - 1, s + q - 1, begin[s])
    stop = s + q + ranks.forward(s, s + q, end[s])
    long = stop - start >= np.maximum(min_words, min_exponent * q)
    start, stop, q = start[long], stop[long], q[long]
    order = np.lexsort((q, stop, start))       # of one stretch, its smallest period
    start, stop, q = start[order], stop[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, q = start[new], stop[new], q[new]
    order = np.lexsort((q, start))
    return start[order], stop[order], q[order]


@dataclass
class Slice:
    """Words and runs of a slice of texts; run and word numbers within a text."""

    ids: list
    data: np.ndarray            # bytes of the texts
    starts: np.ndarray          # of each word, in data
    ends: np.ndarray
    bounds: np.ndarray          # first word of each text, and the end
    runs: tuple[np.ndarray, np.ndarray, np.ndarray]
    run_bounds: np.ndarray      # first run of each text, and the end
    kept: np.ndarray            # words no run repeats

    def text_runs(self, i: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of text i."""
        part = slice(self.run_bounds[i], self.run_bounds[i + 1])
        s, e, q = (x[part] for x in self.runs)
        return list(zip((s - self.bounds[i]).tolist(), (e - s).tolist(), q.tolist(), strict=True))

    def collapsed(self) -> list[bytes]:
        """Each text's kept words, joined by one space."""
        starts, lens = self.starts[self.kept], (self.ends - self.starts)[self.kept] + 1
        head = np.cumsum(lens) - lens
        total = int(lens.sum())
        at = np.repeat(starts - head, lens) + np.arange(total)
        out = self.data[np.minimum(at, max(len(self.data) - 1, 0))] if total else np.zeros(0, np.uint8)
        out[head + lens - 1] = 0x20
        cut = np.append(head, total)[np.append(0, np.cumsum(self.kept))[self.bounds]]
        raw = out.tobytes()
        return [raw[a:max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


Rearrange = Callable[[list, np.ndarray], np.ndarray]


def slices(batches: Iterator[pa.RecordBatch], rearrange: Rearrange | None = None) -> Iterator[Slice]:
    """Runs of the texts of batches (id, t).  ``rearrange(ids, word counts)``
    may name, for each word of the slice, the word to read in its place."""
    for b in common.chunks(batches, "t"):
        data, off = common.text_buffer(b.column(1))
        starts, ends, counts = common.word_spans(data, off)
        hashes = common.span_hashes(data, starts, ends)
        ids = b.column(0).to_pylist()
        if rearrange is not None:
            index = rearrange(ids, counts)
            starts, ends, hashes = starts[index], ends[index], hashes[index]
        bounds = np.append(0, np.cumsum(counts))
        runs = word_runs(hashes, counts)
        s, e, q = runs
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, s + q, 1)
        np.add.at(depth, e, -1)
        yield Slice(ids, data, starts, ends, bounds, runs, np.searchsorted(s, bounds), np.cumsum(depth[:-1]) == 0)


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per run: doc_id, start, length, period (words)."""
    def run(batches):
        for part in slices(batches):
            rows = [(i, *r) for n, i in enumerate(part.ids) for r in part.text_runs(n)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
                                             or [pa.array([], pa.int64())] * 4, ["doc_id", "start", "length", "period"])

    return _texts(docs, id_col, text).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text with each run cut to its first
    period, and the number of words dropped; words are joined by one space."""
    def run(batches):
        for part in slices(batches):
            gone = np.add.reduceat(np.append(~part.kept, False), part.bounds[:-1]) if part.ids else []
            gone = np.where(np.diff(part.bounds) > 0, gone, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.ids, pa.int64()), pa.array([x.decode() for x in part.collapsed()], pa.string()),
                 pa.array(gone, pa.int64())], ["doc_id", "text", "n_dropped"])

    return _texts(docs, id_col, text).mapInArrow(run, "doc_id long, text string, n_dropped long")


DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def run_digests(docs: DataFrame, rearrange: Rearrange | None = None, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per document: the number of runs, the longest run (then the
    first, then that of the smallest period), digests of all runs and of the
    collapsed text."""
    def run(batches):
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for part in slices(batches, rearrange):
            rows = []
            for n, (i, left) in enumerate(zip(part.ids, part.collapsed(), strict=True)):
                found = part.text_runs(n)
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
                rows.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

    return _texts(docs, id_col, text).mapInArrow(run, DIGESTS)
