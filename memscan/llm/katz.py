"""Language-model scores: a bigram model with Katz backoff.

P(w | h) = d(c) c / c(h) for a bigram seen c times in training, else
a(h) P(w); P(w) = d'(c) c / N for a seen word, else the mass that discounting
leaves to the one class of unseen words.  d and d' are Good-Turing discounts
(counts up to ``K``); a(h) is the discounted mass of h divided by the unigram
mass of the words not seen after h, so every distribution sums to one exactly.
A document starts after the end token.

Counts meet in hash-partitioned tables.  Tasks turn texts into blocks of
hashed tokens; each block sends its distinct words, then its distinct bigrams
with their training counts, to the parts, as packed arrays (one row for a
block and part), and gets back, aligned with what it sent, what the model
holds.  Bigrams are dealt by history; histories with more than N / HOT of the
tokens, at most HOT of them, are dealt by bigram instead and their sums added
up separately.  Nothing is sampled; words are 64-bit hashes, of which bigrams
within a part keep 48 bits.

Guards: where counts of counts give no discount in (0, 1], d_r is
1 - b / r with b = n_1 / (n_1 + 2 n_2) (0.5 without counts); a history whose
counts are all undiscounted gives 1 / (c(h) + 1) of its mass to backoff.

Edge cases: null, empty and blank texts are the end token alone; a null doc_id
trains and is not held out; repeated rows count and are scored one by one;
without a training row every score is log10 of the one unseen class (0);
an empty table gives an empty result; extra columns are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memscan.llm import common
from memscan.llm.common import mix, stage

K = 5
HOT = 2048
BLOCK_TOKENS = 1_000_000
PART_WORDS = 1_500_000
PART_PAIRS = 1_500_000
SLICE = 1 << 16          # bigrams whose probabilities are computed at once
_U = np.uint64
END = _U(0x5EED0E0F5EED0E0F)


# ---------------------------------------------------------------- packing
def pack24(x: np.ndarray) -> bytes:
    """Numbers as little-endian byte planes (3 if they fit, else 4 or 8): planes
    compress where whole numbers do not."""
    top = int(x.max()) if len(x) else 0
    width = 3 if top < 1 << 24 else 4 if top < 1 << 32 else 8
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack24(raw) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    width = int(b[0])
    out = np.zeros(((len(b) - 1) // width, 8), np.uint8)
    out[:, :width] = b[1:].reshape(width, -1).T
    return out.view("<i8").ravel()


def pack48(x: np.ndarray) -> bytes:
    """The upper six bytes of hashes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack48(raw) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, 2:] = b
    return out.view("<u8").ravel()


def raw(x) -> memoryview:
    return x.as_buffer()


# ---------------------------------------------------------------- blocks
BLOCKS = "block long, docs binary, held binary, n_tokens binary, words binary, tokens binary, train long, size long"


def tokenize(docs: DataFrame, held: Column) -> DataFrame:
    """Blocks of documents: distinct word hashes (most frequent first) and the
    tokens as positions in them; each document ends with the end token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, h, d, x, n = 0, [], [], [], []

        def emit():
            nonlocal seq
            tok, lens, hold = np.concatenate(h), np.concatenate(n), np.concatenate(x)
            words, at, size = np.unique(tok, return_inverse=True, return_counts=True)
            order = np.argsort(-size, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = [(part << 32) | seq, np.concatenate(d).tobytes(), hold.astype(np.uint8).tobytes(), pack24(lens),
                   words[order].tobytes(), zlib.compress(pack24(place[at]), 1), int(lens[~hold].sum()), len(tok)]
            seq += 1
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)],
                                              [c.split()[0] for c in BLOCKS.split(", ")])

        total = 0
        for b in common.chunks(batches, "text"):
            buf, off = common.text_buffer(b.column("text"))
            starts, ends, count = common.word_spans(buf, off)
            w = common.span_hashes(common.LOWER[buf], starts, ends)
            h.append(np.insert(w, np.cumsum(count), END))
            n.append(count + 1)
            d.append(b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy())
            x.append(b.column("held").to_numpy(zero_copy_only=False).astype(bool))
            total += len(h[-1])
            if total > BLOCK_TOKENS:
                yield emit()
                h, d, x, n, total = [], [], [], [], 0
        if total:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(held, F.lit(False)).alias("held")).mapInArrow(run, BLOCKS)


def _split(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """Positions of each part's entries."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


@dataclass
class Block:
    words: np.ndarray
    tokens: np.ndarray
    lens: np.ndarray
    docs: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch, i: int) -> Block:
        g = lambda c: raw(b.column(c)[i])
        return cls(np.frombuffer(g("words"), _U), unpack24(zlib.decompress(g("tokens"))), unpack24(g("n_tokens")),
                   np.frombuffer(g("docs"), np.int64), np.frombuffer(g("held"), np.uint8).astype(bool))

    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.lens)

    def history(self) -> np.ndarray:
        """Position of the word before each token; the end token at the start."""
        end = int(np.flatnonzero(self.words == END)[0])
        h = np.empty_like(self.tokens)
        h[1:] = self.tokens[:-1]
        h[np.cumsum(self.lens) - self.lens] = end
        return h

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history, word), each token's pair, training counts."""
        n = np.int64(len(self.words))
        key, at = np.unique(self.history() * n + self.tokens, return_inverse=True)
        count = np.bincount(at, self.train(), len(key)).astype(np.int32)
        return (key // n).astype(np.int32), (key % n).astype(np.int32), at.astype(np.int32), count


# ---------------------------------------------------------------- unigrams
SENT = "part int, block long, a binary, b binary, c binary, d binary, e binary"
_STATS = [f"n{r}" for r in range(1, K + 2)]
UNIGRAMS = "block long, part int, counts binary, word long, count long, v long, " + ", ".join(f"{s} long" for s in _STATS)


def _rows(names: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    cols = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[t]) for c, t in cols], [c for c, _ in cols])


def unigrams(blocks: DataFrame, parts: int, hot_count: float) -> DataFrame:
    """For each block and part the training counts of the words it sent; hot
    words; and one row of counts of counts for each part."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = Block.of(b, i)
                count = np.bincount(x.tokens, x.train(), len(x.words)).astype(np.int64)
                yield _rows(SENT, [
                    {"part": p, "block": b.column("block")[i].as_py(), "a": x.words[at].tobytes(), "b": pack24(count[at])}
                    for p, at in enumerate(_split((x.words % _U(parts)).astype(np.int64), parts)) if len(at)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(p, blk, np.frombuffer(raw(a), _U), unpack24(raw(c))) for b in batches
               for p, blk, a, c in zip(*(b.column(k) for k in ("part", "block", "a", "b")), strict=True)]
        for part in {g[0].as_py() for g in got}:
            mine = [g for g in got if g[0].as_py() == part]
            words, at = np.unique(np.concatenate([g[2] for g in mine]), return_inverse=True)
            total = np.bincount(at, np.concatenate([g[3] for g in mine]), len(words)).astype(np.int64)
            cut = np.cumsum([0, *(len(g[2]) for g in mine)])
            for g, lo, hi in zip(mine, cut[:-1], cut[1:], strict=True):
                yield _rows(UNIGRAMS, [{"block": g[1].as_py(), "part": part, "counts": pack24(total[at[lo:hi]])}])
            hot = np.flatnonzero(total > hot_count)
            if len(hot):
                yield _rows(UNIGRAMS, [{"word": int(words[k].view(np.int64)), "count": int(total[k])} for k in hot])
            yield _rows(UNIGRAMS, [{"v": int((total > 0).sum())} | {s: int((total == r).sum()) for r, s in enumerate(_STATS, 1)}])

    return blocks.mapInArrow(send, SENT).select("part", "block", "a", "b").repartitionById(parts, F.col("part").cast("int")).mapInArrow(gather, UNIGRAMS)


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """d_0..d_k (d_0 unused, beyond k: 1) from the counts of counts n_1..n_{k+1}."""
    d = np.ones(k + 1)
    if n[0] <= 0:
        return d
    b = n[0] / (n[0] + 2 * n[1]) if n[1] > 0 else 0.5
    a = (k + 1) * n[k] / n[0]
    for r in range(1, k + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) if n[r - 1] > 0 and a < 1 else -1.0
        d[r] = x if 0 < x <= 1 else 1 - b / r
    return d


@dataclass
class Unigram:
    """Discounted word probabilities by training count."""
    total: int
    d: np.ndarray
    unseen: float

    @classmethod
    def fit(cls, total: int, n: list[int], seen_mass_of=None) -> Unigram:
        d = discounts(n)
        lost = sum((1 - d[r]) * r * n[r - 1] for r in range(1, K + 1))
        if total and lost <= 0:               # no count to discount: one token's share for the unseen
            return cls(total, d * total / (total + 1), 1 / (total + 1))
        return cls(total, d, lost / total if total else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        top = self.d[0] if self.d[0] < 1 else 1.0
        d = np.where(c <= K, self.d[np.minimum(c, K)], top)
        return np.where(c > 0, d * c / max(self.total, 1), self.unseen)


# ---------------------------------------------------------------- bigrams
BIGRAMS = ("block long, part int, counts binary, classes binary, mass binary, history long, "
           + ", ".join(f"{s} long" for s in _STATS) + ", s double")


def bigrams(blocks: DataFrame, parts: int, hot: np.ndarray, uni: Unigram) -> DataFrame:
    """blocks: with the column ``counts`` of word counts.  For each block and
    part the training counts of its bigrams, and for each history sent the
    number of words seen 1..K times after it and the unigram mass of all words
    seen after it.  Hot histories: one such row each and part.  A row without
    block and history holds counts of counts."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = Block.of(b, i)
                c = unpack24(raw(b.column("counts")[i]))
                ph, pw, _, count = x.pairs()
                known = np.flatnonzero(c[ph] > 0)       # after an unknown history nothing was seen
                ph, pw, count = ph[known], pw[known], count[known]
                h = x.words[ph]
                is_hot = np.isin(h, hot)
                part = (mix(np.where(is_hot, h * common.BASE + x.words[pw], h)) % _U(parts)).astype(np.int64)
                out = []
                for p, at in enumerate(_split(part, parts)):
                    if not len(at):
                        continue
                    uh, ih = np.unique(ph[at], return_inverse=True)
                    uw, iw = np.unique(pw[at], return_inverse=True)
                    # histories ascend: their numbers of words stand for them
                    out.append({"part": p, "block": b.column("block")[i].as_py(), "a": pack48(x.words[uh]),
                                "b": pack48(x.words[uw]) + pack24(c[uw]), "c": pack24(np.bincount(ih)), "d": pack24(iw),
                                "e": pack24(count[at])})
                for k in range(0, len(out), 64):
                    yield _rows(SENT, out[k:k + 64])

    hot48 = unpack48(pack48(hot))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for i in range(b.num_rows):
                got.setdefault(b.column("part")[i].as_py(), []).append([b.column(c)[i] for c in ("block", "a", "b", "c", "d", "e")])
        for part, rows in got.items():
            hh, ww, cc, pw = [], [], [], []
            for _, a, wb, ih, iw, e in rows:
                ih, iw = unpack24(raw(ih)), unpack24(raw(iw))
                n = int(iw.max()) + 1
                words, counts = unpack48(raw(wb)[:6 * n]), unpack24(raw(wb)[6 * n:])
                hh.append(np.repeat(unpack48(raw(a)), ih))
                ww.append(words[iw])
                pw.append(counts[iw])
                cc.append(unpack24(raw(e)).astype(np.int32))
            cut = np.cumsum([0, *map(len, hh)])
            h, w, c, cw = (np.concatenate(v) for v in (hh, ww, cc, pw))
            del hh, ww, cc, pw
            order = np.lexsort((w, h))
            hs, ws = h[order], w[order]
            new_h = np.append(True, hs[1:] != hs[:-1])
            new = new_h | np.append(True, ws[1:] != ws[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(c[order], first, dtype=np.int64)    # of each distinct bigram
            count = np.empty(len(h), np.int64)
            count[order] = np.repeat(total, np.diff(np.append(first, len(h))))
            cw = cw[order][first]
            uh = hs[new_h]
            del h, w, c, ws, hs, order, new
            # per history
            own = np.cumsum(new_h)[first] - 1
            n_h = int(own[-1]) + 1
            seen = total > 0
            classes = np.zeros((n_h, K), np.int64)
            for r in range(1, K + 1):
                classes[:, r - 1] = np.bincount(own[total == r], minlength=n_h)
            mass = np.bincount(own[seen], uni.p(cw[seen]), n_h)
            hot_h = np.isin(uh, hot48)
            yield _rows(BIGRAMS, [{s: int((total == r).sum()) for r, s in enumerate(_STATS, 1)}])
            for k in np.flatnonzero(hot_h):
                yield _rows(BIGRAMS, [{"history": int(uh[k].view(np.int64)), "s": float(mass[k])}
                                      | {_STATS[r]: int(classes[k, r]) for r in range(K)}])
            for (blk, a, *_), lo, hi in zip(rows, cut[:-1], cut[1:], strict=True):
                at = np.searchsorted(uh, unpack48(raw(a)))
                yield _rows(BIGRAMS, [{"block": blk.as_py(), "part": part, "counts": pack24(count[lo:hi]),
                                       "classes": pack24(classes[at].T.ravel()), "mass": pack48(mass[at].view(_U))}])

    return blocks.mapInArrow(send, SENT).repartitionById(parts, F.col("part").cast("int")).mapInArrow(gather, BIGRAMS)


# ---------------------------------------------------------------- scoring
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def log_probs(c_pair, c_word, c_hist, classes, mass, d: np.ndarray, uni: Unigram) -> np.ndarray:
    """log10 P(w | h) by backoff, vectorised over bigrams.  classes: words
    seen 1..K times after h; mass: unigram mass of all words seen after it."""
    p_word = uni.p(c_word)
    lost = np.zeros(len(c_pair))
    for r in range(1, K + 1):
        lost += classes[:, r - 1] * r * (1 - d[r])
    left = np.where(lost > 0, lost / np.maximum(c_hist, 1), 1 / (c_hist + 1.0))     # mass for backoff
    scale = np.where(lost > 0, 1.0, c_hist / (c_hist + 1.0))
    seen = scale * np.where(c_pair <= K, d[np.minimum(c_pair, K)], 1.0) * c_pair / np.maximum(c_hist, 1)
    back = np.where(c_hist > 0, left / np.maximum(1 - mass, 1e-15), 1.0) * p_word
    return np.log10(np.where(c_pair > 0, seen, back))


def katz_scores(docs: DataFrame, held: Column) -> DataFrame:
    """Scores of every row of (doc_id, text), learned from rows not held out."""
    spark = common.prepare(docs.sparkSession)
    blocks = stage(tokenize(docs, held), "blocks")
    sums = blocks.agg(F.sum("train").alias("n"), F.sum(F.octet_length("words") / 8).alias("w"),
                      F.sum("size").alias("t"), F.count(F.lit(1)).alias("b")).first()
    total, entries = int(sums["n"] or 0), int(sums["w"] or 0)
    parts = entries // PART_WORDS + 1
    uni_rows = stage(unigrams(blocks, parts, total / HOT), "unigrams")
    stat = lambda df: [int(v or 0) for v in df.agg(*[F.sum(s) for s in _STATS]).first()]
    uni = Unigram.fit(total, stat(uni_rows))
    v = int(uni_rows.agg(F.sum("v")).first()[0] or 0)
    hot_rows = uni_rows.filter("word is not null").select("word", "count").collect()        # at most HOT rows
    hot = np.array(sorted(r["word"] for r in hot_rows), np.int64).view(_U)

    # about one block in a partition, so that an Arrow batch holds few
    spread = max(common.slots(spark), min(int(sums["b"]), 100_000))
    counts = (uni_rows.filter("block is not null").repartition(spread, "block").groupBy("block")
              .agg(F.array_sort(F.collect_list(F.struct("part", "counts"))).alias("u")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts in the order of the block's words."""
        for b in batches:
            for i in range(b.num_rows):
                words = np.frombuffer(raw(b.column("words")[i]), _U)
                c = np.zeros(len(words), np.int64)
                split = _split((words % _U(parts)).astype(np.int64), parts)
                for u in b.column("u")[i]:
                    c[split[u["part"].as_py()]] = unpack24(raw(u["counts"]))
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(k) for k in cols), pa.array([pack24(c)], pa.binary())], [*cols, "counts"])

    cols = ["block", "docs", "held", "n_tokens", "words", "tokens"]
    counted = blocks.repartition(spread, "block").join(counts, "block").select(*cols, "u").mapInArrow(
        align, "block long, docs binary, held binary, n_tokens binary, words binary, tokens binary, counts binary")
    counted = stage(counted, "counted")     # read twice; the blocks and their counts are not needed beside it
    common.discard(blocks, uni_rows)
    tokens = int(sums["t"] or 0)
    big_parts = tokens // PART_PAIRS + 1
    bi_rows = stage(bigrams(counted, big_parts, hot, uni), "bigrams")
    d2 = discounts(stat(bi_rows.filter("history is null")))
    hot_sums = (bi_rows.filter("history is not null").groupBy("history")
                .agg(*[F.sum(s).alias(s) for s in _STATS[:K]], F.sum("s").alias("s")).collect())   # at most HOT rows
    hot_sums = sorted(hot_sums, key=lambda r: np.int64(r["history"]).view(_U))
    hot_keys = np.array([r["history"] for r in hot_sums], np.int64).view(_U)
    hot_classes = np.array([[r[s] for s in _STATS[:K]] for r in hot_sums], np.int64).reshape(-1, K)
    hot_mass = np.array([r["s"] for r in hot_sums], np.float64)
    answers = (bi_rows.filter("block is not null").repartition(spread, "block").groupBy("block")
               .agg(F.collect_list(F.struct("part", "counts", "classes", "mass")).alias("g")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = Block.of(b, i)
                c = unpack24(raw(b.column("counts")[i]))
                ph, pw, at, _ = x.pairs()
                count = np.zeros(len(ph), np.int64)
                classes = np.zeros((len(x.words), K), np.int32)       # by history
                mass = np.zeros(len(x.words))
                known = np.flatnonzero(c[ph] > 0)
                h = x.words[ph[known]]
                is_hot = np.isin(h, hot)
                part = (mix(np.where(is_hot, h * common.BASE + x.words[pw[known]], h)) % _U(big_parts)).astype(np.int64)
                split = _split(part, big_parts)
                for g in (b.column("g")[i] if b.column("g")[i].is_valid else ()):
                    k = known[split[g["part"].as_py()]]
                    count[k] = unpack24(raw(g["counts"]))
                    uh = np.unique(ph[k])
                    classes[uh] = unpack24(raw(g["classes"])).reshape(K, -1).T
                    mass[uh] = unpack48(raw(g["mass"])).view(np.float64)
                if len(hot_keys):
                    short = unpack48(pack48(x.words))
                    k = np.minimum(np.searchsorted(hot_keys, short), len(hot_keys) - 1)
                    mine = np.flatnonzero(hot_keys[k] == short)
                    classes[mine], mass[mine] = hot_classes[k[mine]], hot_mass[k[mine]]
                lp = np.empty(len(ph))
                for lo in range(0, len(ph), SLICE):
                    hs, ws = ph[lo:lo + SLICE], pw[lo:lo + SLICE]
                    lp[lo:lo + SLICE] = log_probs(count[lo:lo + SLICE], c[ws], c[hs], classes[hs], mass[hs], d2, uni)
                head = np.cumsum(x.lens) - x.lens
                cw = c[x.tokens]
                base = np.log10((cw + 1) / (total + 1 * (v + 1)))
                doc = pa.array(x.docs, pa.int64(), mask=x.docs == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(x.held), pa.array(x.lens), pa.array(np.add.reduceat((cw > 0).astype(np.int64), head)),
                     pa.array(np.add.reduceat(base, head)), pa.array(np.add.reduceat(lp[at], head))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = counted.repartition(spread, "block").join(answers, "block", "left").mapInArrow(score, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      "base_score", "score")
