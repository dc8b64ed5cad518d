"""Packing token sequences by shortest-pack-first over the length histogram.

Documents become pieces of at most ``capacity`` tokens (cut at multiples of
the capacity, so each id lies in one piece and cuts need no second pass over
the ids).  The histogram of piece lengths, at most ``capacity`` rows, goes to
the driver; lengths are placed longest first, always onto the emptiest pack
that still fits, as counts of packing patterns.  Patterns join back to pieces
by the piece's rank among pieces of its length.

Edge cases: null or empty text is a document of the end id alone; repeated
rows are packed as separate documents; an empty table gives an empty result;
ties of doc_id are ranked arbitrarily, each row once; extra columns are not
read."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memscan.llm import common

CAPACITY = 4096
CACHE_WORDS = 1_500_000
RANK_ROWS = 100_000       # pieces a rank window holds on average at most


# ---------------------------------------------------------------- encoding
class WordEncoder:
    """Ids of texts as little-endian uint32 bytes.  The tokenizer drops white
    space and never joins across it, so each chunk between white space is
    encoded once per worker and reused (bounded cache)."""

    #: white space for str.split() but not for the tokenizer
    ODD = re.compile("[\x1c-\x1f]")
    #: words that may part other words where they encode as one id
    MARKS = ("§", "¤", "|", "~", "#")
    RUN = 256             # words encoded as one text

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.cache: dict[str, bytes] = {}
        alone = ((m, self.tok.encode(m, add_special_tokens=False).ids) for m in self.MARKS)
        self.mark = next(((m, i[0]) for m, i in alone if len(i) == 1), None)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded as texts of ``RUN`` words parted by a mark.  A
        text whose ids hold the mark's id just once between two words is cut
        there; others (a word holds it itself) are encoded word by word."""
        if self.mark is None:
            return self.whole(words)
        mark, mark_id = self.mark
        runs = [words[at:at + self.RUN] for at in range(0, len(words), self.RUN)]
        out: list[bytes] = []
        for run, ids in zip(runs, self.whole([f" {mark} ".join(r) for r in runs]), strict=True):
            at = np.flatnonzero(np.frombuffer(ids, "<u4") == mark_id)
            if len(at) != len(run) - 1:
                out += self.whole(run)
                continue
            at = (4 * at).tolist()
            out += [ids[i:j] for i, j in zip([0, *(i + 4 for i in at)], [*at, len(ids)], strict=True)]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of many texts; their new words are encoded in one batch."""
        out: list[bytes | None] = [None] * len(texts)
        split = {}
        for i, t in enumerate(texts):
            if self.ODD.search(t):
                out[i] = self.whole([t])[0]
            else:
                split[i] = t.split()
        words = set().union(*split.values())
        cache = self.cache
        new = list(words.difference(cache))
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = list(words)
        if len(new) > CACHE_WORDS:      # more words than the cache holds
            cache = {}
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            cache.update(zip(part, self.words(part), strict=True))
        for i, w in split.items():
            out[i] = b"".join(map(cache.__getitem__, w))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY,
                  id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and,
    on request, ``ids`` (array of int)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in common.chunks(batches, "t"):
            out = [[] for _ in range(5 + with_ids)]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s:4 * (s + capacity)]
                    row = (doc, s, len(part) // 4, zlib.crc32(part), n)
                    for c, v in zip(out, row, strict=False):
                        c.append(v)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [pa.array(c, pa.int64()) for c in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols.append(pa.array(out[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


# ---------------------------------------------------------------- packing
def pack_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: [(packs, [(length, times), ...])].

    Each length splits at most one group of packs and opens at most two, so
    there are at most 3 * capacity patterns, whatever the number of pieces."""
    free: list[list[list]] = [[] for _ in range(capacity + 1)]     # by free tokens: [packs, runs]
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        n, f = histogram[length], capacity
        while n > 0:
            while f >= length and not free[f]:
                f -= 1
            if f < length:
                per = capacity // length
                for packs, times in ((n // per, per), (1 if n % per else 0, n % per)):
                    if packs:
                        free[capacity - times * length].append([packs, [(length, times)]])
                n = 0
                continue
            group = free[f].pop()
            take = min(group[0], n)
            if take < group[0]:
                free[f].append([group[0] - take, group[1]])
            runs = group[1]
            if runs[-1][0] == length:
                runs = runs[:-1] + [(length, runs[-1][1] + 1)]
            else:
                runs = [*runs, (length, 1)]
            free[f - length].append([take, runs])
            n -= take
    return [(packs, runs) for groups in free for packs, runs in groups]


def slot_table(patterns) -> dict[str, np.ndarray]:
    """Ranks [lo, hi) of pieces of one length -> packs and offsets."""
    rows, base, seen = [], 0, {}
    for packs, runs in patterns:
        at = 0
        for length, times in runs:
            lo = seen.get(length, 0)
            seen[length] = lo + packs * times
            rows.append((length, lo, base, packs, at))
            at += length * times
        base += packs
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "base", "packs", "offset"), t.T, strict=True))


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: 0.. among pieces of equal length.  Each length is dealt
    over salts, ranked within a salt, and shifted by the salts before, so a
    length that holds most rows is no single task's."""
    spark = pieces.sparkSession
    n = pieces.count()
    salts = max(4, n // RANK_ROWS + 1)
    p = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = (p.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
              .drop("n"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    p = p.withColumn("r", F.row_number().over(w) - 1)
    return (p.join(before, ["length", "salt"])
            .withColumn("rank", F.col("first") + F.col("r")).drop("salt", "first", "r"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, start, length."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}   # <= capacity rows
    slots = spark.sparkContext.broadcast(slot_table(pack_patterns(hist, capacity)))
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    src = ranked(pieces.select(*cols)).select(*cols, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        span = np.int64(1) << np.int64(48)
        key = s["length"] * span + s["lo"]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(key, length * span + rank, side="right") - 1
            r = rank - s["lo"][k]
            seq = s["base"][k] + r % s["packs"][k]
            off = s["offset"][k] + (r // s["packs"][k]) * length
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in cols), pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                [*cols, "sequence_id", "offset"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    common.prepare(docs.sparkSession)
    return pack(common.stage(encode_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
