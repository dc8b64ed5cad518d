"""Scores of large inputs: documents as numbers, lookups in packed arrays.

No row for a position is made, written or shuffled.  The documents are taken in
ROUNDS parts, so that only a part's intermediate files lie on disk at a time; of
each part:

  split    documents of a partition are dealt into chunks, each with a list of
           its own distinct words
  number   the words of a chunk meet the vocabulary once each; the texts become
           numbers, and the chunk asks for its contexts and pairs, packed by bucket of the context
  near     a bucket answers from its share of the model: counts of the pairs,
           sizes, moments and top-1 of the contexts
  far      with the top-1 of each context, the chunk asks for the pairs of the
           alternatives
  score    a chunk has all it needs: ten means of each kind for each document

Probabilities follow from the counts, so a pair travels as its numbers and a count
and a context once a chunk.  A chunk holds about CHUNK tokens and a bucket about
BUCKET pairs of the model, whatever the corpus is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..constants import FLOAT_MAX, MIN_LOG_PROB, MIN_SD, MIN_VARIANCE, RATIO_CLIP, Z_CLIP
from ..session import StageStore, by_shuffle
from . import scores as sc
from .lookup import token_stats_by_chunks
from .ngram import BigramModel, Scalars

CHUNK = 4_000_000       # tokens of a chunk, about
ROW = 250_000           # tokens of a packed row, about
BUCKET = 1_000_000      # pairs of the model in a bucket, about
LONGEST = 1_000_000     # tokens of a document that is scored within its chunk
TABLE = 1 << 24         # numbers that are looked up in a table rather than by search
ROUNDS = 4
ROUND_TOKENS = 10_000_000       # a part of the documents is not made smaller than this
KINDS = ("m", "z", "a", "b")


# ---------------------------------------------------------------- packed arrays
def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: bytes of equal weight side by side, compressed."""
    raw = np.array([a.size for a in arrays], np.int64).tobytes()
    raw += b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(a.size, a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes, *types) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * len(types), []
    for n, t in zip(np.frombuffer(raw, np.int64, len(types)).tolist(), map(np.dtype, types), strict=True):
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def _head(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _table(head: bytes) -> pa.Table:
    return pa.ipc.open_stream(head).read_all()


# ---------------------------------------------------------------- the model
MODEL = (np.int64, np.int64, np.int32, np.int64, np.int64, np.float64, np.float64, np.int32, np.float64)
NEAR = (np.int64, np.int64, np.int64, np.float64, np.float64, np.int32, np.float64)
FAR = NEAR[:5]
ASK = (np.int32, np.int64, np.int32)
PACKED_SCHEMA = "chunk long, bucket int, kind int, head binary, blob binary"


def _packed(chunk: list, bucket: list, kind: int, head: list, blob: list) -> pa.Table:
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int32()),
                     "kind": pa.array([kind] * len(blob), pa.int32()), "head": pa.array(head, pa.binary()),
                     "blob": pa.array(blob, pa.binary())})


def packed_model(model: BigramModel, buckets: int) -> DataFrame:
    """(bucket, blob): the seen pairs and the contexts of each bucket, sorted."""
    c = F.col
    bucket = lambda x: F.pmod(c(x), F.lit(buckets)).alias("bucket")
    ids = model.ids.select("tok", "id")
    own = (model.contexts.join(by_shuffle(ids.select(c("tok").alias("ctx"), c("id").alias("ctx_id"))), "ctx")
           .join(by_shuffle(ids.select(c("tok").alias("xhat"), c("id").alias("top"))), "xhat", "left")
           .select(bucket("ctx_id"), "ctx_id", "n_c", "d_c", "mu", "var", F.coalesce("top", F.lit(-1)).alias("top"), "p_xhat"))
    pairs = model.numbered.select(bucket("ctx_id"), "ctx_id", "tok_id", "cnt")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        def column(t: pa.Table, name: str) -> np.ndarray:
            return t.column(name).to_numpy()

        keys = column(left, "ctx_id").astype(np.int64) << 32 | column(left, "tok_id")
        order, at = np.argsort(keys), np.argsort(column(right, "ctx_id"))
        stats = [column(right, k)[at] for k in ("ctx_id", "n_c", "d_c", "mu", "var", "top", "p_xhat")]
        blob = pack(*(x.astype(t, copy=False) for x, t in
                      zip([keys[order], column(left, "cnt")[order], *stats], MODEL, strict=True)))
        return pa.table({"of": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([blob], pa.binary())})

    return pairs.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(run, "of int, model binary")


def answer(asked: DataFrame, model: DataFrame, far: bool) -> DataFrame:
    """The answers (PACKED_SCHEMA) of each bucket to the chunks that ask it."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = []
        if left.num_rows:
            known = [unpack(b, *MODEL) for b in right.column("model").to_pylist()]
            keys, cnt, ctx, *stats = known[0] if known else [np.zeros(0, t) for t in MODEL]
        for asked in left.column("blob").to_pylist():
            of, n, tok = unpack(asked, *ASK)
            want = np.repeat(of.astype(np.int64) << 32, n) | tok
            blobs.append(pack(_found(keys, cnt, want),
                              *[_found(ctx, s, of) for s in (stats[:4] if far else stats)]))
        return _packed(left.column("chunk").to_pylist(), [key[0].as_py()] * len(blobs), 3 if far else 2, [None] * len(blobs), blobs)

    return asked.groupBy("bucket").cogroup(model.groupBy("of")).applyInArrow(run, PACKED_SCHEMA)


def _found(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 for a key that is not there."""
    if not len(keys):
        return np.zeros(len(want), values.dtype)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0).astype(values.dtype, copy=False)


# ---------------------------------------------------------------- documents
def _deal(toks: pa.ListArray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` tokens."""
    ends = np.cumsum(pc.list_value_length(toks).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def split(dt: DataFrame, kept: list[str], partitions: int) -> DataFrame:
    """Packed rows of documents (chunk, head, blob): the columns ``kept`` and the
    tokens as places in the list of the chunk's words; ``words`` are those that
    come first in this row, from place ``base`` on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, n, words = TaskContext.get().partitionId(), 0, 0, pa.array([], pa.string())
        for b in batches:
            toks = b.column(b.schema.get_field_index("toks"))
            for at, end in _deal(toks, ROW):
                docs = toks.slice(at, end - at)
                size = pc.list_value_length(docs).to_numpy(zero_copy_only=False)
                if n and n + size.sum() > CHUNK:
                    count, n, words = count + 1, 0, pa.array([], pa.string())
                n += int(size.sum())
                coded = docs.flatten().cast(pa.string()).dictionary_encode()
                place = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy().copy()
                new, base = place < 0, len(words)
                fresh = coded.dictionary.filter(pa.array(new))
                place[new] = base + np.arange(len(fresh))
                words = pa.concat_arrays([words, fresh])
                codes = place.astype(np.int32)[coded.indices.to_numpy()]
                head = pa.Table.from_batches([b.slice(at, end - at)]).select(kept)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([part << 24 | count], pa.int64()), "head": pa.array([_head(head)], pa.binary()),
                    "blob": pa.array([pack(size.astype(np.int32), codes)], pa.binary()),
                    "base": pa.array([base], pa.int32()), "words": pa.array([fresh.to_pylist()], pa.list_(pa.string()))})

    return dt.select(*kept, "toks").coalesce(partitions).mapInArrow(
        run, "chunk long, head binary, blob binary, base int, words array<string>")


def _blobs(t: pa.Table, *kinds: int) -> pa.Table:
    return t.filter(pc.is_in(t.column("kind"), value_set=pa.array(kinds, pa.int32())))


def _pairs(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keys of the neighbours of each document that the vocabulary has."""
    same = np.repeat(np.arange(len(size)), size)
    ok = (same[1:] == same[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
    return (ids[:-1][ok].astype(np.int64) << 32) | ids[1:][ok]


def _distinct(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, kind), *parts]))


class Request:
    """The distinct contexts and pairs (context << 32 | token, not below 0) of a
    chunk, as its buckets are asked for them."""

    def __init__(self, ctx: np.ndarray, keys: np.ndarray, buckets: int):
        self.buckets, self.ctx, self.keys = buckets, ctx, keys
        self.ctx_of, self.key_of = ctx % buckets, (keys >> 32) % buckets
        self.ctx_order, self.key_order = np.argsort(self.ctx_of, kind="stable"), np.argsort(self.key_of, kind="stable")
        each = np.arange(buckets + 1)
        self.ctx_at = np.searchsorted(self.ctx_of[self.ctx_order], each)
        self.key_at = np.searchsorted(self.key_of[self.key_order], each)

    def part(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.ctx_order[self.ctx_at[bucket]:self.ctx_at[bucket + 1]],
                self.key_order[self.key_at[bucket]:self.key_at[bucket + 1]])

    def asked(self, chunk: int, kind: int) -> pa.Table:
        of, blobs = [], []
        for bucket in range(self.buckets):
            c, k = self.part(bucket)
            if len(c):
                ctx, keys = self.ctx[c], self.keys[k]
                n = np.diff(np.append(np.searchsorted(keys >> 32, ctx), len(keys)))
                of.append(bucket)
                blobs.append(pack(ctx.astype(np.int32), n.astype(np.int64), (keys & 0xFFFFFFFF).astype(np.int32)))
        return _packed([chunk] * len(of), of, kind, [None] * len(of), blobs)

    def answered(self, answers: pa.Table, types: tuple) -> list[np.ndarray]:
        """Counts of the keys, then what is known of the contexts."""
        out = [np.zeros(len(self.keys if not j else self.ctx), t) for j, t in enumerate(types)]
        for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            c, k = self.part(bucket)
            for j, x in enumerate(unpack(blob, *types)):
                out[j][c if j else k] = x
        return out


class Chunk:
    """The documents of a chunk as numbers, -1 for a word that the model has not."""

    def __init__(self, rows: pa.Table, buckets: int):
        docs = _blobs(rows, 0)
        self.heads = docs.column("head").to_pylist()
        self.docs = [unpack(b, np.int32, np.int32) for b in docs.column("blob").to_pylist()]
        self.near = Request(_distinct([np.unique(i[i >= 0]) for _, i in self.docs], np.int32),
                            _distinct([np.unique(_pairs(i, s)) for s, i in self.docs], np.int64), buckets)
        self.context = Places(self.near.ctx)

    def tops(self, stats: list[np.ndarray], top1: int) -> np.ndarray:
        """The top-1 of each context, of an unseen one at the end."""
        return np.append(np.where(stats[1] > 0, stats[5], top1), top1)

    def ask_far(self, tops: np.ndarray, buckets: int) -> Request:
        ctx, keys = [], []
        for size, ids in self.docs:
            hat, x2 = self.far(size, ids, tops)
            ctx.append(np.unique(hat))
            keys.append(np.unique((hat[x2 >= 0].astype(np.int64) << 32) | x2[x2 >= 0]))
        return Request(_distinct(ctx, np.int32), _distinct(keys, np.int64), buckets)

    def far(self, size: np.ndarray, ids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Top-1 and the next token but one, of all positions that have one."""
        doc = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        return tops[self.context[ids[at]]].astype(np.int32), ids[at + 2]


class Places:
    """Of numbers from 0 on: the place among ``keys``, len(keys) where there is none."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.table = keys, None
        if len(keys) and 0 <= keys[0] and keys[-1] < TABLE:
            self.table = np.full(int(keys[-1]) + 3, len(keys), np.int32)    # the last two: beyond and below
            self.table[keys] = np.arange(len(keys))

    def __getitem__(self, want: np.ndarray) -> np.ndarray:
        if self.table is None:
            return _place(self.keys, want)
        return self.table[np.clip(want, -1, len(self.table) - 2)]


def _place(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Place of each wanted key, len(keys) for one that is not there."""
    if not len(keys):
        return np.zeros(len(want), np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, len(keys))


def number(rows: DataFrame, ids: DataFrame, buckets: int) -> DataFrame:
    """Of the rows of ``split``: kind 0 the documents as numbers, 1 what a chunk
    asks of each bucket, 4 the counts of its words."""
    c = F.col
    words = rows.select("chunk", "base", F.posexplode("words").alias("i", "tok"))
    known = (words.select("chunk", (c("base") + c("i")).alias("place"), "tok").join(by_shuffle(ids), "tok")
             .select(c("chunk").alias("of"), "place", "id", "cnt"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        if not left.num_rows:
            return _packed([], [], 0, [], [])
        place, ident, cnt = (right.column(k).to_numpy() for k in ("place", "id", "cnt"))
        docs = [unpack(b, np.int32, np.int32) for b in left.column("blob").to_pylist()]
        number = np.full(1 + max([int(codes.max(initial=-1)) for _, codes in docs] + [int(place.max(initial=-1))]), -1, np.int32)
        number[place] = ident
        coded = _packed([chunk] * len(docs), [0] * len(docs), 0, left.column("head").to_pylist(),
                        [pack(size, number[codes]) for size, codes in docs])
        order = np.argsort(ident)
        counts = _packed([chunk], [0], 4, [None], [pack(ident[order].astype(np.int32), cnt[order].astype(np.int64))])
        return pa.concat_tables([coded, Chunk(coded, buckets).near.asked(chunk, 1), counts])

    return rows.select("chunk", "head", "blob").groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(run, PACKED_SCHEMA)


def ask_far(docs: DataFrame, near: DataFrame, top1: int, buckets: int) -> DataFrame:
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _packed([], [], 1, [], [])
        chunk = Chunk(left, buckets)
        tops = chunk.tops(chunk.near.answered(right, NEAR), top1)
        return chunk.ask_far(tops, buckets).asked(key[0].as_py(), 1)

    return docs.groupBy("chunk").cogroup(near.groupBy("chunk")).applyInArrow(run, PACKED_SCHEMA)


# ---------------------------------------------------------------- values
def _sd(var: np.ndarray) -> np.ndarray:
    var = np.nan_to_num(var, nan=0.0, posinf=FLOAT_MAX, neginf=-FLOAT_MAX)
    return np.maximum(np.sqrt(var), MIN_SD)


Changed = Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]     # of positions and their statistics


def values(x: dict[str, np.ndarray], future: np.ndarray, clip: bool) -> list[np.ndarray]:
    """lp_m, z, r0 and r1 of ``position_values``, with NaN and infinite ratios as
    numbers; in arrays."""
    low = lambda y: np.maximum(y, MIN_LOG_PROB) if clip else y
    with np.errstate(all="ignore"):
        lp_m, mu, var, sd = low(x["lp"]), low(x["mu"]), x["var"], _sd(x["var"])
        z = (lp_m - mu) / (np.sqrt(np.maximum(var, MIN_VARIANCE) if clip else var) + 0.0)
        zo, zx = (lp_m - mu) / sd, (low(x["lp_xhat"]) - mu) / sd
        za = (low(x["lp_next"]) - low(x["mu_next"])) / _sd(x["var_next"])
        zb = (low(x["lp_alt"]) - low(x["mu_alt"])) / _sd(x["var_alt"])
        if clip:
            z, zo, zx, za, zb = (np.clip(y, *Z_CLIP) for y in (z, zo, zx, za, zb))
        use = future if clip else future & np.isfinite(za) & np.isfinite(zb)
        r0 = zo - zx
        r1 = r0 + np.where(use, za - zb, 0.0)
        if clip:
            r0, r1 = np.clip(r0, *RATIO_CLIP), np.clip(r1, *RATIO_CLIP)
    return [lp_m, z, *(np.nan_to_num(r, nan=0.0, posinf=FLOAT_MAX, neginf=-FLOAT_MAX) for r in (r0, r1))]


def document_means(rows: pa.Table, answers: pa.Table, s: Scalars, top1: int, buckets: int, clip: bool,
                   changed: Changed | None = None) -> Iterator[tuple]:
    """Of each packed row of documents: its head, the sums of lp and, of each kind
    of value, ten means a document and where there is none."""
    chunk = Chunk(rows, buckets)
    near = chunk.near.answered(_blobs(answers, 2), NEAR)
    tops = chunk.tops(near, top1)
    ask = chunk.ask_far(tops, buckets)
    far = ask.answered(_blobs(answers, 3), FAR)
    word, cnt = unpack(_blobs(rows, 4).column("blob")[0].as_py(), np.int32, np.int64)
    q_of = np.append((1.0 - s.lam0) * cnt.astype(float) / float(s.N) + s.lam0 / (s.V + 1.0), s.q_unk)

    def context(n_c, d_c, mu, var) -> list[np.ndarray]:
        """n_c, lam, mu, var of each context, of an unseen one at the end."""
        n_c, d_c, seen = (np.append(x, 0) for x in (n_c, d_c, n_c > 0))
        lam = np.where(seen, d_c / np.maximum(n_c + d_c, 1).astype(float), 1.0)
        return [n_c, lam, np.where(seen, np.append(mu, 0), s.M1), np.where(seen, np.append(var, 0), s.var_u)]

    def prob(keys, counts, of, n_c, lam, ctx, x, q) -> np.ndarray:
        key = np.where((ctx >= 0) & (x >= 0), ctx.astype(np.int64) << 32 | x, -1)
        count = np.append(counts, 0)[_place(keys, key)]
        seen = count / np.maximum(n_c[of], 1).astype(float)
        return np.where(count > 0, (1.0 - lam[of]) * seen + lam[of] * q, lam[of] * q)

    n_c, lam, mu, var = context(*near[1:5])
    p_x = np.append(np.where(near[1] > 0, near[6], s.q_top1), s.q_top1)
    h_n, h_lam, h_mu, h_var = context(*far[1:5])
    words, hats = Places(word), Places(ask.ctx)
    for head, (size, ids) in zip(chunk.heads, chunk.docs, strict=True):
        doc = np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)[doc]
        at = np.flatnonzero(np.arange(len(ids)) + 1 < end)
        left = end[at] - at         # tokens from here on: 2 at the last position
        x1, x2 = ids[at + 1], ids[np.minimum(at + 2, len(ids) - 1)]
        of = chunk.context[ids]
        q = q_of[words[ids]]
        o, q2 = of[at], q[np.minimum(at + 2, len(ids) - 1)]
        hat = tops[o].astype(np.int32)
        h = hats[hat]
        with np.errstate(all="ignore"):
            x = {"lp": np.log(prob(chunk.near.keys, near[0], o, n_c, lam, ids[at], x1, q[at + 1])), "mu": mu[o], "var": var[o],
                 "lp_xhat": np.log(p_x[o]), "mu_alt": h_mu[h], "var_alt": h_var[h],
                 "lp_alt": np.log(prob(ask.keys, far[0], h, h_n, h_lam, hat, x2, q2))}
        if changed:
            x = changed(at - (end - size[doc])[at], x)
        # the alternative counts up to the fourth token from the end, so the next position is of the same document
        v = values(x | {f"{k}_next": np.append(x[k][1:], 0.0) for k in ("lp", "mu", "var")}, left >= 4, clip)
        n_pos = size.astype(np.int64) - 1
        starts = np.cumsum(n_pos) - n_pos
        yield head, np.add.reduceat(x["lp"], starts), [sc.means_of_smallest(x, n_pos) for x in v]


def score(docs: DataFrame, answers: DataFrame, kept: StructType, s: Scalars, top1: int, buckets: int, clip: bool,
          changed: Changed | None = None) -> DataFrame:
    """One row a document: the columns ``kept``, tot, m, z, a and b."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*kept, StructField("tot", DoubleType()), *[StructField(k, ArrayType(DoubleType())) for k in KINDS]])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            for head, tot, means in document_means(left, right, s, top1, buckets, clip, changed):
                cols = _table(head).columns
                offsets = pa.array(np.arange(len(tot) + 1, dtype=np.int32) * means[0][0].shape[1])
                lists = [pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), mask=none.ravel())) for m, none in means]
                out.append(pa.table([*cols, pa.array(tot), *lists], names=schema.names))
        return pa.concat_tables(out) if out else to_arrow_schema(schema).empty_table()

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def means_by_rounds(dt: DataFrame, model: BigramModel, extra: list[str], n_tokens: int, store: StageStore,
                    partitions: int, clip: bool = False, changed: Changed | None = None) -> DataFrame:
    """(doc_id, T, *extra, tot, m, z, a, b) of every document of ``dt`` with two
    tokens or more, staged in ``store``; what else is staged there is deleted."""
    spark = dt.sparkSession
    kept = ["doc_id", "T", *extra]
    fields = StructType([dt.schema[k] for k in kept])
    buckets = max(partitions, -(-model.n_bigrams // BUCKET))
    top1 = model.ids.filter(F.col("tok") == model.s.top1).select("id").first()
    top1 = top1[0] if top1 else -1          # the unknown word: no context
    packed = store.put("model", packed_model(model, buckets))
    rounds = max(1, min(ROUNDS, n_tokens // ROUND_TOKENS))
    chunks = max(partitions, -(-n_tokens // rounds // CHUNK))
    dt = dt.filter("T >= 2")
    for r in range(rounds):
        part = dt if rounds == 1 else dt.filter(F.pmod(F.xxhash64("doc_id", "T"), F.lit(rounds)) == r)
        rows = store.put("split", split(part, kept, chunks))
        coded = store.put("numbered", number(rows, model.ids, buckets), partition_by=["kind"])
        store.drop("split")
        docs, asked = coded.filter("kind in (0, 4)"), coded.filter("kind = 1")
        near = store.put("near", answer(asked, packed, False))
        far_asked = store.put("far_asked", ask_far(docs.filter("kind = 0"), near, top1, buckets))
        far = store.put("far", answer(far_asked, packed, True))
        store.drop("far_asked")
        means = store.put(f"means/{r}", score(docs, near.unionByName(far), fields, model.s, top1, buckets, clip, changed))
        for name in ("numbered", "near", "far"):
            store.drop(name)
    store.drop("model")
    return spark.read.schema(means.schema).parquet(*[store.path(f"means/{r}") for r in range(rounds)])


def raw_scores_by_rounds(dt: DataFrame, model: BigramModel, extra: list[str], n_tokens: int, store: StageStore,
                         partitions: int, clip: bool = False, changed: Changed | None = None,
                         changed_rows: Callable[[DataFrame], DataFrame] = lambda ts: ts) -> DataFrame:
    """``scores.raw_scores`` of the documents ``dt`` (doc_tokens rows) straight
    from their tokens.  Documents of more than LONGEST tokens, and those that
    share all their columns and so are scored as one, go by positions.
    ``changed`` (of arrays) and ``changed_rows`` (of token_stats rows) say the
    same of the statistics before they are scored."""
    c = F.col
    keys = ["doc_id", "T", "clen", *extra]
    docs = dt.select(*keys)
    biggest = sc.largest_group(docs)
    out = sc.empty_selection_scores(docs, extra)
    few, rest = dt.filter(c("T") <= LONGEST), dt.filter(c("T") > LONGEST)
    twice = docs.filter("T >= 2").groupBy(*keys).count().filter("count > 1").select(*[c(k).alias(f"{k}_2") for k in keys])
    shared = not twice.isEmpty()
    if shared:
        of = by_shuffle(twice)
        alike = reduce(lambda x, y: x & y, [few[k].eqNullSafe(of[f"{k}_2"]) for k in keys])
        rest = rest.unionByName(few.join(of, alike, "left_semi"))
        few = few.join(of, alike, "left_anti")
    out = sc.scores_of_means(means_by_rounds(few, model, [*extra, "clen"], n_tokens, store, partitions, clip, changed),
                             extra).unionByName(out)
    if shared or biggest >= LONGEST:
        n = rest.agg(F.sum("T")).first()[0] or 0
        ts = token_stats_by_chunks(rest, model, [*extra, "clen"], n, partitions, words=False)
        pv = sc.position_values(changed_rows(ts), clip)
        out = sc._array_scores(pv.filter(c("T") - 1 <= sc.ARRAY_ROWS), extra).unionByName(out)
        if biggest > sc.ARRAY_ROWS:
            out = sc._row_scores(pv.filter(c("T") - 1 > sc.ARRAY_ROWS), extra, sc.SPLIT_ROWS, biggest).unionByName(out)
    return out
