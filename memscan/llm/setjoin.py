"""Similarity self-join on hashed sets, shared by the near-duplicate operators.

Input is a table of signatures: ``id``, ``keys`` (packed 64-bit keys of the
nodes the row starts in) and ``brief`` (one byte of each minwise token).  Rows
of a node are candidates of each other:

* nodes of at most ``LIMIT`` rows are compared exhaustively;
* of larger nodes every row is compared with a pivot; nodes whose rows are then
  one component are done; of the others, those of at most ``BLOCK`` rows are
  compared exhaustively inside a task, which returns only links that join
  components;
* in a node of more rows in which all but at most ``BLOCK`` are one component,
  these others are a smaller node of their own, and each of them is compared
  with the whole component, once for all nodes and trees it meets it in, both
  dealt in blocks;
* the rest branch into child nodes by minwise tokens drawn
  anew from the full sets for each level, and so on until no node is left.
  A pair of similarity 0.75 stays together in more than one child on average,
  so the chance that a start loses it does not grow with the depth.

A signature filter far below the threshold drops most pairs; the rest are
confirmed on full sets.  Keys meet in packed arrays (one row for each task and
part), and a key that is frequent within a task leaves the packed path, so no
group of unbounded size meets in one task."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common
from memscan.llm.common import mix, stage, stage_dealt

LIMIT = 16               # rows of a node that are compared pair by pair
BLOCK = 2048             # rows of a node that one task compares exhaustively
LOCAL_HOT = 64           # rows of a key in one task beyond which they travel singly
STEP = 3                 # minwise tokens a large node branches by at once
FIRST, LATER = 8, 4      # children of a node of the first level and of deeper ones; more than (4/3) ** STEP
FRESH = 64               # minwise tokens a level draws from the full sets
CHUNK = 2 << 20          # bytes of text whose sets are made at once
ENTRIES = 2_000_000      # (key, id) entries of a part
MARK = np.iinfo(np.int64).min
_U = np.uint64


# ---------------------------------------------------------------- signatures
_mult = np.random.default_rng(7).integers(1, 2**62, 256, dtype=np.uint64) * _U(2) + _U(1)

#: for each filled bin (row) and bin to fill (column): its place in the order of
#: the latter, where each bin comes first itself, and its number
_ORDER = np.random.default_rng(23).random((64, 64)).argsort(0) + 1
np.fill_diagonal(_ORDER, 0)
_ORDER = (_ORDER * 64 + np.arange(64)[:, None]).astype(np.uint16)
_TRY = np.sort(_ORDER, 0).astype(np.int64) & 63


def minwise(h: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
    """n minwise tokens (uint32) of each segment of hashes."""
    out = np.empty((len(head), n), np.uint32)
    for c in range(n):
        out[:, c] = np.minimum.reduceat((h * _mult[c]) >> _U(32), head)
    return out


def one_permutation(h: np.ndarray, row: np.ndarray, rows: int, n: int) -> np.ndarray:
    """n (64) minwise tokens of each row from one hash per element: n bins; an
    empty bin takes the first filled one in an order of its own, so that the
    copies in rows of few elements are independent choices."""
    assert n == len(_ORDER)
    mins = np.full(rows * n, 0xFFFFFFFF, np.uint32)
    bins = ((h >> _U(40)) % _U(n)).astype(np.int64)
    np.minimum.at(mins, row * n + bins, (h & _U(0xFFFFFFFF)).astype(np.uint32))
    mins = mins.reshape(rows, n)
    filled = mins != 0xFFFFFFFF
    many = filled.sum(1) > n // 2
    # rows with most bins filled try the order step by step, the others rank their few filled bins
    r, c = np.nonzero(~filled & many[:, None])
    for t in range(1, n):
        if not len(r):
            break
        src = _TRY[t, c]
        ok = filled[r, src]
        mins[r[ok], c[ok]] = mins[r[ok], src[ok]]
        r, c = r[~ok], c[~ok]
    few = np.flatnonzero(~many & filled.any(1))
    for at in range(0, len(few), 2000):
        rows_ = few[at:at + 2000]
        r, c = np.nonzero(filled[rows_])
        head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        src = (np.minimum.reduceat(_ORDER[c], head) & 63).astype(np.int64)
        mins[rows_] = np.take_along_axis(mins[rows_], src, 1)
    return mins


def band_keys(sig: np.ndarray, bands: list[list[int]]) -> np.ndarray:
    """One 64-bit key per row and band."""
    out = np.empty((len(sig), len(bands)), np.uint64)
    for b, cols in enumerate(bands):
        k = np.full(len(sig), b + 1, np.uint64)
        for c in cols:
            k = mix(k * common.BASE + sig[:, c])
        out[:, b] = k
    return out


def brief(sig: np.ndarray) -> np.ndarray:
    return ((sig * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)


def binary_rows(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a binary column."""
    x = np.ascontiguousarray(x)
    w = x.shape[1] * x.itemsize
    off = np.arange(len(x) + 1, dtype=np.int32) * w
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x)])


Sets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
"""A text column as its sets: sorted distinct hashes, concatenated, and sizes."""


def _cut(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    off = np.append(0, np.cumsum(n))
    return [h[off[i]:off[i + 1]] for i in range(len(n))]


# ---------------------------------------------------------------- nodes
def _matrix(col: pa.Array, dtype) -> np.ndarray:
    buf, off = common.text_buffer(col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col)
    n = len(off) - 1
    return np.ascontiguousarray(buf).view(dtype).reshape(n, -1)


def meet(sigs: DataFrame) -> DataFrame:
    """(key, id) of all keys that two ids share."""
    n = sigs.count()
    width = len(sigs.select("keys").head(1)[0]["keys"]) // 8 if n else 1
    parts = max(1, n * width // ENTRIES + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(kk, ii):
            key, ident = _distinct(np.concatenate(kk), np.concatenate(ii))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            hot = np.repeat(size > LOCAL_HOT, size)
            out = []
            if hot.any():
                out.append((int(key[0] % _U(parts)), 1, key[hot].tobytes(), ident[hot].tobytes()))
            # a hot key leaves a mark, so that its rows from other tasks are kept too
            keep = ~hot
            keep[first] = True
            ident = np.where(hot, MARK, ident)[keep]
            key = key[keep]
            part = (key % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, ident, part = key[order], ident[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            out += [(int(p), 0, key[cut[p]:cut[p + 1]].tobytes(), ident[cut[p]:cut[p + 1]].tobytes())
                    for p in np.flatnonzero(np.diff(cut))]
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                ["part", "hot", "keys", "ids"])

        kk, ii, held = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("keys"), np.uint64)
            kk.append(m.ravel())
            ii.append(np.repeat(b.column("id").to_numpy(), m.shape[1]))
            held += m.size
            if held > ENTRIES:
                yield from flush(kk, ii)
                kk, ii, held = [], [], 0
        if kk:
            yield from flush(kk, ii)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kk, ii = [], []
        rows = lambda k, i: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(i)], ["key", "id"])
        for b in batches:
            for hot, k, i in zip(b.column("hot").to_pylist(), b.column("keys"), b.column("ids"), strict=True):
                k, i = np.frombuffer(k.as_buffer(), np.uint64), np.frombuffer(i.as_buffer(), np.int64)
                if hot:
                    yield rows(k, i)
                else:
                    kk.append(k)
                    ii.append(i)
        if not kk:
            return
        key, ident = _distinct(np.concatenate(kk), np.concatenate(ii))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        keep = np.flatnonzero(np.repeat(size > 1, size) & (ident != MARK))
        for at in range(0, len(keep), 200_000):
            yield rows(key[keep[at:at + 200_000]], ident[keep[at:at + 200_000]])

    return (sigs.select("id", "keys").mapInArrow(send, "part int, hot int, keys binary, ids binary")
            .repartitionById(parts, "part").mapInArrow(gather, "key long, id long"))      # by hash, parts would share a task


def _distinct(key: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ident, key))
    key, ident = key[order], ident[order]
    new = np.append(True, (key[1:] != key[:-1]) | (ident[1:] != ident[:-1]))
    return key[new], ident[new]


def fresh_tokens(texts: DataFrame, sets: Sets, level: int) -> DataFrame:
    """id, fresh: FRESH one-byte minwise tokens of full sets, others on each level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text", max_bytes=CHUNK):
            h, n = sets(b.column("text"))
            h = mix(h + _U(level) * common.BASE)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), binary_rows(brief(minwise(h, np.cumsum(n) - n, FRESH)))], ["id", "fresh"])

    return texts.select("id", "text").mapInArrow(run, "id long, fresh binary")


def _estimate(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least the share ``least``."""
    s = sigs.select("id", "brief")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column("x"), np.uint8), _matrix(b.column("y"), np.uint8)
                ok = (x == y).mean(1) >= least
                yield pa.RecordBatch.from_arrays(
                    [b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return (pairs.join(s.select(F.col("id").alias("a"), F.col("brief").alias("x")), "a")
            .join(s.select(F.col("id").alias("b"), F.col("brief").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def confirm(pairs: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full sets.
    ``texts`` (id, text) travel, being smaller than their sets by far; a
    chunk makes the set of each of its texts once."""
    def distinct(ids: pa.Array, text: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        _, first, at = np.unique(ids.to_numpy(), return_index=True, return_inverse=True)
        return _cut(*sets(text.take(pa.array(first)))), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "x", "y", max_bytes=CHUNK):
            xs, i = distinct(b.column("a"), b.column("x"))
            ys, j = distinct(b.column("b"), b.column("y"))
            ok = pa.array([_similar(xs[u], ys[v], percent) for u, v in zip(i, j, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    if len(u) > len(v):
        u, v = v, u
    if not len(u) or 100 * len(u) < percent * len(v):
        return False
    both = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
    return 100 * both >= percent * (len(u) + len(v) - both)


def _alike_rows(x: np.ndarray, i: int, least: float) -> np.ndarray:
    return np.flatnonzero((x[i + 1:] == x[i]).mean(1) >= least) + i + 1


def _others_first(t: pa.Table) -> tuple[pa.Table, int]:
    """Rows outside the largest component first, and how many they are: any
    two rows of different components have one of them."""
    _, at, size = np.unique(t.column("c").to_numpy(), return_inverse=True, return_counts=True)
    own = at == size.argmax()
    return t.take(pa.array(np.argsort(own, kind="stable"))), int(len(own) - own.sum())


def candidates_in_blocks(rows: DataFrame, least: float) -> DataFrame:
    """(key, id, c) of the rows of a node that have a similar signature in
    another component of their node.  rows: key, id, c, brief."""
    def run(t: pa.Table) -> pa.Table:
        t, others = _others_first(t)
        x = _matrix(t.column("brief").combine_chunks(), np.uint8)
        c = t.column("c").to_numpy()
        hit = np.zeros(len(x), bool)
        for i in range(others):
            j = _alike_rows(x, i, least)
            j = j[c[j] != c[i]]
            hit[j] = True
            hit[i] |= len(j) > 0
        return t.select(["key", "id", "c"]).filter(pa.array(hit))

    return rows.groupBy("key").applyInArrow(run, "key long, id long, c long")


def links_in_blocks(rows: DataFrame, sets: Sets, percent: int, least: float) -> DataFrame:
    """Confirmed links between components within nodes, at most one fewer than
    the rows of a node.  rows: key, id, c, brief, text."""
    def run(t: pa.Table) -> pa.Table:
        t, others = _others_first(t)
        x = _matrix(t.column("brief").combine_chunks(), np.uint8)
        ident, c = t.column("id").to_numpy(), t.column("c").to_numpy().copy()
        full = [u for b in common.chunks(t.select(["text"]).to_batches(), "text", max_bytes=CHUNK)
                for u in _cut(*sets(b.column("text")))]
        out = []
        for i in range(others):
            for j in _alike_rows(x, i, least):
                if c[i] != c[j] and _similar(full[i], full[j], percent):
                    out.append((ident[i], ident[j]))
                    c[c == c[j]] = c[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def against_bodies(outside: DataFrame, body: DataFrame, label: DataFrame) -> DataFrame:
    """(key, id, c): blocks in which each row of ``outside`` (top, id) meets each
    row of ``body`` (top, id) of the component that ``top`` belongs to by now,
    unless it has joined it."""
    o = labelled(labelled(outside, label, "top", "g"), label, "id", "c").filter("g <> c").select("g", "id", "c").distinct()
    o = stage(o, "outside")
    b = (labelled(body, label, "top", "g").join(o.select("g").distinct(), "g", "leftsemi")
         .select("g", "id", F.col("g").alias("c")).distinct())
    cut = lambda df, n: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n))
    size = cut(b, "nb").join(cut(o, "no"), "g")
    at = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda df, i, j: (df.join(size, "g").withColumn("i", F.explode(i)).withColumn("j", F.explode(j))
                             .select(F.xxhash64("g", "i", "j").alias("key"), "id", "c"))
    return deal(b, at("nb"), every("no")).unionAll(deal(o, every("nb"), at("no")))


def labelled(rows: DataFrame, label: DataFrame | None, col: str, out: str) -> DataFrame:
    """Adds the component of ``col`` (itself where it has no link yet)."""
    if label is None:
        return rows.withColumn(out, F.col(col))
    lab = label.select(F.col("id").alias(col), F.col("component").alias("_l"))
    return rows.join(lab, col, "left").withColumn(out, F.coalesce("_l", col)).drop("_l")


def merge(label: DataFrame | None, edges: DataFrame, name: str) -> DataFrame | None:
    """Components after new links, from the components before (contracted)."""
    if edges.isEmpty():
        return label
    if label is None:
        return stage(common.components(edges, name), f"{name}-m")
    e = labelled(labelled(edges, label, "a", "ca"), label, "b", "cb")
    comp = common.components(e.select(F.col("ca").alias("a"), F.col("cb").alias("b")), name)
    ids = label.unionAll(comp.select("id", F.col("id").alias("component")).join(label.select("id"), "id", "leftanti"))
    out = stage(labelled(ids.withColumnRenamed("component", "before"), comp.select("id", "component"), "before", "component")
                .select("id", "component"), f"{name}-m")
    common.discard(label, edges)
    return out


def links(sigs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets: Sets,
          percent: int = 75, least: float = 0.45) -> DataFrame:
    """(id, component) of all ids that have a confirmed link.

    sigs may hold an id more than once, with the same signature.  texts_of:
    (id, text) of a table of ids, read once for all ids that meet another;
    sets: the sets of a text column."""
    spark = sigs.sparkSession
    label: DataFrame | None = None
    small: list[DataFrame] = []
    mid: list[DataFrame] = []
    outside: list[DataFrame] = []
    body: list[DataFrame] = []
    nodes = meet(sigs).distinct()
    level = 0
    while True:
        nodes = stage(nodes, f"nodes{level}")
        if level == 0:      # from here on only ids that meet another matter
            met = stage(nodes.select("id").distinct(), "met")
            sigs = stage(sigs.select("id", "brief").join(met, "id", "leftsemi").dropDuplicates(["id"]), "metsigs")
            texts = stage_dealt(texts_of(met), "texts", "id")     # joined by id again and again
        # a pivot by hashed choice, so that the nodes of a group try different ones
        size = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"),
                                        F.min_by("id", F.xxhash64("key", "id")).alias("pivot"))
        sized = stage(nodes.join(size.filter("n > 1"), "key"), f"sized{level}")
        common.discard(nodes)
        small.append(sized.filter(F.col("n") <= LIMIT).select("key", "id"))
        large = sized.filter(F.col("n") > LIMIT)
        if large.isEmpty():
            break
        star = (large.filter("id <> pivot")
                .select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")).distinct())
        if label is not None:
            star = labelled(labelled(star, label, "a", "ca"), label, "b", "cb").filter("ca <> cb").select("a", "b")
        alike = stage(_estimate(star, sigs, least), f"alike{level}")
        if not alike.isEmpty():
            sure = stage(confirm(alike, texts, sets, percent), f"sure{level}")
            common.discard(alike)
            label = merge(label, sure, f"cc{level}")
        # nodes whose rows are one component are done
        mid.append(large.filter(F.col("n") <= BLOCK).select("key", "id"))
        large = large.filter(F.col("n") > BLOCK)
        if large.isEmpty():
            break
        rest = labelled(large, label, "id", "c")
        if label is not None:
            share = (rest.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"))
                     .groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.max("k").alias("k"), F.sum("k").alias("n")))
            rest = rest.join(share.filter("k < n").select("key", "top", (F.col("n") - F.col("k")).alias("m")), "key")
            rest = stage(rest.select("key", "id", "c", "top", "m"), f"open{level}")
            few = rest.filter(F.col("m") <= BLOCK)
            outside.append(few.filter("c <> top").select("top", "id").distinct())
            body.append(few.filter("c = top").select("top", "id").distinct())
            small.append(few.filter((F.col("m") <= LIMIT) & F.expr("m > 1 and c <> top")).select("key", "id"))
            mid.append(few.filter((F.col("m") > LIMIT) & F.expr("c <> top")).select("key", "id"))
            rest = rest.filter(F.col("m") > BLOCK)
            if rest.isEmpty():
                break
        level += 1
        rest = stage(rest.select("key", "id"), f"rest{level}")
        fresh = stage(fresh_tokens(texts.join(rest.select("id").distinct(), "id", "leftsemi"), sets, level), f"fresh{level}")
        child = F.explode(F.array(*map(F.lit, range(FIRST if level == 1 else LATER)))).alias("j")
        byte = lambda i: F.expr(f"substring(fresh, cast(pmod(xxhash64(key, j, {i}), {FRESH}) as int) + 1, 1)")
        nodes = (rest.join(fresh, "id").select("key", "id", "fresh", child)
                 .select(F.xxhash64("key", "j", *map(byte, range(STEP))).alias("key"), "id").distinct())
    groups = (labelled(functools.reduce(DataFrame.unionAll, small), label, "id", "c").groupBy("key")
              .agg(F.sort_array(F.collect_set(F.struct("id", "c"))).alias("m")).select("m").distinct())
    pairs = (groups.select("m", F.explode("m").alias("x"))
             .select("x", F.explode(F.filter("m", lambda y: (y["id"] > F.col("x")["id"]) & (y["c"] != F.col("x")["c"]))).alias("y"))
             .select(F.col("x")["id"].alias("a"), F.col("y")["id"].alias("b")).distinct())
    alike = stage(_estimate(pairs, sigs, least), "pairs")
    label = merge(label, stage(confirm(alike, texts, sets, percent), "links"), "cc")
    common.discard(alike)
    union = lambda tables: functools.reduce(DataFrame.unionAll, tables)
    brief_of = sigs.select("id", "brief")

    def inside(rows: DataFrame, name: str) -> None:
        """Links of all rows (key, id, c) that share a key."""
        nonlocal label
        rows = stage(candidates_in_blocks(rows.join(brief_of, "id"), least), name)
        if not rows.isEmpty():
            found = links_in_blocks(rows.join(brief_of, "id").join(texts, "id"), sets, percent, least)
            label = merge(label, stage(found, f"{name}links"), f"cc{name}")
        common.discard(rows)

    if outside and label is not None:
        inside(against_bodies(union(outside), union(body), label), "body")
    if mid:
        rows = labelled(union(mid), label, "id", "c")
        open_ = rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("key")
        inside(rows.join(open_, "key", "leftsemi"), "block")
    return label if label is not None else spark.createDataFrame([], "id long, component long")
