"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest pivots in order, out of a
bounded sample of the data.  Inverted lists hold, for each pair of pivots, the
vectors that have both among their nearest; two vectors that share pivots a, b
(two at least) meet in the list of each such pair.  Lists are dealt in blocks
and compared by matrix product in double precision; a pair of vectors counts
only in the first list that both are in, so every link counts once.

Equal vectors collapse to one class with a weight before the index; their
links are counted, not expanded.  Vectors that are null, zero, or hold null or
non-finite components link with nothing.

Bounds: ``PIVOTS`` pivots, chosen apart from each other out of 8 * PIVOTS rows
(least hash of vec_id); every
row is indexed; lists have no cap: a list of more than ``BLOCK`` vectors is
compared block against block in separate tasks.

Edge cases: a null vec_id is returned without links; rows that repeat a vec_id
are one id with the most links and least component of its vectors; an empty
table gives an empty result; vectors of unequal length never link; extra
columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common
from memscan.llm.common import stage

PIVOTS = 128
APART = 0.6              # largest cosine between two pivots
NEAREST = 6
LEAD = 3                 # a pair of pivots counts if one of them is among the first LEAD
BLOCK = 1024
COSINE = 0.95


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid_vectors(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components, not all zero."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0))


def spread(x: np.ndarray, n: int, apart: float = APART) -> np.ndarray:
    """The first n unit rows that are below cosine ``apart`` to those chosen
    before: a dense group gets one pivot, not a share of them."""
    out: list[np.ndarray] = []
    for v in x:
        if len(out) < n and (not out or (np.stack(out) @ v).max() < apart):
            out.append(v)
    return np.stack(out)


def choose_pivots(classes: DataFrame, n: int = PIVOTS) -> dict[int, np.ndarray]:
    """At most n pivots of a dimension out of 8 n sampled rows (least hash)."""
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(8 * n).select("vec").collect()      # 8 n rows
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["vec"]), []).append(r["vec"])
    return {d: spread(unit_rows(np.array(v, np.float64)), n) for d, v in by.items()}


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int = NEAREST) -> np.ndarray:
    """Ordered nearest pivots of unit rows (ties to the lower number)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :m]


def list_keys(order: np.ndarray, n: int, lead: int = LEAD) -> np.ndarray:
    """Keys of the inverted lists of each row: pairs of its nearest pivots, one
    of them among the first ``lead``; a single pivot stands for itself."""
    m = order.shape[1]
    pairs = [(i, j) for i, j in combinations(range(m), 2) if i < lead] or [(0, 0)]
    a = np.stack([order[:, i] for i, _ in pairs], 1)
    b = np.stack([order[:, j] for _, j in pairs], 1)
    return np.sort(np.minimum(a, b) * np.int64(n) + np.maximum(a, b), 1)


def near_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec: str = "embedding",
                 pivots_n: int = PIVOTS, nearest: int = NEAREST, lead: int = LEAD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = common.prepare(rows.sparkSession)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).alias("vec"))
    good = valid_vectors(rows.filter("vec_id is not null"), "vec")
    classes = stage(good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vecs")
    shared = spark.sparkContext.broadcast(choose_pivots(classes, pivots_n))

    def keys_of(order: np.ndarray, dim: int) -> np.ndarray:
        if order.shape[1] == 0:       # no pivot of this dimension: one list of their own
            return np.full((len(order), 1), -dim, np.int64)
        return list_keys(order, pivots_n, lead) * 65536 + dim % 65536

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            dims = np.array([len(v) for v in b.column("vec")], np.int64)
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = unit_rows(part.column("vec").flatten().to_numpy().astype(np.float64).reshape(-1, d))
                p = pivots.get(int(d))
                order = np.zeros((len(x), 0), np.int64) if p is None else nearest_pivots(x, p, nearest)
                keys = keys_of(order, int(d))
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"), pa.array(list(keys), pa.list_(pa.int64())),
                     pa.array(list(order.astype(np.int16)), pa.list_(pa.int16()))], ["rep", "keys", "near"])

    index = stage(classes.select("rep", "vec").mapInArrow(
        describe, "rep long, keys array<long>, near array<short>"), "index")
    lists = index.select("rep", F.explode("keys").alias("key"))
    # lists of one vector have nothing to compare; long ones are dealt in blocks
    sizes = stage(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                  .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "lists")
    member = (lists.join(sizes, "key")
              .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    # a block meets itself and every other block of its list once: pair (i, j), i <= j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    dealt = (member.select("key", "rep", "block", other)
             .select("key", "rep", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")))
    dealt = dealt.join(index.select("rep", "near").join(classes, "rep"), "rep")

    def compare(t: pa.Table) -> pa.Table:
        key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        block = t.column("block").to_numpy()
        x = unit_rows(t.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(t.num_rows, -1))
        ks = keys_of(t.column("near").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(t.num_rows, -1), x.shape[1])
        rep, w = t.column("rep").to_numpy(), t.column("weight").to_numpy()
        at_i, at_j = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for s in range(0, len(at_i), 512):
            r = at_i[s:s + 512]
            hit = x[r] @ x[at_j].T >= cosine
            p, q = np.nonzero(hit)
            p, q = r[p], at_j[q]
            if i == j:
                up = rep[p] < rep[q]
                p, q = p[up], q[up]
            a.append(p)
            b.append(q)
        a, b = np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int)
        # the pair counts here only if no earlier list holds both
        keep = np.zeros(len(a), bool)
        for s in range(0, len(a), 20_000):
            u, v = ks[a[s:s + 20_000]], ks[b[s:s + 20_000]]
            both = (u[:, :, None] == v[:, None, :]).any(2)
            keep[s:s + 20_000] = np.where(both, u, np.iinfo(np.int64).max).min(1) == key
        a, b = a[keep], b[keep]
        links = np.bincount(a, w[b], len(x)) + np.bincount(b, w[a], len(x))
        # a spanning forest of the links of this block pair is enough for components
        root = np.arange(len(x))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for u, v in zip(a, b, strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        top = np.array([find(k) for k in range(len(x))], np.int64)
        some = links > 0
        return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some].astype(np.int64)),
                         "to": pa.array(rep[top[some]] if some.any() else np.zeros(0, np.int64))})

    found = stage(dealt.groupBy("key", "i", "j").applyInArrow(compare, "rep long, links long, to long"), "links")
    comp = common.components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")).filter("a <> b"), "vcc")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    done = (classes.join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
            .select("vec", F.coalesce("component", "rep").alias("component"),
                    (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n")))
    # rows that repeat an id: the most links, the least component
    per = (good.join(done, "vec").groupBy("vec_id")
           .agg(F.max("n").alias("n"), F.min("component").alias("component")))
    return (rows.select("vec_id").join(per, "vec_id", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")))
