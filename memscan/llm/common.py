"""Shared helpers: stage tables, Arrow text buffers, vectorised word hashes,
distributed connected components."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memscan.session import checkpoint_root, ship_package


# ---------------------------------------------------------------- stages
#: Spark then deletes a query's shuffle files as it ends; the next garbage collection can be a stage too late
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the retry of the tasks that read
    the table, not a recomputation of what made it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    release(spark)
    return _known(spark.read.schema(df.schema).parquet(path), path)


def stage_dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stage`` as a table bucketed by ``key``: joins on it shuffle their other
    side alone, however often the table is read."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    path, table = f"{checkpoint_root(spark).rstrip('/')}/llm/{unique}", f"spark_catalog.default.{unique}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("path", path).bucketBy(slots(spark), key).saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)
    release(spark)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")        # the name alone: its files lie in a folder of ours
    return _known(out, path)


def _known(out: DataFrame, path: str) -> DataFrame:
    _folders[id(out)] = (weakref.ref(out, lambda _, k=id(out): _folders.pop(k, None)), path)
    return out


_folders: dict[int, tuple] = {}      # folder of each staged table that is still referenced


def discard(*tables: DataFrame) -> None:
    """Delete the folders of staged tables whose readers are all written
    themselves; other tables are left alone.  What was made from them is
    durable, so a lost executor never needs them again."""
    for t in tables:
        known = _folders.pop(id(t), None)
        if known and known[0]() is t:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(known[1])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers; AQE on where unset."""
    ship_package(spark)
    return spark


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced
    (its cleaner acts on garbage collection of the driver's JVM)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---------------------------------------------------------------- Arrow text
def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def chunks(batches, *text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``max_bytes`` of the text columns each (one row at least),
    so the memory of vectorised steps does not follow the Arrow batch size."""
    for b in batches:
        if b.num_rows == 0:
            continue
        off = sum(text_buffer(b.column(b.schema.get_field_index(t)))[1] for t in text)
        i = 0
        while i < b.num_rows:
            j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
            j = min(max(j, i + 1), b.num_rows)
            yield b.slice(i, j - i)
            i = j


_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_rng = np.random.default_rng(20240229)
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_pow = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 4096)
        p = np.full(size, BASE, np.uint64)
        p[0] = 1
        _pow = np.multiply.accumulate(p)
    return _pow[:n]


def word_spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of each word (run of bytes that are no separator, by default
    [^\\x20\\x09-\\x0D]+; never across rows) and the number of words of each row."""
    n = len(buf)
    rows = len(off) - 1
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(rows, np.int64)
    word = ~separator[buf]
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(word[:-1], out=before[1:])
    cuts = off[:-1][off[:-1] < n]
    before[cuts] = True
    starts = np.flatnonzero(word & before)
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(word[1:], out=after[:-1])
    ends_at = off[1:][off[1:] > 0] - 1
    after[ends_at] = True
    ends = np.flatnonzero(word & after) + 1
    k = np.searchsorted(starts, off)
    return starts, ends, np.diff(k)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each non-empty byte span (spans ascending, disjoint)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    head = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=head[1:])
    total = int(head[-1] + lens[-1])
    pos = np.arange(total, dtype=np.int64) - np.repeat(head, lens)
    idx = pos + np.repeat(starts, lens)
    vals = BYTE_KEY[buf[idx]] * powers(int(lens.max()))[pos]
    return mix(np.add.reduceat(vals, head) + lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


# ---------------------------------------------------------------- components
def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by contraction, as (id, component) with component
    the smallest id reachable; only ids that have an edge are returned.

    edges: (a, b) long.  Every round hooks each vertex to the neighbour (or
    itself) of least hashed priority and contracts; hashed priorities make the
    number of vertices shrink geometrically also on chains.  All steps are
    joins and aggregations with map-side combine; nothing is collected."""
    spark = edges.sparkSession
    pr = lambda c: F.struct(F.xxhash64(c).alias("p"), c.alias("v"))
    e = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
              .filter("a <> b").distinct(), f"{name}-e0")
    label = None
    hooks = []
    k = 0
    while not e.isEmpty():
        k += 1
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = (both.groupBy(F.col("a").alias("v")).agg(F.min(pr(F.col("b"))).alias("m"))
                .select("v", F.least(F.col("m"), pr(F.col("v")))["v"].alias("to")))
        hook = stage(hook, f"{name}-h{k}")
        hooks.append(hook)
        if label is None:
            label = hook.select(F.col("v").alias("id"), F.col("to").alias("component"))
        else:
            nxt = hook.select(F.col("v").alias("component"), "to")
            label = (label.join(nxt, "component", "left")
                     .select("id", F.coalesce("to", "component").alias("component")))
        ha = hook.select(F.col("v").alias("a"), F.col("to").alias("ta"))
        hb = hook.select(F.col("v").alias("b"), F.col("to").alias("tb"))
        before = e
        e = stage(e.join(ha, "a").join(hb, "b")
                  .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                  .filter("a <> b").distinct(), f"{name}-e{k}")
        discard(before)
    if label is None:
        return spark.createDataFrame([], "id long, component long")
    label = stage(label, f"{name}-l")
    discard(e, *hooks)
    least = label.groupBy("component").agg(F.min("id").alias("least"))
    return label.join(least, "component").select("id", F.col("least").alias("component"))
