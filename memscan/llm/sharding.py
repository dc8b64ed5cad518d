"""Shards by fixed virtual slots.

A record's key is hashed into one of ``SLOTS`` slots, for ever; a table maps
slots to shards.  The rows and bytes of each slot are aggregated, and
rebalancing edits the map: every shard keeps its largest slots up to the mean
load, and the others go, largest first, to the shard that is least loaded.  So
no shard exceeds the mean by more than one moved slot (or by a slot that alone
is larger than the mean).  Maps are kept as numbered versions: a version is
written once, never changed, and a reader names the version it wants.

What the driver holds is the slot table: at most ``SLOTS`` rows, whatever the
data.  Records are read once, for key, size and checksum, and equal records are
counted before they are shuffled.  Places within a shard come from the counts
of (slot, salt) and running counts within each; the salt is part of the
checksum, so texts under one key are numbered in ``SALTS`` tasks.

Edge cases: a null text has no bytes; a record without key is hashed by its
checksum; rows of one key share a slot, repeated rows get places of their own;
an empty table gives an empty result and leaves the map as it is; extra
columns are not read."""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memscan.llm import common
from memscan.session import checkpoint_root

SLOTS = 8192
SALTS = 16
OVERHEAD = 8        # bytes of a record besides its text


# ---------------------------------------------------------------- maps
@dataclass(frozen=True)
class SlotMap:
    """Shard of every slot, under a version number."""

    shard: np.ndarray           # by slot
    n_shards: int
    version: int = 0

    def _edited(self, shard: np.ndarray, n_shards: int) -> SlotMap:
        return replace(self, shard=shard, n_shards=n_shards, version=self.version + 1)

    def loads(self, size: np.ndarray) -> np.ndarray:
        """Load of every shard for the given size of each slot."""
        out = np.zeros(self.n_shards, np.int64)
        np.add.at(out, self.shard, size)
        return out

    def moved(self, other: SlotMap) -> np.ndarray:
        """Slots that lie elsewhere in ``other``."""
        return np.flatnonzero(self.shard != other.shard)


def initial_map(n_shards: int, n_slots: int = SLOTS) -> SlotMap:
    """Version 0, made before any data are seen: slots dealt in turn."""
    if not 0 < n_shards <= n_slots:
        raise ValueError("there must be at least one slot for each shard")
    return SlotMap(np.arange(n_slots) % n_shards, n_shards)


def _deal(pool: np.ndarray, size: np.ndarray, load: np.ndarray, shard: np.ndarray) -> None:
    """Slots of the pool, largest first, each to the shard of least load."""
    heap = [(int(w), i) for i, w in enumerate(load)]
    heapq.heapify(heap)
    for s in sorted(pool.tolist(), key=lambda s: (-int(size[s]), s)):
        w, i = heap[0]
        shard[s] = i
        heapq.heapreplace(heap, (w + int(size[s]), i))


def rebalance(m: SlotMap, size: np.ndarray) -> SlotMap:
    """The next version: near-equal loads for the given bytes of each slot."""
    whole = int(size.sum())
    shard = m.shard.copy()
    pool, load = [], np.zeros(m.n_shards, np.int64)
    for i in range(m.n_shards):
        own = np.flatnonzero(shard == i)
        own = own[size[own] > 0]
        own = own[np.lexsort((own, -size[own]))]
        keep = np.cumsum(size[own]) * m.n_shards <= whole
        keep[:1] = True
        load[i] = size[own[keep]].sum()
        pool.append(own[~keep])
    _deal(np.concatenate(pool), size, load, shard)
    return m._edited(shard, m.n_shards)


def grow(m: SlotMap, size: np.ndarray) -> SlotMap:
    """The next version, with one shard more: slots move only into that shard,
    from the shards above the new mean, until it holds the mean itself."""
    mean = int(size.sum()) / (m.n_shards + 1)
    load, shard, got = m.loads(size), m.shard.copy(), 0
    for s in sorted(np.flatnonzero(size > 0).tolist(), key=lambda s: (-int(size[s]), s)):
        w, home = int(size[s]), shard[s]
        if got + w <= mean and load[home] - w >= mean - w / 2:
            shard[s], got = m.n_shards, got + w
            load[home] -= w
    # slots without data go along by count, so that rows to come are dealt evenly
    empty = np.flatnonzero(size == 0)
    shard[empty[::m.n_shards + 1]] = m.n_shards
    return m._edited(shard, m.n_shards + 1)


def drain(m: SlotMap, size: np.ndarray, gone: int) -> SlotMap:
    """The next version without slots in shard ``gone``: only they move."""
    shard, load = m.shard.copy(), m.loads(size)
    load[gone] = np.iinfo(np.int64).max // 2
    _deal(np.flatnonzero(shard == gone), np.maximum(size, 1), load, shard)
    return m._edited(shard, m.n_shards)


class MapStore:
    """Versions of a slot map in a shared folder, one Parquet table each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, m: SlotMap) -> None:
        """Write the version; one that exists already is an error, so of two
        editors of the same version only one succeeds."""
        rows = [(s, int(x), m.n_shards) for s, x in enumerate(m.shard)]
        (self.spark.createDataFrame(rows, "slot int, shard int, n_shards int").coalesce(1)
         .write.mode("errorifexists").parquet(f"{self.path}/version={m.version}"))

    def load(self, version: int) -> SlotMap:
        rows = self.spark.read.parquet(f"{self.path}/version={version}").select("slot", "shard", "n_shards").collect()
        shard = np.zeros(len(rows), np.int64)
        for r in rows:
            shard[r.slot] = r.shard
        return SlotMap(shard, rows[0].n_shards, version)

    def versions(self) -> list[int]:
        rows = (self.spark.read.option("basePath", self.path).parquet(self.path)
                .select("version").distinct().orderBy("version").collect())
        return [r.version for r in rows]

    def latest(self) -> SlotMap:
        return self.load(self.versions()[-1])


# ---------------------------------------------------------------- records
def slot_of(key: Column, n_slots: int = SLOTS) -> Column:
    return (F.crc32(key.cast("string").cast("binary")) % n_slots).cast("int")


def records(docs: DataFrame, n_slots: int = SLOTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, salt and the number ``rows`` of
    equal records, a few times for a record that is repeated very often."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
                    F.crc32(body.cast("binary")).alias("text_crc32"))
    d = d.select("*", F.coalesce(slot_of(F.col("doc_id"), n_slots), (F.col("text_crc32") % n_slots).cast("int"))
                 .alias("virtual_slot"), (F.col("text_crc32") % SALTS).cast("int").alias("salt"),
                 (F.spark_partition_id() % SALTS).alias("part"))
    return (d.groupBy("doc_id", "size", "text_crc32", "virtual_slot", "salt", "part")
            .agg(F.count(F.lit(1)).alias("rows")).drop("part"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each (virtual_slot, salt); combined before the shuffle."""
    return recs.groupBy("virtual_slot", "salt").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("size") * F.col("rows")).alias("bytes"))


def slot_bytes(sizes: DataFrame, n_slots: int = SLOTS) -> np.ndarray:
    """Bytes of each slot (at most ``n_slots`` rows come to the driver)."""
    out = np.zeros(n_slots, np.int64)
    for r in sizes.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect():
        out[r.virtual_slot] = r.bytes
    return out


def place(recs: DataFrame, sizes: DataFrame, m: SlotMap) -> DataFrame:
    """Shard and place (``slot``, gapless from 0 in each shard) of every record.

    The table of starts has at most slots * SALTS rows and is broadcast."""
    spark = recs.sparkSession
    table = spark.createDataFrame([(s, int(x)) for s, x in enumerate(m.shard)], "virtual_slot int, shard int")
    by_shard = Window.partitionBy("shard").orderBy("virtual_slot", "salt")
    starts = (sizes.join(F.broadcast(table), "virtual_slot")
              .select("virtual_slot", "salt", "shard", (F.sum("rows").over(by_shard) - F.col("rows")).alias("start")))
    w = (Window.partitionBy("virtual_slot", "salt").orderBy("doc_id", "text_crc32", "size")
         .rowsBetween(Window.unboundedPreceding, 0))
    return (recs.withColumn("upto", F.sum("rows").over(w)).join(F.broadcast(starts), ["virtual_slot", "salt"])
            .withColumn("upto", F.col("start") + F.col("upto"))
            .withColumn("slot", F.explode(F.sequence(F.col("upto") - F.col("rows"), F.col("upto") - 1)))
            .drop("rows", "upto", "start", "salt"))


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = SLOTS, id_col: str = "doc_id", text: str = "text",
                    store: MapStore | None = None) -> DataFrame:
    """Every row's shard, by bytes: version 0 of the map is dealt without data,
    version 1 edited for the bytes found.  With a store that has versions, its
    latest is edited instead."""
    spark = docs.sparkSession
    recs = common.stage(records(docs, n_slots, id_col, text), "shard-records")
    sizes = common.stage(slot_sizes(recs), "shard-sizes")
    if store is None:
        store = MapStore(spark, f"{checkpoint_root(spark).rstrip('/')}/llm/slot-map-{uuid.uuid4().hex}")
        store.save(initial_map(n_shards, n_slots))
    m = store.latest()
    size = slot_bytes(sizes, n_slots)
    if size.any():
        m = rebalance(m, size)
        store.save(m)
    out = place(recs, sizes, store.load(m.version))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).alias("map_version"))


def write_shards(docs: DataFrame, m: SlotMap, path: str, files: int = 4, id_col: str = "doc_id") -> None:
    """Whole rows as Parquet under ``path/shard=i``, each shard in ``files``
    files of neighbouring slots.  For tables whose key is never null."""
    table = docs.sparkSession.createDataFrame([(s, int(x)) for s, x in enumerate(m.shard)], "_slot int, shard int")
    d = docs.withColumn("_slot", slot_of(F.col(id_col), len(m.shard))).join(F.broadcast(table), "_slot")
    (d.repartition(m.n_shards * files, "shard", F.col("_slot") % files).drop("_slot")
     .write.partitionBy("shard").parquet(path))
