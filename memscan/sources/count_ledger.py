"""Versioned n-gram counts of a corpus: documents join or leave the corpus
without a recount of the others.

A batch adds one table of signed pair counts and one of the documents it
touched (id, digest of the tokens, sign).  Each batch is a version; the counts
as of a version are the sums over the batches up to it, from the last snapshot
on.  ``compact`` writes such sums as a snapshot; earlier versions stay readable.

Layout under ``root``: ``data/<folder>/{counts,docs}`` and ``commits/<version>``,
a file that names the folder.  A commit is the exclusive creation of that
file, after the data is complete: a batch that fails before leaves no trace,
one that is run again adds nothing twice, and of two writers one is refused.

Edge cases: documents without an id are not counted; a doc_id that a batch
repeats is refused; a document that is there already is not added, one that is
not there with these tokens is not removed; null or empty token arrays count
as documents without tokens; an empty batch is a version; columns other than
doc_id and toks are not read."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import token_pairs

COUNTS = "ctx string, tok string, cnt long"
DOCS = "doc_id long, digest long, sign int"


class CountLedger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for sub in ("data", "commits"):
            self._fs.mkdirs(self._hadoop.Path(f"{self.root}/{sub}"))

    # ------------------------------------------------------------ versions
    def versions(self) -> list[dict]:
        """Committed versions in order: version, kind (delta, snapshot), folder."""
        rows = self.spark.read.schema("value string").text(f"{self.root}/commits").collect()     # one line a version
        return sorted((json.loads(r["value"]) for r in rows), key=lambda v: v["version"])

    def _commit(self, kind: str, folder: str, version: int) -> int:
        line = json.dumps({"version": version, "kind": kind, "folder": folder})
        path = self._hadoop.Path(f"{self.root}/commits/{version:09d}")
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"version {version} was committed by another writer; run the batch again") from e
        out.write(bytearray(line.encode()))
        out.close()
        return version

    def _parts(self, table: str, as_of: int | None) -> list[str]:
        seen = [v for v in self.versions() if as_of is None or v["version"] <= as_of]
        if as_of is not None and (not seen or seen[-1]["version"] != as_of):
            raise ValueError(f"no version {as_of}")
        start = max((i for i, v in enumerate(seen) if v["kind"] == "snapshot"), default=0)
        return [f"{self.root}/data/{v['folder']}/{table}" for v in seen[start:]]

    def _read(self, table: str, schema: str, as_of: int | None) -> DataFrame:
        paths = self._parts(table, as_of)
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ------------------------------------------------------------ reading
    def counts(self, as_of: int | list[int] | None = None) -> DataFrame:
        """(ctx, tok, cnt): pairs of neighbours; tok is null after a document's last token.
        With a list of versions, (version, ctx, tok, cnt) of all of them in one pass."""
        if isinstance(as_of, list):
            return self._counts_of(as_of)
        pairs = self._read("counts", COUNTS, as_of)
        if len(self._parts("counts", as_of)) > 1:       # one batch or snapshot has a pair once
            pairs = pairs.groupBy("ctx", "tok").agg(F.sum("cnt").alias("cnt"))
        return pairs.filter("cnt <> 0")

    def _counts_of(self, versions: list[int]) -> DataFrame:
        """Each batch is read and shuffled once, whatever the versions it is in."""
        parts = {v: self._parts("counts", v) for v in versions}
        paths = sorted({p for some in parts.values() for p in some})
        if not paths:
            return self.spark.createDataFrame([], f"version long, {COUNTS}")
        read = [self.spark.read.schema(COUNTS).parquet(p).withColumn("part", F.lit(k)) for k, p in enumerate(paths)]
        sums = reduce(DataFrame.unionAll, read).groupBy("ctx", "tok").agg(
            *[F.sum(F.when(F.col("part") == k, F.col("cnt"))).alias(f"p{k}") for k in range(len(paths))])
        zero = F.lit(0).cast("long")
        of = [F.struct(F.lit(v).cast("long").alias("version"),
                       reduce(Column.__add__, [F.coalesce(f"p{paths.index(p)}", zero) for p in some], zero).alias("cnt"))
              for v, some in parts.items()]
        return sums.select("ctx", "tok", F.inline(F.array(*of))).filter("cnt <> 0").select("version", "ctx", "tok", "cnt")

    def documents(self, as_of: int | None = None) -> DataFrame:
        """(doc_id, digest) of the documents that are counted."""
        return (self._read("docs", DOCS, as_of).groupBy("doc_id", "digest").agg(F.sum("sign").alias("s"))
                .filter("s > 0").select("doc_id", "digest"))

    # ------------------------------------------------------------ writing
    @staticmethod
    def _folder(version: int) -> tuple[str, int]:
        return f"{version:09d}-{uuid.uuid4().hex}", version

    def _batch(self, docs: DataFrame, sign: int) -> int:
        rows = (docs.filter("doc_id is not null")
                .select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("toks", F.array().cast("array<string>")).alias("toks"))
                .withColumn("digest", F.xxhash64("toks")))
        if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
            raise ValueError("a batch names a doc_id more than once")
        last = self.versions()
        there = self.documents()
        ids = rows.select("doc_id", "digest")
        touched = ids.join(there.select("doc_id"), "doc_id", "leftanti") if sign > 0 else \
            ids.join(there, ["doc_id", "digest"], "leftsemi")
        # ids are joined without their tokens; the tokens are only where a part of the batch counts
        folder, version = self._folder(last[-1]["version"] + 1 if last else 1)
        touched.withColumn("sign", F.lit(sign).cast("int")).write.parquet(f"{self.root}/data/{folder}/docs")
        touched = self.spark.read.schema(DOCS).parquet(f"{self.root}/data/{folder}/docs")
        if touched.count() != rows.count():
            rows = rows.join(touched.select("doc_id"), "doc_id", "leftsemi")
        counts = (token_pairs(rows).groupBy(F.col("x0").alias("ctx"), F.col("x1").alias("tok"))
                  .agg((F.lit(sign) * F.count(F.lit(1))).cast("long").alias("cnt")))
        counts.write.parquet(f"{self.root}/data/{folder}/counts")
        return self._commit("delta", folder, version)

    def add(self, docs: DataFrame) -> int:
        """Count the documents (doc_id, toks) that are not there yet; the new version."""
        return self._batch(docs, 1)

    def remove(self, docs: DataFrame) -> int:
        """Take documents (doc_id, toks) out again; the new version."""
        return self._batch(docs, -1)

    def compact(self) -> int:
        """A snapshot of the last version, as a version of its own."""
        last = self.versions()
        if not last:
            raise ValueError("nothing to compact")
        top = last[-1]["version"]
        folder, version = self._folder(top + 1)
        self.documents(top).withColumn("sign", F.lit(1)).write.parquet(f"{self.root}/data/{folder}/docs")
        self.counts(top).write.parquet(f"{self.root}/data/{folder}/counts")
        return self._commit("snapshot", folder, version)
