"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles (words
[^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words the whole sequence is
the one element.  Equal sets are joined first.  One document of each distinct
set enters ``TREES`` independent trees: a tree's first branch is a minwise
token of the set, small nodes are compared exhaustively, large ones branch
again (see setjoin).  A pair of similarity 0.75 meets in the first level of a
tree with probability 0.75, so 12 trees miss it with probability 6e-8; large
nodes branch so often that a start keeps it with probability 0.95 down to depth
4, where none of 50,000 simulated pairs was missed.  Links are confirmed on full
sets; components are found by distributed contraction.

Edge cases: null, empty and blank texts have an empty set and link with
nothing; a null doc_id is left out of links; rows that repeat a doc_id count
as one document that has the links of all its texts (near ones only of the
least text); an empty table gives an empty result; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common, setjoin
from memscan.llm.common import mix, stage
from memscan.session import by_shuffle

SHINGLE = 5
TREES = 12
TOKENS = 64
PERCENT = 75
_U = np.uint64


def shingle_hashes(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and how many each row has (not distinct)."""
    starts, ends, n = common.word_spans(buf, off)
    h = common.span_hashes(common.LOWER[buf], starts, ends)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    if not len(h):
        return np.zeros(0, _U), count
    g = np.zeros(len(h), _U)
    first = np.cumsum(n) - n
    last = np.repeat(first + n, n)                    # end of the row of each word
    at = np.arange(len(h))
    for i in range(k):
        inside = at + i < last
        g = mix(g * common.BASE + np.where(inside, h[np.minimum(at + i, len(h) - 1)], _U(i + 1)))
    keep = (at + k <= last) | ((at == np.repeat(first, n)) & (np.repeat(n, n) < k))
    return g[keep], count


def distinct_sets(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, concatenated, and counts."""
    g, count = shingle_hashes(buf, off, k)
    out, sizes, at = [], np.zeros(len(count), np.int64), 0
    for r, c in enumerate(count):
        if c:
            u = np.unique(g[at:at + c])
            out.append(u)
            sizes[r] = len(u)
            at += c
    return (np.concatenate(out) if out else np.zeros(0, _U)), sizes


def signatures(docs: DataFrame) -> DataFrame:
    """id, n, f1, f2 (set fingerprint), keys, brief of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text", max_bytes=2 << 20):
            h, n = distinct_sets(*common.text_buffer(b.column("text")))
            some = n > 0
            head = (np.cumsum(n) - n)[some]
            f1, f2 = np.zeros(len(n), _U), np.zeros(len(n), _U)
            sig = np.zeros((len(n), TOKENS), np.uint32)
            if len(head):
                f1[some] = np.add.reduceat(mix(h), head)
                f2[some] = np.bitwise_xor.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), head)
                sig[some] = setjoin.minwise(h, head, TOKENS)
            step = TOKENS // TREES
            keys = setjoin.band_keys(sig, [[t * step] for t in range(TREES)])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                 setjoin.binary_rows(keys), setjoin.binary_rows(setjoin.brief(sig))],
                ["id", "n", "f1", "f2", "keys", "brief"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(
        run, "id long, n long, f1 long, f2 long, keys binary, brief binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of (doc_id, text)."""
    common.prepare(docs.sparkSession)
    sig = stage(signatures(docs), "sig")

    def texts_of(ids: DataFrame) -> DataFrame:
        d = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(by_shuffle(ids), "id", "leftsemi")
        return d.groupBy("id").agg(F.min("text").alias("text")) if repeated else d

    def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return distinct_sets(*common.text_buffer(texts))

    full = sig.filter("n > 0 and id is not null")
    classes = stage(full.groupBy("n", "f1", "f2").agg(F.min("id").alias("rep")), "classes")
    repeated = full.groupBy("id").count().filter("count > 1").limit(1).count() > 0
    reps = full.join(classes.select(F.col("rep").alias("id"), "n", "f1", "f2"), ["id", "n", "f1", "f2"], "leftsemi")
    reps = stage((reps.dropDuplicates(["id"]) if repeated else reps).select("id", "keys", "brief"), "reps")
    comp = setjoin.links(reps, texts_of, sets, percent)
    if repeated:     # one id with several sets ties their classes together
        tie = full.join(classes, ["n", "f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        comp = common.components(tie.unionAll(comp.select("id", "component")), "tie")
    by_class = (classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
                .select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id")))
    out = sig.select("id", "n", "f1", "f2").join(by_class, ["n", "f1", "f2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "id").alias("component_id"),
                      F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (any
    one row where rows repeat it); rows without a doc_id stay."""
    cols = docs.columns
    gone = near_duplicates(docs.select("doc_id", "text"), percent).filter("not kept").select(F.col("doc_id").alias("_id")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_id"), "leftanti")
    again = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    if again:
        left = left.filter("doc_id is null").unionAll(left.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    return left.select(*cols)
