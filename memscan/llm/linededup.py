"""Fuzzy line dedup by MinHash.

Lines (split at \\n) become sets of ``SHINGLE``-character shingles (a shorter
line is one element).  One-permutation signatures are cut into bands of three
tokens; lines that share a band are candidates, confirmed by exact Jaccard
similarity of at least 0.75 on full sets (see setjoin), and distributed
union-find joins them into components.  Of each component the first line (by
document, then line number) stays.  A pair of similarity 0.75 shares one of
the 10 bands with probability 0.995 to 0.997, lines of few shingles included
(README has the simulated recall by number of shingles), one of 0.85 with 0.9999.

Lines of equal text are one element of all this, named by a 64-bit hash of
their text.

Edge cases: null and empty texts have one empty line; lines without a
character other than white space always stay and match nothing; rows that
repeat a doc_id and its text are one document (its lines stay in each row),
rows of one doc_id with different texts are told apart by text; an empty table
gives an empty result; extra columns pass through drop_repeated_lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common, setjoin
from memscan.llm.common import mix, stage

SHINGLE = 7
BANDS = 10
TOKENS = 64
PERCENT = 75
LEAST = 0.25             # share of equal signature tokens below which pairs are dropped
BLANK = r"^[ \t-\r]*$"
_U = np.uint64
_KEYS = np.random.default_rng(11).integers(1, 2**62, 64, dtype=np.uint64) * _U(2) + _U(1)


def char_shingles(lines: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-character shingles, and how many each line has."""
    n = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, _ = common.text_buffer(lines)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(_U) + _U(1)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    if not len(cp):
        return np.zeros(0, _U), count
    end = np.repeat(np.cumsum(n), n)
    at = np.arange(len(cp))
    h = cp * _KEYS[0]
    for j in range(1, k):
        h[:-j] += cp[j:] * _KEYS[j]
    whole = at + k <= end
    short = np.flatnonzero(n[n > 0] < k)
    if not len(short):
        return mix(h[whole]), count
    first = (np.cumsum(n) - n)[n > 0][short]          # lines that are one element
    size = n[n > 0][short]
    pad = np.concatenate([cp, np.zeros(k, _U)])
    h[first] = sum(np.where(size > j, pad[first + j], _U(0)) * _KEYS[j] for j in range(k))
    whole[first] = True
    return mix(h[whole]), count


def distinct_sets(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each line, concatenated, and counts."""
    h, n = char_shingles(lines)
    off = np.append(0, np.cumsum(n))
    sets = [np.unique(h[off[i]:off[i + 1]]) for i in range(len(n))]
    return np.concatenate([np.zeros(0, _U), *sets]), np.array([len(x) for x in sets], np.int64)


def signatures(lines: DataFrame) -> DataFrame:
    """id, keys, brief of (id, line); a line that a task meets again is left out."""
    spread = TOKENS // 3
    bands = [[b, b + spread, b + 2 * spread] for b in range(0, spread, spread // BANDS)][:BANDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in common.chunks(batches, "line", max_bytes=2 << 20):
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                ids = part.column("id").to_pylist()
                new = [i for i, x in enumerate(ids) if not (x in seen or seen.add(x))]
                if len(seen) > 500_000:
                    seen.clear()
                if not new:
                    continue
                part = part.take(pa.array(new))
                h, n = char_shingles(part.column("line"))
                sig = setjoin.one_permutation(h, np.repeat(np.arange(len(n)), n), len(n), TOKENS)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), setjoin.binary_rows(setjoin.band_keys(sig, bands)),
                     setjoin.binary_rows(setjoin.brief(sig))], ["id", "keys", "brief"])

    return lines.mapInArrow(run, "id long, keys binary, brief binary")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), line_no, line, id (hash of the line)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.select("doc_id", F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
            .withColumn("id", F.xxhash64("line")))


def line_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, t, line_no, n_chars, rep_doc_id, rep_line_no, kept of every line."""
    spark = common.prepare(docs.sparkSession)
    lines = lines_of(docs)
    full = lines.filter(~F.col("line").rlike(BLANK)).select("id", "line")
    sig = stage(signatures(full), "linesig")

    def texts_of(ids: DataFrame) -> DataFrame:
        return full.join(ids, "id", "leftsemi").dropDuplicates(["id"]).withColumnRenamed("line", "text")

    label = setjoin.links(sig, texts_of, distinct_sets, percent, LEAST)
    place = F.struct("doc_id", "t", "line_no")
    narrow = stage(lines.select("doc_id", "t", "line_no", F.length("line").alias("n_chars"), "id",
                                F.col("line").rlike(BLANK).alias("blank")), "lines")
    own = narrow.filter("not blank").groupBy("id").agg(F.min(place).alias("first"))
    own = setjoin.labelled(own, label, "id", "component")
    least = own.groupBy("component").agg(F.min("first").alias("rep"))
    rep = own.join(least, "component").select("id", "rep")
    out = narrow.filter("not blank").join(rep, "id").unionByName(
        narrow.filter("blank").withColumn("rep", place))
    return out.select("doc_id", "t", "line_no", "n_chars", F.col("rep.doc_id").alias("rep_doc_id"),
                      F.col("rep.line_no").alias("rep_line_no"), place.eqNullSafe(F.col("rep")).alias("kept"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with only the first line of each component in ``text``;
    documents left without a line with a word go."""
    cols = docs.columns
    gone = (line_classes(docs.select("doc_id", "text")).filter("not kept").distinct()
            .groupBy("doc_id", "t").agg(F.collect_list("line_no").alias("_gone")))
    d = docs.withColumn("_t", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    j = d.join(gone.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t2"), "_gone"),
               F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_t2")), "left").select(*cols, "_gone")
    at = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            out = []
            for t, g in zip(b.column("text").to_pylist(), b.column("_gone").to_pylist(), strict=True):
                if g:
                    drop = set(g)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop])
                out.append(t if t and t.strip(" \t\n\x0b\x0c\r") else None)
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else b.column(c) for i, c in enumerate(cols)], cols).filter(
                text.is_valid())

    return j.mapInArrow(run, docs.schema)
