"""Repeated byte strings: suffix arrays with common-prefix interval trees.

Every 100-byte window of a text is owned by an anchor, the least-hashed 48-gram
in it (leftmost on ties); windows of one anchor are consecutive and make a
block.  Equal windows have equal anchors, so all occurrences of a window lie
in blocks of one anchor hash.  Only anchors that occur again are followed up:

* equal blocks collapse to their first occurrence (map-side, then by hash);
* the distinct blocks of an anchor go into an enhanced suffix array (prefix
  doubling, common prefixes by rank comparison); a stack scan of its
  common-prefix intervals, tested for diversity of the byte to the left,
  returns maximal repeats with all occurrences;
* an anchor with more than ``VARIANTS`` distinct blocks (or that is frequent
  within a task) does not meet in one task: its blocks are cut anew by longer
  anchors, up to 100 bytes, where a block is one window.

Removal then covers every occurrence of a window but its first (by document,
then position).

Edge cases: null and empty texts have no bytes; texts below 100 bytes are
never touched; matches never cross documents; rows that repeat a doc_id, or
have none, are ordered by text (nulls first), a repeated row counting as a
later document; an empty table gives an empty result; extra columns are not
read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memscan.llm import common
from memscan.llm.common import BYTE_KEY, mix, stage

LENGTH = 100
GRAMS = (48, 80, 100)     # anchor lengths by level; with the last a block is one window
VARIANTS = 512
LOCAL_HOT = 64
FLUSH = 800_000          # blocks a task holds at once
SEGMENT = 8 << 20        # bytes of a text handled at once
_U = np.uint64
_MASK = _U((1 << 24) - 1)


# ---------------------------------------------------------------- blocks
def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position (k a power of two)."""
    h = BYTE_KEY[buf]
    step = 1
    while step < k:
        h = h[:-step] * _U(0x9E3779B97F4A7C15) + mix(h[step:]) if len(h) > step else h[:0]
        step *= 2
    return mix(h)


def gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, from two overlapping powers of two."""
    p = 1 << (k.bit_length() - 1)
    h = rolling(buf, p)
    n = len(buf) - k + 1
    if p == k or n <= 0:
        return h[:max(n, 0)]
    return mix(h[:n] * _U(0xD6E8FEB86659FD93) + h[k - p:k - p + n])


def blocks(buf: np.ndarray, off: np.ndarray, gram: int, length: int = LENGTH):
    """(key, content, row, start, windows) of all blocks of the rows."""
    empty = (np.zeros(0, _U), np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))
    n = len(buf)
    if n < length:
        return empty
    h = gram_hash(buf, gram)
    key = (h & ~_MASK) | np.arange(len(h), dtype=_U)
    span = length - gram + 1                         # grams in a window
    m, w = key, 1
    while 2 * w <= span:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    if w < span:
        d = span - w
        m = np.minimum(m[:-d], m[d:])
    anchor = (m[:n - length + 1] & _MASK).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[:n - length + 1] == row[length - 1:]
    s = np.flatnonzero(inside)
    if not len(s):
        return empty
    p, r = anchor[s], row[s]
    first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (r[1:] != r[:-1])))
    windows = np.diff(np.append(first, len(s)))
    start, anchor = s[first], p[first]
    # content: hash of the first and of the last 100 bytes chained over all windows
    whole = gram_hash(buf, length)
    content = np.add.reduceat(whole[s] * common.powers(int(windows.max()))[np.arange(len(s)) - np.repeat(first, windows)], first)
    r = r[first]
    return h[anchor], mix(content + windows.astype(_U)), r, start - off[r], windows


def text_segments(batches) -> Iterator[tuple]:
    """(buffer, offsets, doc, base) of rows (doc, base, text), texts beyond
    SEGMENT bytes cut into overlapping stretches, so that every window lies in
    exactly one.  base: where the row's bytes begin in the document."""
    for b in common.chunks(batches, "text"):
        buf, off = common.text_buffer(b.column("text"))
        doc, base = b.column("doc").to_numpy(), b.column("base").to_numpy()
        if len(buf) <= SEGMENT:
            yield buf, off, doc, base
            continue
        for r in range(len(doc)):
            x = buf[off[r]:off[r + 1]]
            for at in range(0, max(1, len(x) - LENGTH + 1), SEGMENT):
                part = x[at:at + SEGMENT + LENGTH - 1]
                yield part, np.array([0, len(part)]), doc[r:r + 1], base[r:r + 1] + at


FOUND = "kind string, key long, content long, doc long, start long, windows int"


def _found(kind: str, key, content, doc, start, windows) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
         pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(windows, pa.int32())],
        [x.split()[0] for x in FOUND.split(", ")])


_ENTRY = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("windows", "<i4"), ("mark", "<i4")])


def _ordered(e: np.ndarray):
    """Entries by key, content and place; starts of equal keys and equal blocks."""
    e = e[np.lexsort((e["start"], e["doc"], e["content"], e["key"]))]
    new_key = np.append(True, e["key"][1:] != e["key"][:-1])
    new_block = new_key | np.append(True, e["content"][1:] != e["content"][:-1])
    return e, new_key, new_block


def repeated_blocks(rows: DataFrame, parts: int, gram: int) -> DataFrame:
    """Blocks of rows (doc, base, text) whose anchor occurs again.  kind 'whole': an equal block lies
    earlier; 'variant': first occurrence of a block whose anchor has others;
    'hot': the same for an anchor with too many of them."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            e, new_key, new_block = _ordered(np.concatenate(held))
            again = e[~new_block]
            e, new_key = e[new_block], new_key[new_block]
            first = np.flatnonzero(new_key)
            size = np.diff(np.append(first, len(e)))
            hot = np.repeat(size > LOCAL_HOT, size)
            for rows, part in ((again, -1), (e[hot], -2)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([int(rows["key"][0] % _U(parts))], pa.int32()),
                                                      pa.array([part], pa.int32()), pa.array([rows.tobytes()], pa.binary())],
                                                     ["part", "kind", "entries"])
            mark = hot & new_key
            e["mark"][mark] = 1
            e = e[~hot | mark]
            part = (e["key"] % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            e, part = e[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.zeros(len(some), np.int32)),
                 pa.array([e[cut[p]:cut[p + 1]].tobytes() for p in some], pa.binary())], ["part", "kind", "entries"])

        held, n = [], 0
        for buf, off, doc, base in text_segments(batches):
            key, content, row, start, windows = blocks(buf, off, gram)
            e = np.zeros(len(key), _ENTRY)
            e["key"], e["content"], e["doc"], e["start"], e["windows"] = key, content, doc[row], start + base[row], windows
            held.append(e)
            n += len(e)
            if n > FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        cols = lambda e: (e["key"], e["content"], e["doc"], e["start"], e["windows"])
        for b in batches:
            for kind, raw in zip(b.column("kind").to_pylist(), b.column("entries"), strict=True):
                e = np.frombuffer(raw.as_buffer(), _ENTRY)
                if kind == 0:
                    held.append(e)
                else:
                    yield _found("whole" if kind == -1 else "hot", *map(np.ascontiguousarray, cols(e)))
        if not held:
            return
        e, new_key, new_block = _ordered(np.concatenate(held))
        held.clear()
        first = np.flatnonzero(new_key)
        size = np.diff(np.append(first, len(e)))
        marked = np.repeat(np.maximum.reduceat(e["mark"], first) > 0, size)
        variants = np.repeat(np.add.reduceat(new_block.astype(np.int64), first), size)
        hot = marked | (variants > VARIANTS)
        for kind, pick in (("whole", ~new_block & (e["mark"] == 0)), ("variant", new_block & ~hot & (variants > 1)),
                           ("hot", new_block & hot & (e["mark"] == 0))):
            at = np.flatnonzero(pick)
            for i in range(0, len(at), 200_000):
                yield _found(kind, *map(np.ascontiguousarray, cols(e[at[i:i + 200_000]])))

    return (rows.select("doc", "base", "text").mapInArrow(send, "part int, kind int, entries binary")
            .repartitionById(parts, "part").mapInArrow(gather, FOUND))      # by hash, parts would share a task


# ---------------------------------------------------------------- suffix array
def enhanced_suffix_array(text: np.ndarray, room: np.ndarray, starts: np.ndarray,
                          least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` at ``starts`` in order, each cut after room[i]
    bytes, and the common prefix of each with the one before it (exact from
    ``least`` on, a lower bound below).

    Prefix doubling from 7 bytes; a rank is the place of the first suffix of
    its group, so that only groups still of several suffixes are sorted on."""
    n = len(text)
    pad = np.concatenate([text.astype(_U) + _U(1), np.zeros(8, _U)])
    k = np.zeros(n, _U)
    for i in range(7):      # a cut suffix ranks below its extensions
        k = (k << _U(9)) | np.where(i < room, pad[i:n + i], _U(0))
    order = np.argsort(k)
    first = np.append(True, k[order[1:]] != k[order[:-1]]) if n else np.zeros(0, bool)
    r = np.empty(n, np.int64)
    r[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, width, longest = [(7, r)], 7, int(room.max(initial=0))
    while width < longest:
        active = np.flatnonzero(np.bincount(r, minlength=n)[r] > 1)
        if not len(active):
            break
        nxt = np.zeros(len(active), np.int64)
        more = room[active] > width
        nxt[more] = r[active[more] + width] + 1
        old = r[active]
        by = np.argsort(old * np.int64(n + 2) + nxt)
        o, x = old[by], nxt[by]
        group = np.append(True, o[1:] != o[:-1])
        sub = group | np.append(True, x[1:] != x[:-1])
        at = np.arange(len(by))
        begin = np.maximum.accumulate(np.where(group, at, 0))
        r = r.copy()
        r[active[by]] = o + np.maximum.accumulate(np.where(sub, at, 0)) - begin
        width *= 2
        ranks.append((width, r))
    sa = starts[np.argsort(r[starts], kind="stable")]
    a, b = sa[:-1].copy(), sa[1:].copy()
    limit = np.minimum(room[sa[:-1]], room[sa[1:]])
    lcp = np.zeros(len(a), np.int64)
    for width, q in reversed(ranks):       # equal ranks: the next ``width`` bytes agree
        i = np.flatnonzero(lcp + width <= limit)
        i = i[q[a[i]] == q[b[i]]]
        lcp[i] += width
        a[i] += width
        b[i] += width
    i = np.flatnonzero((lcp < limit) & (lcp + 7 > least))
    while len(i):                           # fewer than 7 bytes are left to compare
        i = i[text[a[i]] == text[b[i]]]
        lcp[i] += 1
        a[i] += 1
        b[i] += 1
        i = i[lcp[i] < limit[i]]
    return sa, np.append(0, lcp) if len(sa) else lcp


def maximal_repeats(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(length, occurrences) of all maximal repeats of at least ``least``.

    Stack scan of the common-prefix intervals; an interval is reported if the
    bytes before its occurrences differ (-1, the edge, differs from all).
    The scan skips the stretches whose common prefix is below ``least``."""
    out: list[tuple[int, np.ndarray]] = []
    deep = lcp >= least
    lo = np.flatnonzero(deep & ~np.append(False, deep[:-1])) if len(lcp) else []
    hi = np.flatnonzero(deep & ~np.append(deep[1:], False)) if len(lcp) else []
    for i0, i1 in zip(lo, hi, strict=True):          # one tree of intervals
        stack: list[tuple[int, int]] = []            # (common prefix, left edge)
        values = lcp[i0:i1 + 1].tolist() + [0]
        for i, v in enumerate(values, i0):
            left = i - 1
            while stack and stack[-1][0] > v:
                depth, left = stack.pop()
                occ = sa[left:i]
                prev = before[occ]
                if (prev < 0).any() or (prev != prev[0]).any():
                    out.append((depth, occ))
            if v and (not stack or stack[-1][0] < v):
                stack.append((v, left))
    return out


def repeats_of_blocks(t: pa.Table) -> pa.Table:
    """Maximal repeats among the blocks of a bucket: group, length, and the
    document and position of every occurrence."""
    order = np.argsort(t.column("key").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    raw, off = common.text_buffer(t.column("bytes"))
    key = t.column("key").to_numpy()
    doc, start = t.column("doc").to_numpy(), t.column("start").to_numpy()
    # blocks of different anchors never match: they are told apart by the anchor's rank
    _, anchor = np.unique(key, return_inverse=True)
    row = np.repeat(np.arange(len(key)), np.diff(off))
    pos = np.arange(len(raw)) - off[row]
    room = np.diff(off)[row] - pos
    windows = np.flatnonzero(room >= LENGTH)
    sa, lcp = enhanced_suffix_array(raw, room, windows, LENGTH)
    # suffixes of one anchor apart, without giving up the order within it
    by = np.argsort(anchor[row[sa]], kind="stable")
    rank = np.empty(len(sa), np.int64)
    rank[by] = np.arange(len(sa))
    sa2 = sa[by]
    cut = np.append(True, anchor[row[sa2[1:]]] != anchor[row[sa2[:-1]]])
    lcp2 = _range_min(lcp, by)
    lcp2[cut] = 0
    before = np.where(pos > 0, np.append(0, raw[:-1]).astype(np.int64), -1)
    g, length, d, s = [], [], [], []
    for i, (n, occ) in enumerate(maximal_repeats(sa2, lcp2, before, LENGTH)):
        g.append(np.full(len(occ), i))
        length.append(np.full(len(occ), n))
        d.append(doc[row[occ]])
        s.append(start[row[occ]] + pos[occ])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    bucket = t.column("bucket")[0].as_py() if t.num_rows else 0
    return pa.table({"bucket": pa.array(np.full(len(cat(g)), bucket), pa.int64()), "grp": pa.array(cat(g), pa.int64()),
                     "length": pa.array(cat(length), pa.int64()), "doc": pa.array(cat(d), pa.int64()),
                     "start": pa.array(cat(s), pa.int64())})


def _range_min(lcp: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Common prefix of neighbours after a stable regrouping of the array:
    the least value between their old places (sparse table)."""
    n = len(lcp)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    table = [lcp]
    while (1 << len(table)) <= n:
        w = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    a, b = by[:-1] + 1, by[1:] + 1                   # least of lcp[a:b]
    up = b > a
    k = np.zeros(n - 1, np.int64)
    k[up] = np.floor(np.log2(b[up] - a[up])).astype(np.int64)
    for j, row in enumerate(table):
        i = np.flatnonzero(up & (k == j))
        out[i + 1] = np.minimum(row[a[i]], row[b[i] - (1 << j)])
    return out


# ---------------------------------------------------------------- operator
def bytes_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, key, doc, base, text) with the bytes of found blocks."""
    wanted = found.groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "start", "windows")).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            buf, off = common.text_buffer(b.column("text"))
            out = [[] for _ in range(5)]
            for r, (doc, items) in enumerate(zip(b.column("doc").to_pylist(), b.column("b").to_pylist(), strict=True)):
                x = buf[off[r]:off[r + 1]]
                for it in items:
                    s = it["start"]
                    for c, v in zip(out, (it["kind"], it["key"], doc, s, x[s:s + it["windows"] + LENGTH - 1].tobytes()), strict=True):
                        c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                             ["kind", "key", "doc", "base", "text"])

    return docs.join(wanted, "doc").select("doc", "text", "b").mapInArrow(
        cut, "kind string, key long, doc long, base long, text binary")


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (doc, text): repeated blocks without each first occurrence
    (doc, start, windows), and maximal repeats among the distinct blocks of an
    anchor (bucket, grp, length, doc, start).

    Blocks of anchors that too many distinct blocks share are cut anew by
    longer anchors, level by level; anchors of 100 bytes are the windows."""
    spark = docs.sparkSession
    rows = docs.select("doc", F.lit(0).cast("long").alias("base"), "text")
    whole, variants = [], []
    for level, gram in enumerate(GRAMS):
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(1, int(size // 25 // FLUSH) + 1, min(common.slots(spark), int(size // (4 << 20)) + 1))
        found = stage(repeated_blocks(rows, parts, gram), f"blocks{level}")
        whole.append(found.filter("kind = 'whole'").select("doc", "start", "windows"))
        open_ = found.filter("kind <> 'whole'")
        if open_.isEmpty():
            break
        pieces = stage(bytes_of(docs, open_), f"pieces{level}")
        variants.append(pieces.filter("kind = 'variant'").select(
            F.xxhash64("key", F.lit(level)).alias("key"), "doc", F.col("base").alias("start"), F.col("text").alias("bytes")))
        rows = pieces.filter("kind = 'hot'").select("doc", "base", "text")
        if rows.isEmpty():
            break
    union = lambda x: x[0] if len(x) == 1 else x[0].unionAll(union(x[1:]))
    if not variants:
        return union(whole), spark.createDataFrame([], "bucket long, grp long, length long, doc long, start long")
    blocks_ = union(variants)
    buckets = max(1, blocks_.count() // 5_000 + 1)
    groups = (blocks_.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "key", "doc", "start", "bytes")
              .groupBy("bucket").applyInArrow(
                  repeats_of_blocks, "bucket long, grp long, length long, doc long, start long"))
    return union(whole), groups


def removable(docs: DataFrame) -> DataFrame:
    """(doc, start, end) of bytes covered by a window that starts earlier."""
    found, groups = find(docs)
    whole = found.select("doc", "start", (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("end"))
    g = stage(groups, "groups")
    first = g.groupBy("bucket", "grp").agg(F.min(F.struct("doc", "start")).alias("first"))
    again = (g.join(first, ["bucket", "grp"]).filter(F.struct("doc", "start") != F.col("first"))
             .select("doc", "start", (F.col("start") + F.col("length")).alias("end")))
    return whole.unionAll(again)


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(start, end, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text not null) with ``_s`` and ``_e``: starts and ends of removable spans."""
    common.prepare(docs.sparkSession)
    cols = docs.columns
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    odd = d.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count() > 0
    if odd:
        d = stage(d.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
                  .withColumn("_doc", F.monotonically_increasing_id()), "numbered")
    else:
        d = d.withColumn("_doc", F.col("doc_id").cast("long"))
    spans = stage(removable(d.select(F.col("_doc").alias("doc"), "text")), "spans")
    spans = spans.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("start").alias("_s"), F.collect_list("end").alias("_e"))
    return d.join(spans, "_doc", "left").select(*cols, "_s", "_e")


def _spans(b: pa.RecordBatch, r: int) -> list[tuple[int, int]]:
    s = b.column("_s")[r]
    return merge_spans(s.values.to_numpy(), b.column("_e")[r].values.to_numpy()) if s.is_valid else []


def _outside(x: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, rest = 0, []
    for i, j in spans:
        rest.append(x[at:i])
        at = j
    return b"".join([*rest, x[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with n_bytes, n_removed, n_spans, ``kept``
    (binary, the remaining bytes) and kept_sha256."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            buf, off = common.text_buffer(b.column("text"))
            n, gone, runs, kept, sha = [], [], [], [], []
            for r in range(b.num_rows):
                x, m = buf[off[r]:off[r + 1]].tobytes(), _spans(b, r)
                y = _outside(x, m)
                n.append(len(x))
                gone.append(len(x) - len(y))
                runs.append(len(m))
                kept.append(y)
                sha.append(hashlib.sha256(y).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removable spans cut out of ``text``, shrunk to whole
    characters; documents left without a word go."""
    cols = docs.columns
    at = cols.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, "text"):
            buf, off = common.text_buffer(b.column("text"))
            out = []
            for r in range(b.num_rows):
                x, m = buf[off[r]:off[r + 1]], _spans(b, r)
                whole = []
                for i, j in m:
                    while i < j and (x[i] & 0xC0) == 0x80:
                        i += 1
                    while j > i and j < len(x) and (x[j] & 0xC0) == 0x80:
                        j -= 1
                    whole.append((i, j))
                t = _outside(x.tobytes(), whole).decode("utf-8")
                out.append(t if t.strip(" \t\n\x0b\x0c\r") else None)
            text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else b.column(c) for i, c in enumerate(cols)], cols).filter(
                text.is_valid())

    return _with_spans(docs).mapInArrow(cut, docs.schema)
