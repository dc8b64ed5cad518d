"""Merkle manifest of a dataset: a content-addressed tree, read from its root.

Every row is a leaf, the digest of its columns.  The leaves of a source, by id,
and the subroots of all sources, by source, are joined into trees of fan-out
16 by ``build``, which keeps them as records (digest, children): a
record is found by its content, whatever tree or place it comes from, and equal
subtrees are one record.

``paths`` answers requests for leaves by descending: a request is a tree and
the rank of a leaf, whose base-16 digits name the child at each level.  From
the root, every step joins the nodes reached with the records on their
digest, keeps the children that lie on the way to a requested leaf and adds
the children not taken, left and right of it, to the node's path.  Requests
that share their first digits travel as one node, so the root is looked up
once and not once a leaf; the leaves of the last run read their node's path in
place.  Reversed, the segments of a path are the proof of its leaf.

The leaves are ranked by a range sort and prefix sums of the (task, source) counts,
so a source that holds most rows is dealt over all tasks; no window or group holds
more than one run of 16, except windows over those counts.

Edge cases: nulls in any column are leaves of their own form (null is not
empty), null sources make the first tree; rows of one id are ordered by leaf
digest, repeated rows are leaves of their own; a single leaf is its own
subroot, a single subroot the root; an empty table gives an empty result;
extra columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memscan.llm import common

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------- digests
def field(c: Column) -> Column:
    """``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(parts: Column) -> Column:
    """sha256 of a text, as 32 bytes."""
    return F.unhex(F.sha2(parts, 256))


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c))


def joined(digests: Column) -> Column:
    """Digests of an array as one hex text."""
    return F.concat_ws("", F.transform(digests, hex_of))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


# ---------------------------------------------------------------- ranks
def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` from 0 in each ``tree``, by ``order``.

    Rows are dealt by range of (tree, order); within the written table each
    row keeps the number of its task and its place there."""
    at = F.monotonically_increasing_id()
    # ties are dealt too: `_tie` tells equal rows apart in the range bounds
    keys = [tree, *order, "_tie"]
    cut = common.stage(rows.withColumn("_tie", at).repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .drop("_tie").withColumn("_at", at), f"{name}-sorted")
    cut = cut.withColumn("_task", F.shiftright("_at", 33))
    w = Window.partitionBy(tree).orderBy("_task")
    starts = (cut.groupBy(tree, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
              .select(F.col(tree).alias("_tree"), F.col("_task").alias("_t"), "_first",
                      (F.sum("_n").over(w) - F.col("_n")).alias("_before")))
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_task") == F.col("_t"))
    return (cut.join(starts, same).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_task", "_at", "_tree", "_t", "_first", "_before"))


# ---------------------------------------------------------------- build
def runs(nodes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Runs of 16 consecutive nodes (tree, rank, digest) as their parents:
    tree, rank, digest, children, and ``members``: rank, digest, ``keep``."""
    one = F.struct("rank", "digest", *keep)
    g = (nodes.groupBy("tree", F.floor(F.col("rank") / FANOUT).alias("run"))
         .agg(F.sort_array(F.collect_list(one)).alias("members")))
    g = g.withColumn("children", F.transform("members", lambda m: m["digest"]))
    return g.select("tree", F.col("run").alias("rank"), digest(joined(F.col("children"))).alias("digest"),
                    "children", "members")


@dataclass
class Forest:
    """Trees of one kind."""

    roots: DataFrame        # tree, digest, height, leaves
    records: DataFrame      # digest, children
    lowest: DataFrame       # tree, rank, members: the runs of leaves
    height: int             # of the tallest tree


def build(leaves: DataFrame, keep: list[str], name: str) -> Forest:
    """Trees over ranked leaves (tree, rank, digest and the columns ``keep``)."""
    sizes = common.stage(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves")), f"{name}-sizes")
    tallest = sizes.agg(F.max("leaves")).first()[0] or 0
    lowest = common.stage(runs(leaves, keep), f"{name}-runs1")
    # the run of a tree's only leaf is no node
    records = [lowest.filter((F.size("children") > 1) | (F.col("rank") > 0)).select("digest", "children")]
    tops = [lowest.filter("rank = 0").select("tree", F.lit(1).alias("level"), "digest")]
    nodes, height, width = lowest.select("tree", "rank", "digest"), 1, -(-tallest // FANOUT)
    while width > 1:
        height += 1
        more = sizes.filter(F.col("leaves") > FANOUT ** (height - 1)).select("tree")
        up = common.stage(runs(nodes.join(more, "tree", "left_semi")).drop("members"), f"{name}-runs{height}")
        records.append(up.select("digest", "children"))
        tops.append(up.filter("rank = 0").select("tree", F.lit(height).alias("level"), "digest"))
        nodes, width = up.select("tree", "rank", "digest"), -(-width // FANOUT)
    level = F.lit(0)
    for h in range(1, height + 1):
        level = F.when(F.col("leaves") > FANOUT ** (h - 1), F.lit(h)).otherwise(level)
    all_tops = lowest.filter("rank = 0").select(
        "tree", F.lit(0).alias("level"), F.element_at("children", 1).alias("digest"))
    for t in tops:
        all_tops = all_tops.unionByName(t)
    roots = (sizes.withColumn("level", level).join(all_tops, ["tree", "level"])
             .select("tree", "digest", F.col("level").alias("height"), "leaves"))
    every = records[0]
    for r in records[1:]:
        every = every.unionByName(r)
    every = common.stage(every.dropDuplicates(["digest"]), f"{name}-records")
    return Forest(common.stage(roots, f"{name}-roots"), every, lowest, height)


# ---------------------------------------------------------------- descent
PATH = "array<struct<before:array<binary>,after:array<binary>>>"     # a segment for each level


def descend(forest: Forest, starts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """Nodes above requested leaves' runs, reached from the roots.

    starts: tree, digest, height, path (segments gathered so far, from the root
    on).  wanted: the distinct (tree, run) of requests, a run being a rank
    without its last digit.  Returns tree, run, height, path and the digest
    reached at the level above the leaves."""
    at = starts.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "height", "path")
    down = None
    for h in range(forest.height, 1, -1):
        here = at.filter(F.col("height") == h).select("tree", "rank", "digest", "path")
        if down is not None:
            here = here.unionByName(down)
        need = wanted.select("tree", F.floor(F.col("run") / FANOUT ** (h - 2)).alias("rank")).distinct()
        child = F.posexplode("children").alias("digit", "child")
        down = (here.join(forest.records, "digest")
                .select("tree", "rank", "path", "children", child)
                .select("tree", (F.col("rank") * FANOUT + F.col("digit")).alias("rank"), F.col("child").alias("digest"),
                        F.concat("path", F.array(F.struct(
                            F.slice("children", F.lit(1), F.col("digit")).alias("before"),
                            F.slice("children", F.col("digit") + 2, F.lit(FANOUT)).alias("after")))).alias("path"))
                .join(need, ["tree", "rank"], "left_semi"))
        down = common.stage(down, f"{name}-level{h - 1}")
    low = at.filter(F.col("height") <= 1).select("tree", "rank", "digest", "height", "path")
    if down is not None:
        low = low.unionByName(down.select("tree", "rank", "digest", F.lit(1).alias("height"), "path"))
    return low.join(wanted.select("tree", F.col("run").alias("rank")), ["tree", "rank"], "left_semi")


def leaf_paths(forest: Forest, starts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """tree, height, path, children (of the last node; the leaf alone for a
    tree of one leaf) and members of each requested run."""
    nodes = descend(forest, starts, wanted, name)
    records = forest.records.withColumnRenamed("children", "kids")
    last = nodes.join(records, "digest", "left").select("tree", "rank", "height", "path", "digest", "kids")
    last = last.withColumn("children", F.when(F.col("height") == 0, F.array("digest")).otherwise(F.col("kids"))).drop("kids")
    return last.join(forest.lowest.select("tree", "rank", "members"), ["tree", "rank"])


def with_segment(path: Column, children: Column, digit: Column, height: Column) -> Column:
    """The path of a leaf, root first: the last node's children not taken are
    its last segment (a tree of one leaf has no node)."""
    own = F.struct(F.slice(children, F.lit(1), digit).alias("before"),
                   F.slice(children, digit + 2, F.lit(FANOUT)).alias("after"))
    return F.when(height == 0, path).otherwise(F.concat(path, F.array(own)))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (leaf first) lead to."""
    return F.aggregate(proof, leaf, lambda d, s: digest(
        F.concat(joined(s["before"]), hex_of(d), joined(s["after"]))))


def proof_digest(proof: Column) -> Column:
    """Hex sha256 of the siblings, level by level, left to right."""
    parts = F.transform(proof, lambda s: F.concat(joined(s["before"]), joined(s["after"])))
    return F.sha2(F.concat_ws("", parts), 256)


# ---------------------------------------------------------------- manifest
@dataclass
class Manifest:
    sources: Forest         # tree: number of the source
    top: Forest             # one tree over the subroots
    names: DataFrame        # tree, source
    root: bytes | None      # None for an empty table


def leaf_rows(docs: DataFrame, extra: dict[str, Column] | None = None, id_col: str = "doc_id", source: str = "source",
              fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, source, digest of each row, and further columns."""
    extra = extra or {}
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"),
                       leaf_digest([F.col(c) for c in fields]).alias("digest"),
                       *[c.alias(k) for k, c in extra.items()])


def manifest(leaves: DataFrame, keep: list[str], name: str = "merkle") -> Manifest:
    """Trees over the rows of ``leaf_rows`` (a written table: it is read twice)."""
    got = ranked(leaves, "source", ["id", "digest"], f"{name}-leaves")
    names = common.stage(ranked(leaves.select("source").distinct().withColumn("one", F.lit(0)), "one", ["source"],
                                f"{name}-names").select(F.col("rank").alias("tree"), "source"), f"{name}-numbers")
    by_name = names.withColumnRenamed("source", "_source")
    got = (got.join(by_name, F.col("source").eqNullSafe(F.col("_source")))
           .select("tree", "rank", "digest", *[F.col(c) for c in keep]))
    sources = build(got, keep, f"{name}-s")
    tops = sources.roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest")
    top = build(tops, [], f"{name}-t")
    root = top.roots.select("digest").first()
    return Manifest(sources, top, names, bytes(root.digest) if root else None)


def proofs(m: Manifest, wanted: DataFrame | None = None, name: str = "proofs") -> DataFrame:
    """The proof of every requested leaf: tree, digit, member (rank, digest and
    kept columns), subroot, root and ``proof``, its segments leaf first.

    wanted: (tree, rank) of leaves; None asks for all of them."""
    runs_of = m.sources.lowest.select("tree", F.col("rank").alias("run"))
    if wanted is not None:
        runs_of = wanted.select("tree", F.floor(F.col("rank") / FANOUT).alias("run")).distinct()
    empty = F.array().cast(PATH)
    top_runs = runs_of.select(F.lit(0).cast("long").alias("tree"), F.floor(F.col("tree") / FANOUT).alias("run")).distinct()
    top_start = m.top.roots.select("tree", "digest", "height", empty.alias("path"))
    top = leaf_paths(m.top, top_start, top_runs, f"{name}-t")
    up = (top.select("path", "children", "height", F.posexplode("members").alias("digit", "member"))
          .select(F.col("member.rank").alias("tree"), F.col("member.digest").alias("digest"),
                  with_segment(F.col("path"), F.col("children"), F.col("digit"), F.col("height")).alias("path")))
    start = (m.sources.roots.select("tree", "height").join(up, "tree").select("tree", "digest", "height", "path"))
    start = common.stage(start, f"{name}-start")
    low = leaf_paths(m.sources, start, runs_of, f"{name}-s")
    sub = m.sources.roots.select("tree", F.col("digest").alias("subroot"))
    out = (low.join(sub, "tree").withColumn("root", F.lit(m.root).cast("binary"))
           .select("tree", "path", "children", "height", "subroot", "root",
                   F.posexplode("members").alias("digit", "member")))
    if wanted is not None:
        asked = wanted.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank")).distinct()
        out = out.join(asked, (F.col("tree") == F.col("_tree")) & (F.col("member.rank") == F.col("_rank")), "left_semi")
    path = with_segment(F.col("path"), F.col("children"), F.col("digit"), F.col("height"))
    return out.select("tree", "digit", "member", "subroot", "root", F.reverse(path).alias("proof"))
