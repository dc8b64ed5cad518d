"""Model lookups of large inputs, without a broadcast and without shuffling
the positions for each lookup.

Documents are cut into segments of positions (two more tokens overlap), and
segments are dealt into chunks.  A chunk asks once for each of its tokens and
each of its pairs, however often they occur:

  tokens  (chunk, tok)       --join token_table-->  q, lam, mu, var, xhat, p_xhat and those of xhat
  pairs   (chunk, ctx, tok)  --join bigram------->  p, of neighbours and of (xhat, next but one)

The answers meet the chunk's segments in one cogroup, where positions take
their values from sorted arrays.  A group holds about CHUNK positions whatever
the corpus and the vocabulary are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.numeric import dlit
from ..session import by_shuffle
from .ngram import BigramModel

SEGMENT = 32_768     # positions of a segment
CHUNK = 400_000      # positions of a chunk, about

NUMBERS = ("q", "lam", "mu", "var", "p_xhat", "h_lam", "h_mu", "h_var")
VALUES = ("p", "mu", "var", "p_xhat", "p_alt", "mu_alt", "var_alt", "p_next", "mu_next", "var_next")
WORDS = ("ctx", "tok", "next_tok", "xhat")


def token_table(model: BigramModel) -> DataFrame:
    """Everything that depends on one token: its probability, its moments and
    top-1 as a context (the unigram's where it is none) and those of its top-1."""
    s, c = model.s, F.col
    own = model.contexts.select(c("ctx").alias("tok"), "lam", "mu", "var", "xhat", "p_xhat")
    fill = {"lam": dlit(1.0), "mu": dlit(s.M1), "var": dlit(s.var_u), "xhat": F.lit(s.top1), "p_xhat": dlit(s.q_top1)}
    t = (model.unigram.select("tok", "q").join(by_shuffle(own), "tok", "left")
         .withColumns({k: F.coalesce(k, v) for k, v in fill.items()}))
    top = model.contexts.select(c("ctx").alias("xhat"), c("lam").alias("h_lam"), c("mu").alias("h_mu"), c("var").alias("h_var"))
    fill = {f"h_{k}": fill[k] for k in ("lam", "mu", "var")}
    return t.join(by_shuffle(top), "xhat", "left").withColumns({k: F.coalesce(k, v) for k, v in fill.items()})


def _unseen(model: BigramModel) -> dict[str, float]:
    """The row of a token that the corpus does not have."""
    s = model.s
    top = model.contexts.filter(F.col("ctx") == s.top1).select("lam", "mu", "var").first() or (1.0, s.M1, s.var_u)
    return dict(zip(NUMBERS, (s.q_unk, 1.0, s.M1, s.var_u, s.q_top1, *top), strict=True))


def segments(dt: DataFrame, extra: list[str], chunks: int, size: int = SEGMENT) -> DataFrame:
    """(doc_id, T, *extra, start, toks, chunk): ``size`` positions each, with
    the two tokens after the last one."""
    at = dt.filter("T >= 2").select("doc_id", "T", *extra, "toks",
                                    F.explode(F.sequence(F.lit(0), F.col("T") - 2, F.lit(size))).alias("start"))
    at = at.withColumn("toks", F.slice("toks", F.col("start") + 1, size + 2))
    at = at.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "toks"), F.lit(chunks)))
    return at.repartition("chunk")      # the distinct tokens and pairs of a chunk need no further shuffle


def answers(segs: DataFrame, model: BigramModel) -> DataFrame:
    """(chunk, a, b, p, xhat, *NUMBERS): tokens (b is null) and pairs that the
    model knows, for each chunk that has them."""
    c = F.col
    at = segs.select("chunk", "toks", F.posexplode("toks").alias("i", "a"))
    at = at.select("chunk", "a", F.get("toks", c("i") + 1).alias("b"), F.get("toks", c("i") + 2).alias("c"))
    table = token_table(model)
    tokens = at.select("chunk", "a").distinct().join(by_shuffle(table.withColumnRenamed("tok", "a")), "a")
    far = (at.filter("c is not null").select("chunk", "a", "c").distinct()
           .join(by_shuffle(model.contexts.select(c("ctx").alias("a"), "xhat")), "a", "left")
           .select("chunk", F.coalesce("xhat", F.lit(model.s.top1)).alias("a"), c("c").alias("b")).distinct())
    near = at.filter("b is not null").select("chunk", "a", "b").distinct()
    pairs = near.unionByName(far).join(     # a pair of both kinds is answered twice alike
        by_shuffle(model.bigram.select(c("ctx").alias("a"), c("tok").alias("b"), "p")), ["a", "b"])
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return (tokens.select("chunk", "a", text.alias("b"), number.alias("p"), "xhat", *NUMBERS)
            .unionByName(pairs.select("chunk", "a", "b", "p", text.alias("xhat"), *[number.alias(k) for k in NUMBERS])))


def look_up(segs: pa.Table, found: pa.Table, kept: list[str], unseen: dict[str, float], top1: str,
            words: bool, size: int) -> pa.Table:
    """One row a position of the segments of a chunk, in the order of ``kept``,
    pos, VALUES and (with ``words``) WORDS."""
    def column(t: pa.Table, name: str) -> pa.Array:
        return pa.concat_arrays(t.column(name).chunks) if t.column(name).num_chunks else pa.array([], t.column(name).type)

    is_pair = pc.is_valid(found.column("b"))
    tok, pair = found.filter(pc.invert(is_pair)), found.filter(is_pair)
    known = column(tok, "a")
    value = {k: np.append(column(tok, k).to_numpy(zero_copy_only=False), unseen[k]) for k in NUMBERS}
    xhat = pa.concat_arrays([column(tok, "xhat"), pa.array([top1], known.type)])
    names = pc.unique(pa.concat_arrays([known, xhat]))

    def index(x: pa.Array, among: pa.Array, absent: int) -> np.ndarray:
        return pc.fill_null(pc.index_in(x, value_set=among), absent).to_numpy(zero_copy_only=False).astype(np.int64)

    width = len(names) + 1
    keys = index(column(pair, "a"), names, -1) * width + index(column(pair, "b"), names, -1)
    order = np.argsort(keys)
    keys, probs = np.append(keys[order], -1), np.append(column(pair, "p").to_numpy(zero_copy_only=False)[order], 0.0)

    def prob(ctx: np.ndarray, tok: np.ndarray, backed_off: np.ndarray) -> np.ndarray:
        key = np.where((ctx >= 0) & (tok >= 0), ctx * width + tok, -2)
        place = np.searchsorted(keys[:-1], key)
        return np.where(keys[place] == key, probs[place], backed_off)

    toks = column(segs, "toks")
    flat, sizes = toks.flatten(), pc.list_value_length(toks).to_numpy(zero_copy_only=False)
    row = index(flat, known, len(known))
    name = np.append(index(known, names, -1), -1)[row]
    hat = index(xhat, names, -1)[row]
    seg = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place < np.minimum(size, sizes - 1)[seg])
    seg, place = seg[at], place[at]
    last = place + 2 >= sizes[seg]                  # no next token but one
    x0, x1, x2 = at, at + 1, np.where(last, at + 1, at + 2)
    q, lam, h_lam = value["q"][row], value["lam"][row], value["h_lam"][row]
    out = {"p": prob(name[x0], name[x1], lam[x0] * q[x1]), "mu": value["mu"][row[x0]], "var": value["var"][row[x0]],
           "p_xhat": value["p_xhat"][row[x0]],
           "p_alt": pa.array(prob(hat[x0], name[x2], h_lam[x0] * q[x2]), mask=last),
           "mu_alt": value["h_mu"][row[x0]], "var_alt": value["h_var"][row[x0]],
           "p_next": pa.array(prob(name[x1], name[x2], lam[x1] * q[x2]), mask=last),
           "mu_next": value["mu"][row[x1]], "var_next": value["var"][row[x1]]}
    cols = {k: column(segs, k).take(pa.array(seg)) for k in kept}
    cols["pos"] = pa.array((column(segs, "start").to_numpy(zero_copy_only=False)[seg] + place).astype(np.int32))
    cols |= {k: pa.array(out[k]) for k in VALUES}
    if words:
        cols |= {"ctx": flat.take(pa.array(x0)), "tok": flat.take(pa.array(x1)),
                 "next_tok": flat.take(pa.array(x2, mask=last)), "xhat": xhat.take(pa.array(row[x0]))}
    return pa.table(cols)


def token_stats_by_chunks(dt: DataFrame, model: BigramModel, extra: list[str], n_tokens: int,
                          partitions: int | None = None, words: bool = True, size: int = SEGMENT) -> DataFrame:
    """Per-position statistics of the documents (see ``token_stats``)."""
    chunks = max(partitions or 1, -(-int(n_tokens) // CHUNK))
    segs = segments(dt, extra, chunks, size)
    kept, unseen, top1 = ["doc_id", "T", *extra], _unseen(model), model.s.top1

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return look_up(left, right, kept, unseen, top1, words, size)

    schema = StructType([dt.schema[k] for k in kept] + [StructField("pos", IntegerType())] +
                        [StructField(k, DoubleType()) for k in VALUES] +
                        [StructField(k, StringType()) for k in (WORDS if words else ())])
    found = answers(segs, model).withColumnRenamed("chunk", "of")
    ts = segs.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, schema)
    c = F.col
    return ts.select(
        *kept, "pos", *(["ctx", "tok", "next_tok"] if words else []), F.ln("p").alias("lp"), "mu", "var",
        *(["xhat"] if words else []), F.ln("p_xhat").alias("lp_xhat"), F.ln("p_alt").alias("lp_alt"), "mu_alt", "var_alt",
        F.ln(c("p_next")).alias("lp_next"), "mu_next", "var_next")
