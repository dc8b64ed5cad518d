"""Tokenisation and next-token pairing, all narrow (no shuffle).

A text is one row, so its tokens are produced inside the task that read it;
neighbouring tokens are paired through array indexing instead of a window,
which would need a shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compressed_length, token_array


def doc_tokens(snippets: DataFrame, with_clen: bool = True) -> DataFrame:
    """(doc_id, label, toks ARRAY<STRING>, T INT[, clen INT])."""
    cols = [F.col("doc_id"), F.col("label"), token_array(F.col("text")).alias("toks")]
    if with_clen:
        cols.append(compressed_length(F.col("text")).alias("clen"))
    return (snippets.select(*cols)
            .withColumn("T", F.size("toks").cast("int")))


def tokens(dt: DataFrame) -> DataFrame:
    """Ordered token rows (doc_id, pos, tok)."""
    return dt.select("doc_id", F.posexplode("toks").alias("pos", "tok"))


def positions(dt: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per scored position i in 0..T-2: context x0 = tok[i], observed
    next token x1 = tok[i+1], and x2 = tok[i+2] (NULL past the end).

    posexplode plus array indexing stays inside whole-stage codegen (no
    per-element lambda)."""
    extra = extra or []
    return (dt.select("doc_id", "T", *extra, "toks", F.posexplode("toks").alias("i", "x0"))
            .filter(F.col("i") <= F.col("T") - 2)
            .select("doc_id", "T", *extra, F.col("i").cast("int").alias("i"), "x0",
                    F.get("toks", F.col("i") + 1).alias("x1"),
                    F.get("toks", F.col("i") + 2).alias("x2")))


def token_pairs(dt: DataFrame) -> DataFrame:
    """Every token with its successor: (doc_id, i, x0, x1), x1 NULL after the
    last token.  One pass over the corpus serves both the unigram counts (all
    x0) and the bigram counts (x1 not NULL)."""
    return (dt.select("doc_id", "toks", F.posexplode("toks").alias("i", "x0"))
            .select("doc_id", F.col("i").cast("int").alias("i"), "x0",
                    F.get("toks", F.col("i") + 1).alias("x1")))
