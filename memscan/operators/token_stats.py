"""Per-position statistics under the bigram model.

One row per scored position i of a document (predicting token i+1):
  lp, mu, var, xhat, lp_xhat      statistics at i (context x0 = tok[i])
  lp_alt, mu_alt, var_alt         statistics at i+1 of the alternative
                                  sequence whose tok[i+1] is xhat: context
                                  xhat, predicted token tok[i+2]
  lp_next, mu_next, var_next      statistics at i+1 of the original sequence
                                  (context tok[i+1], token tok[i+2]); absent
                                  when only the bigram table is not broadcast
Under a bigram model replacing tok[i+1] changes the statistics at position
i+1 only, so these columns are the whole alternative (context-local
alternatives; every other future term cancels exactly).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import token_stats_by_chunks
from .ngram import BigramModel, pair_lookup
from .tokens import positions

MIXED_POSITIONS = 5_000_000     # token rows that may be shuffled for the bigram lookups


def tokens_by_chunks(dt: DataFrame, model: BigramModel) -> int | None:
    """The number of tokens of documents that are looked up by chunks; None
    where tables are broadcast or few positions are shuffled."""
    if model.broadcastable():
        return None
    n_tokens = dt.agg(F.sum("T")).first()[0] or 0
    small = n_tokens <= MIXED_POSITIONS and model.fits("contexts") and model.fits("unigram")
    return None if small else int(n_tokens)


def token_stats(dt: DataFrame, model: BigramModel, extra: list[str] | None = None,
                partitions: int | None = None, words: bool = True) -> DataFrame:
    """Per-position statistics of the documents ``dt`` (doc_tokens rows).

    When every model table passes its broadcast size check, the compact token
    arrays are hash-partitioned by doc_id once and all lookups are broadcast
    joins: the position rows then never move, and the per-document windows
    that follow reuse this partitioning (no shuffle of the position table).
    With only the bigram table beyond its bound and few positions, the two bigram
    lookups shuffle the positions.  Everything else is looked up by chunks of
    documents (``lookup``): no table is broadcast and no position is shuffled for
    a lookup.  ``words=False`` leaves out the columns ctx, tok, next_tok and xhat.
    """
    extra = extra or []
    bc = model.broadcastable()
    n_tokens = tokens_by_chunks(dt, model)
    if n_tokens is not None:
        return token_stats_by_chunks(dt, model, extra, n_tokens, partitions, words)
    if bc:
        n = partitions or int(dt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dt = dt.repartition(n, "doc_id")
    # statistics of the next position (context x1, token x2).  With a
    # broadcast bigram table this is one more in-memory lookup and no
    # per-document sort is needed before the scores; otherwise it would be a
    # third shuffle of the positions, so the scores take it with a window over the
    # doc_id shuffle they need anyway (doc_key parts documents that share an id).
    nxt = model.fits("bigram")
    key = [] if nxt else ["doc_key"]
    p = positions(dt if nxt else dt.withColumn("doc_key", F.xxhash64("toks")), extra + key)
    a = pair_lookup(p, model, "x0", "x1", "o")
    a = a.withColumn("xhat", F.col("o_xhat"))
    b = pair_lookup(a, model, "xhat", "x2", "h", with_context=False)
    if nxt:
        b = pair_lookup(b, model, "x1", "x2", "n", with_context=False)
    named = [F.col("x0").alias("ctx"), F.col("x1").alias("tok"), F.col("x2").alias("next_tok")] if words else []
    return b.select(
        "doc_id", "T", *extra, F.col("i").alias("pos"), *named,
        F.col("o_lp").alias("lp"), F.col("o_mu").alias("mu"), F.col("o_var").alias("var"),
        *(["xhat"] if words else []), F.col("o_lpx").alias("lp_xhat"),
        F.col("h_lp").alias("lp_alt"), F.col("h_mu").alias("mu_alt"), F.col("h_var").alias("var_alt"),
        *([F.col("n_lp").alias("lp_next"), F.col("n_mu").alias("mu_next"), F.col("n_var").alias("var_next")]
          if nxt else key),
    )
