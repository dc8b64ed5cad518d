"""Moments of ln p under an interpolated back-off distribution.

A context's distribution is p = (1 - lam) * cnt / n_c + lam * q on its seen
tokens and lam * q on all others, where q is the distribution of its suffix (one
token less).  Its moments follow from the seen tokens and the suffix's moments
alone, at any order, so no context ever meets the vocabulary:

  mu  = sum over seen of p ln p + lam * (ln lam * (1 - sum q) + mu_low - sum q ln q)
  var = sum over seen of p (ln p - mu)^2
      + lam * (var_low + (mu_low - k)^2 - sum over seen of q (ln q - k)^2),   k = mu - ln lam

The variance is summed around the mean found first: a difference of raw moments
would lose all digits where the distribution is nearly even or nearly certain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dlit
from ..session import by_shuffle


def smoothed(counts: DataFrame, low: DataFrame, on: list[str]) -> DataFrame:
    """Counts (ctx, tok, cnt, ...) with n_c, d_c, lam, p and the columns of the
    lower order (q, lnq, mu_low, var_low, top_low, q_top_low)."""
    sizes = counts.groupBy("ctx").agg(F.sum("cnt").alias("n_c"), F.count(F.lit(1)).alias("d_c"))
    lam = F.col("d_c").cast("double") / (F.col("n_c") + F.col("d_c")).cast("double")
    return with_p(counts.join(by_shuffle(sizes.withColumn("lam", lam)), "ctx").join(by_shuffle(low), on))


def with_p(joined: DataFrame) -> DataFrame:
    seen = F.col("cnt").cast("double") / F.col("n_c").cast("double")
    return joined.withColumn("p", (dlit(1.0) - F.col("lam")) * seen + F.col("lam") * F.col("q"))


def context_moments(big: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """(ctx, n_c, d_c, lam, mu, var, xhat, p_xhat) of every context of ``big``
    (ctx, tok, n_c, d_c, lam, p, q, lnq and the suffix's mu_low, var_low,
    top_low, q_top_low), a table that is written already."""
    c = F.col
    lnp = F.ln("p")
    same = ("n_c", "d_c", "lam", "mu_low", "var_low", "top_low", "q_top_low")
    sums = big.groupBy("ctx").agg(
        *[F.max(x).alias(x) for x in same],
        F.sum(c("p") * lnp).alias("s_plnp"), F.sum("q").alias("s_q"), F.sum(c("q") * c("lnq")).alias("s_qlnq"),
        F.min(F.struct((-c("p")).alias("np"), c("tok").alias("tok"))).alias("best"),
        F.max((c("tok") == c("top_low")).cast("int")).alias("has_top"))
    ll = F.ln("lam")
    mu = c("s_plnp") + c("lam") * (ll * (dlit(1.0) - c("s_q")) + c("mu_low") - c("s_qlnq"))
    p_best, tok_best = -c("best")["np"], c("best")["tok"]
    p_un = c("lam") * c("q_top_low")
    low_wins = (c("has_top") == 0) & ((p_un > p_best) | ((p_un == p_best) & (c("top_low") < tok_best)))
    sums = keep("context_sums", sums.select(
        "ctx", "n_c", "d_c", "lam", "mu_low", "var_low", mu.alias("mu"), (mu - ll).alias("k"),
        F.when(low_wins, c("top_low")).otherwise(tok_best).alias("xhat"),
        F.when(low_wins, p_un).otherwise(p_best).alias("p_xhat")))
    square = lambda x: x * x
    around = (big.select("ctx", "p", "q", "lnq").join(by_shuffle(sums.select("ctx", "mu", "k")), "ctx").groupBy("ctx").agg(
        F.sum(c("p") * square(lnp - c("mu"))).alias("s2"), F.sum(c("q") * square(c("lnq") - c("k"))).alias("sq2")))
    var = c("s2") + c("lam") * F.greatest(c("var_low") + square(c("mu_low") - c("k")) - c("sq2"), dlit(0.0))
    return (sums.join(by_shuffle(around), "ctx").withColumn("var", var)
            .select("ctx", "n_c", "d_c", "lam", "mu", "var", "xhat", "p_xhat"))
