"""Interpolated (Witten-Bell) bigram model estimated with Spark.

Stands in for the language model: it yields, for every context, the four
numbers the scores need -- log-prob of the observed token, mean and variance
of log-prob under the predicted distribution, and the top-1 token -- without
ever building a vocabulary-by-context table.

Tables (all keyed, all produced by aggregations with map-side combine):
  unigram(tok, cnt, q, lnq)                 includes the <unk> row
  bigram(ctx, tok, cnt, p)                  seen pairs only
  contexts(ctx, n_c, d_c, lam, mu, var, xhat, p_xhat)   seen contexts only
Unseen pairs back off to lam(ctx) * q(tok); unseen contexts use the unigram
distribution, whose moments and top-1 are the scalars below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import UNK
from ..functions.numeric import dlit
from ..session import by_shuffle
from .moments import context_moments, with_p
from .tokens import token_pairs


@dataclass
class Scalars:
    N: int             # training tokens
    V: int             # distinct training tokens
    lam0: float        # unigram back-off weight V/(N+V)
    q_unk: float       # probability of <unk>
    M1: float          # sum q ln q over the unigram (incl. <unk>)
    var_u: float       # sum q (ln q - M1)^2
    top1: str          # most likely unigram token (lowest on ties)
    q_top1: float


ID_BUCKETS = 256       # parts of the vocabulary that are numbered by themselves
# Estimated in-memory bytes per model-table row (two short strings, a few
# numbers, row overhead) used by the broadcast size check.
ROW_BYTES = 96
# Every broadcast table is collected by the driver and built there as a hash
# table of two to three times that size; nine of them may be alive in one plan.
BROADCAST_MAX_BYTES = 8 * 1024 * 1024


@dataclass
class BigramModel:
    unigram: DataFrame
    bigram: DataFrame
    contexts: DataFrame
    s: Scalars
    n_bigrams: int = -1
    n_contexts: int = -1
    ids: DataFrame | None = None        # tok, id, cnt: a number for each distinct training token
    numbered: DataFrame | None = None   # ctx_id, tok_id, cnt: the seen pairs

    def _bound(self, max_bytes: int | None) -> int:
        if max_bytes is not None:
            return max_bytes
        conf = self.bigram.sparkSession.conf.get("spark.memscan.broadcastMaxBytes", None)
        return int(conf) if conf is not None else BROADCAST_MAX_BYTES

    def fits(self, table: str, max_bytes: int | None = None) -> bool:
        """Is one lookup table ('unigram', 'contexts', 'bigram') proven small
        enough to broadcast?  Row counts are exact (known from the fit); the
        bound is ``spark.memscan.broadcastMaxBytes`` (default 8 MiB)."""
        rows = {"unigram": self.s.V + 1, "contexts": self.n_contexts, "bigram": self.n_bigrams}[table]
        return rows >= 0 and rows * ROW_BYTES <= self._bound(max_bytes)

    def broadcastable(self, max_bytes: int | None = None) -> bool:
        """True when every lookup table can be broadcast."""
        return all(self.fits(t, max_bytes) for t in ("unigram", "contexts", "bigram"))


def fit_bigram(spark: SparkSession, train_dt: DataFrame, store=None) -> BigramModel:
    """Estimate the model from training documents (doc_tokens rows)."""
    # one pass over the corpus: counts of (token, successor), successor NULL
    # after a document's last token; from these distinct pairs one small
    # aggregation gives unigram counts (all pairs) and context counts
    # (pairs with a successor) together
    pairs = (token_pairs(train_dt).groupBy(F.col("x0").alias("ctx"), F.col("x1").alias("tok"))
             .agg(F.count(F.lit(1)).alias("cnt")))
    return fit_from_counts(spark, pairs, store)


def fit_from_counts(spark: SparkSession, pairs: DataFrame, store=None) -> BigramModel:
    """Estimate the model from (ctx, tok, cnt), tok null after a document's
    last token: counted in one pass or merged by a ``CountLedger``."""
    def keep(name, df):
        return store.put(name, df) if store is not None else df

    pairs = keep("pair_counts", pairs)
    per_tok = pairs.groupBy("ctx").agg(
        F.sum("cnt").alias("cnt"),
        F.sum(F.when(F.col("tok").isNotNull(), F.col("cnt"))).alias("n_c"),
        F.count("tok").alias("d_c"))
    bucket = F.pmod(F.xxhash64("ctx"), F.lit(ID_BUCKETS)).cast("int")
    number = F.row_number().over(Window.partitionBy(bucket).orderBy("ctx"))
    per_tok = keep("token_counts", per_tok.withColumn("id", (number - 1) * F.lit(ID_BUCKETS) + bucket))
    uc = per_tok.select(F.col("ctx").alias("tok"), "cnt", "id")
    row = uc.agg(F.sum("cnt").alias("N"), F.count(F.lit(1)).alias("V")).first()
    N, V = int(row["N"] or 0), int(row["V"] or 0)
    if N == 0:
        raise ValueError("the training corpus has no tokens")
    lam0 = V / (N + V)
    q_unk = lam0 / (V + 1)

    def q_of(cnt: str):
        return (dlit(1.0) - dlit(lam0)) * F.col(cnt).cast("double") / dlit(N) + dlit(lam0) / dlit(V + 1)

    unk = spark.range(1).select(F.lit(UNK).alias("tok"), F.lit(0).cast("long").alias("cnt"), F.lit(-1).alias("id"))
    # a projection of the materialised counts: no write of its own
    uni = (uc.unionByName(unk)
           .withColumn("q", F.when(F.col("tok") == UNK, dlit(q_unk)).otherwise(q_of("cnt")))
           .withColumn("lnq", F.ln("q")))
    r2 = uni.agg(F.sum(F.col("q") * F.col("lnq")).alias("M1"),
                 F.min(F.struct((-F.col("q")).alias("nq"), F.col("tok").alias("tok"))).alias("best")).first()
    M1 = float(r2["M1"])
    var_u = uni.agg(F.sum(F.col("q") * (F.col("lnq") - dlit(M1)) * (F.col("lnq") - dlit(M1)))).first()[0]
    s = Scalars(N=N, V=V, lam0=lam0, q_unk=q_unk, M1=M1, var_u=float(var_u), top1=r2["best"][1], q_top1=-float(r2["best"][0]))

    # the vocabulary first, so that the pairs of a context lie together and its
    # moments are summed before they are shuffled; a shuffle by stage, and counts
    # travel instead of the probabilities that follow from them
    b0 = pairs.filter(F.col("tok").isNotNull())
    c0 = per_tok.filter(F.col("d_c") > 0).select("ctx", "n_c", "d_c", F.col("id").alias("ctx_id"))
    u = uc.select("tok", F.col("cnt").alias("cnt_tok"), F.col("id").alias("tok_id"))
    met = keep("pair_tokens", b0.join(by_shuffle(u), "tok"))
    drop(store, "pair_counts")
    lam = F.col("d_c").cast("double") / (F.col("n_c") + F.col("d_c")).cast("double")
    big = met.join(by_shuffle(c0), "ctx").withColumn("q", q_of("cnt_tok")).withColumns({"lnq": F.ln("q"), "lam": lam})
    big = keep("bigram_full", with_p(big.drop("cnt_tok")))
    drop(store, "pair_tokens")
    low = {"mu_low": dlit(s.M1), "var_low": dlit(s.var_u), "top_low": F.lit(s.top1), "q_top_low": dlit(s.q_top1)}
    ctx = keep("contexts", context_moments(big.withColumns(low), keep))
    drop(store, "context_sums")
    bigram = big.select("ctx", "tok", "cnt", "p")
    n_b = bigram.count()   # Parquet row counts come from file metadata
    n_c = ctx.count()
    return BigramModel(unigram=uni, bigram=bigram, contexts=ctx, s=s, n_bigrams=n_b, n_contexts=n_c,
                       ids=uc.select("tok", "id", "cnt"), numbered=big.select("ctx_id", "tok_id", "cnt"))


def drop(store, *names: str) -> None:
    """Delete stages that nothing reads any more, where the store can."""
    for name in names:
        if hasattr(store, "drop"):
            store.drop(name)


def pair_lookup(df: DataFrame, model: BigramModel, ctx: str, tok: str, prefix: str,
                with_context: bool = True, broadcast: bool | None = None) -> DataFrame:
    """Attach p(tok | ctx) (and the context's moments and top-1) to each row.

    Three left joins -- contexts on ctx, unigram on tok, bigram on (ctx, tok).
    Each table is broadcast only when ``BigramModel.fits`` proved it small
    (``broadcast=None``, the default, decides per table; True/False forces):
    a broadcast hash join keeps the row order and partitioning of ``df``.
    A table beyond the bound is a sort-merge join, whatever the size of its
    files; AQE splits hot keys (skew join).  Large inputs are
    looked up by chunks instead (``lookup``).
    """
    s = model.s
    c = model.contexts.select(
        F.col("ctx").alias(f"{prefix}_cctx"), F.col("lam").alias(f"{prefix}_lam"),
        F.col("mu").alias(f"{prefix}_cmu"), F.col("var").alias(f"{prefix}_cvar"),
        F.col("xhat").alias(f"{prefix}_cxhat"), F.col("p_xhat").alias(f"{prefix}_cpx"))
    u = model.unigram.select(F.col("tok").alias(f"{prefix}_utok"), F.col("q").alias(f"{prefix}_uq"))
    b = model.bigram.select(F.col("ctx").alias(f"{prefix}_bctx"), F.col("tok").alias(f"{prefix}_btok"),
                            F.col("p").alias(f"{prefix}_bp"))
    def bc(name):
        return model.fits(name) if broadcast is None else broadcast
    c = F.broadcast(c) if bc("contexts") else by_shuffle(c)
    u = F.broadcast(u) if bc("unigram") else by_shuffle(u)
    b = F.broadcast(b) if bc("bigram") else by_shuffle(b)
    out = (df.join(c, F.col(ctx) == F.col(f"{prefix}_cctx"), "left")
           .join(u, F.col(tok) == F.col(f"{prefix}_utok"), "left")
           .join(b, (F.col(ctx) == F.col(f"{prefix}_bctx")) & (F.col(tok) == F.col(f"{prefix}_btok")), "left"))
    lam = F.coalesce(F.col(f"{prefix}_lam"), dlit(1.0))
    q = F.coalesce(F.col(f"{prefix}_uq"), dlit(s.q_unk))
    p = F.coalesce(F.col(f"{prefix}_bp"), lam * q)
    out = out.withColumn(f"{prefix}_lp", F.when(F.col(tok).isNotNull(), F.ln(p)))
    out = (out.withColumn(f"{prefix}_mu", F.coalesce(F.col(f"{prefix}_cmu"), dlit(s.M1)))
           .withColumn(f"{prefix}_var", F.coalesce(F.col(f"{prefix}_cvar"), dlit(s.var_u))))
    if with_context:
        out = (out.withColumn(f"{prefix}_xhat", F.coalesce(F.col(f"{prefix}_cxhat"), F.lit(s.top1)))
               .withColumn(f"{prefix}_lpx", F.ln(F.coalesce(F.col(f"{prefix}_cpx"), dlit(s.q_top1)))))
    return out.drop(f"{prefix}_cctx", f"{prefix}_lam", f"{prefix}_cmu", f"{prefix}_cvar",
                    f"{prefix}_cxhat", f"{prefix}_cpx", f"{prefix}_utok", f"{prefix}_uq",
                    f"{prefix}_bctx", f"{prefix}_btok", f"{prefix}_bp")


def context_check(model: BigramModel) -> DataFrame:
    """Per context: sum of p(w|c) over the whole vocabulary (must be 1)."""
    s = model.s
    seen = model.bigram.groupBy("ctx").agg(F.sum("p").alias("s_p"))
    u = model.unigram.agg(F.sum("q").alias("tot_q")).first()["tot_q"]
    qs = (model.bigram.join(model.unigram.select("tok", "q"), "tok")
          .groupBy("ctx").agg(F.sum("q").alias("s_q")))
    return (seen.join(qs, "ctx").join(model.contexts.select("ctx", "lam"), "ctx")
            .select("ctx", (F.col("s_p") + F.col("lam") * (dlit(u) - F.col("s_q"))).alias("total_p")))
