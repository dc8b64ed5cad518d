"""Set-level statistics and numeric-health profiles (aggregations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dlit, is_finite
from ..functions.text import word_count

SAMPLE_ROWS = 100


def sample_head(df: DataFrame, n: int = SAMPLE_ROWS, order: str = "doc_id") -> DataFrame:
    """The first ``n`` rows in a declared order (a top-k: the limit is the
    feature)."""
    return df.orderBy(order).limit(n)


def dataset_statistics(snippets: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row: total, members, non-members, member share, and the mean word
    count of the first ``sample_rows`` snippets in doc_id order.  An empty set
    gives no row."""
    tot = snippets.agg(F.count(F.lit(1)).cast("long").alias("total"),
                       F.sum("label").cast("long").alias("members"),
                       F.lit(None).cast("double").alias("avg_words"))
    # top-k by doc_id: a limit that is the feature (the first 100 rows)
    head = (sample_head(snippets.select("doc_id", "text"), sample_rows)
            .agg(F.lit(None).cast("long").alias("total"), F.lit(None).cast("long").alias("members"),
                 F.avg(word_count(F.col("text")).cast("double")).alias("avg_words")))
    both = tot.unionByName(head).agg(F.max("total").alias("total"), F.max("members").alias("members"),
                                     F.max("avg_words").alias("avg_words_first_100"))
    return both.filter(F.col("total") > 0).select(
        "total", "members", (F.col("total") - F.col("members")).alias("non_members"),
        (F.col("members").cast("double") / F.col("total").cast("double")).alias("member_share"),
        "avg_words_first_100")


def score_profile(raw: DataFrame) -> DataFrame:
    """Per method: total, finite, inf and NaN counts and their shares; min,
    max, mean and population std of the finite values."""
    s = F.col("score")
    fin = is_finite(s)
    fs = F.when(fin, s)
    p = raw.groupBy("method").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(fin.cast("long")).alias("finite"),
        F.sum((F.abs(s) == dlit(float("inf"))).cast("long")).alias("inf"),
        F.sum(F.isnan(s).cast("long")).alias("nan"),
        F.min(fs).alias("min"), F.max(fs).alias("max"), F.avg(fs).alias("mean"),
        F.stddev_pop(fs).alias("std_pop"))
    return p.withColumns({f"{k}_share": F.col(k).cast("double") / F.col("total").cast("double")
                          for k in ("finite", "inf", "nan")})


def issue_report(profile: DataFrame, order: DataFrame, show: int = 5) -> DataFrame:
    """Methods having a non-finite score: the first ``show`` in method order,
    each with the count of further methods not shown ("and N more")."""
    bad = profile.filter(F.col("finite") < F.col("total")).join(order, "method")
    w = Window.orderBy("method_order")   # at most 122 rows: one small task
    return (bad.withColumn("rank", F.row_number().over(w))
            .withColumn("n_issues", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
            .filter(F.col("rank") <= show)
            .select("method", "method_order", "total", "finite", "inf", "nan",
                    F.greatest(F.col("n_issues") - F.lit(show), F.lit(0)).alias("more")))
