"""ROC points, AUROC, FPR at 95 % TPR and TPR at 5 % FPR for every method.

The ROC of a method is a running sum over its scores in descending order.
A window partitioned by method alone would put every document of a method
into one task, so the running sums are computed in two passes instead:

1. collapse equal scores: (method, s) -> (tp, fp)      [map-side combine]
2. cut each method's score axis into B ranges at approximate quantiles
   (a methods x B table, checkpointed so retries see the same cuts)
3. per (method, range): totals and the counts of its highest score
   -> offsets by a window over the small methods x B table
4. per (method, range): local running sums, plus the offset
Each window group is at most one score range, never a whole method.

The collinear-point rule of the ROC curve (a point is dropped when the steps
before and after it are equal) needs only the counts of the next lower score:
a point j is kept iff it is the first or last one or (tp, fp)[j] differs from
(tp, fp)[j+1].  AUROC is the trapezoid sum, unaffected by the dropped points.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import ROC_SCORE_CLIP, method_names
from ..functions.numeric import dlit, is_finite
from ..session import checkpoint_root

TARGET_ROWS_PER_RANGE = 2_000_000


def method_order(spark: SparkSession) -> DataFrame:
    """Fixed position of each of the 122 score names (a constant table)."""
    names = method_names()
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "method string, method_order int")


def prepare(scores: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """Filter non-finite scores and missing labels, clip to +-1e10."""
    s = F.col(score_col)
    return (scores.filter(is_finite(s) & F.col(label_col).isNotNull())
            .select("method", F.least(F.greatest(s, dlit(-ROC_SCORE_CLIP)), dlit(ROC_SCORE_CLIP)).alias("s"),
                    F.col(label_col).cast("int").alias("label")))


def auto_ranges(totals: DataFrame, row_bound: int | None) -> int:
    """Ranges per method so that one range holds about TARGET_ROWS_PER_RANGE
    distinct scores.  The number of distinct scores of a method is at most
    the number of score rows of the input, so a small input needs no pass
    over the data to be sized."""
    if row_bound is not None and row_bound <= TARGET_ROWS_PER_RANGE:
        return 1
    biggest = totals.agg(F.max("n_points")).first()[0] or 0
    return max(1, math.ceil(biggest / TARGET_ROWS_PER_RANGE))


def _ranges(spark: SparkSession, g: DataFrame, totals: DataFrame, n_ranges: int | None,
            row_bound: int | None = None) -> DataFrame:
    """Attach a range index to each distinct score (ascending with s)."""
    if n_ranges is None:
        n_ranges = auto_ranges(totals, row_bound)
    if n_ranges <= 1:
        return g.withColumn("rng", F.lit(0))
    probs = [j / n_ranges for j in range(1, n_ranges)]
    cuts = g.groupBy("method").agg(
        F.percentile_approx("s", F.array(*[dlit(p) for p in probs]), 10000).alias("cuts"))
    checkpoint_root(spark)
    cuts = cuts.checkpoint(eager=True)   # methods x B rows; same cuts on retry
    return (g.join(F.broadcast(cuts), "method")       # one row a method
            .withColumn("rng", F.size(F.filter("cuts", lambda c: c <= F.col("s"))))
            .drop("cuts"))


def roc_table(scores: DataFrame, n_ranges: int | None = None, score_col: str = "score",
              label_col: str = "label", row_bound: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per distinct score: cumulative counts, fpr, tpr and the kept flag.

    ``row_bound`` (optional) is an upper bound of the input rows, e.g. the
    metadata row count of a materialised score table.
    Returns (points, totals); totals has one row per method."""
    spark = scores.sparkSession
    g = (prepare(scores, score_col, label_col).groupBy("method", "s")
         .agg(F.sum("label").cast("long").alias("tp"),
              F.sum(F.lit(1) - F.col("label")).cast("long").alias("fp")))
    totals = g.groupBy("method").agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"),
                                     F.count(F.lit(1)).alias("n_points"))
    g = _ranges(spark, g, totals, n_ranges, row_bound)
    top = F.max_by(F.struct("tp", "fp"), "s")
    summ = g.groupBy("method", "rng").agg(F.sum("tp").alias("r_tp"), F.sum("fp").alias("r_fp"),
                                         top.alias("r_top"))
    wm = Window.partitionBy("method").orderBy(F.col("rng").desc())
    before = wm.rowsBetween(Window.unboundedPreceding, -1)
    summ = (summ.withColumn("off_tp", F.coalesce(F.sum("r_tp").over(before), F.lit(0)))
            .withColumn("off_fp", F.coalesce(F.sum("r_fp").over(before), F.lit(0)))
            .withColumn("next_top", F.lead("r_top").over(wm))
            .select("method", "rng", "off_tp", "off_fp", "next_top"))
    wl = Window.partitionBy("method", "rng").orderBy(F.col("s").desc())
    run = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pts = (g.join(F.broadcast(summ), ["method", "rng"])      # methods x B rows
           .withColumn("cum_tp", F.col("off_tp") + F.sum("tp").over(run))
           .withColumn("cum_fp", F.col("off_fp") + F.sum("fp").over(run))
           .withColumn("nxt", F.coalesce(F.lead(F.struct("tp", "fp")).over(wl), F.col("next_top")))
           .join(F.broadcast(totals), "method"))
    first = (F.col("cum_tp") == F.col("tp")) & (F.col("cum_fp") == F.col("fp"))
    last = F.col("nxt").isNull()
    kept = first | last | (F.col("nxt.tp") != F.col("tp")) | (F.col("nxt.fp") != F.col("fp"))
    def ratio(num, den):          # NULL for a single-class method (guarded later)
        return F.when(F.col(den) > 0, num.cast("double") / F.col(den).cast("double"))
    pts = pts.withColumns({
        "kept": kept,
        "tpr": ratio(F.col("cum_tp"), "P"), "fpr": ratio(F.col("cum_fp"), "N"),
        "tpr_prev": ratio(F.col("cum_tp") - F.col("tp"), "P"),
        "fpr_prev": ratio(F.col("cum_fp") - F.col("fp"), "N")})
    return pts, totals


def roc_points(scores: DataFrame, n_ranges: int | None = None, **kw) -> DataFrame:
    """Kept ROC points (method, threshold, fpr, tpr), with (0, 0) at +inf."""
    pts, totals = roc_table(scores, n_ranges, **kw)
    ok = totals.filter((F.col("P") > 0) & (F.col("N") > 0) & (F.col("n_points") >= 1))
    origin = ok.select("method", dlit(float("inf")).alias("threshold"), dlit(0.0).alias("fpr"),
                       dlit(0.0).alias("tpr"))
    kept = pts.filter("kept and P > 0 and N > 0").select(
        "method", F.col("s").alias("threshold"), "fpr", "tpr")
    return origin.unionByName(kept)


def evaluate_methods(scores: DataFrame, n_ranges: int | None = None, **kw) -> DataFrame:
    """(method, auroc, fpr95, tpr05) for every method in one plan.

    Fewer than two finite scores, or a single class, gives (0.0, 1.0, 0.0)."""
    pts, totals = roc_table(scores, n_ranges, **kw)
    area = (F.col("fpr") - F.col("fpr_prev")) * (F.col("tpr") + F.col("tpr_prev")) / dlit(2.0)
    m = pts.groupBy("method").agg(
        F.sum(area).alias("auroc"),
        F.min(F.when(F.col("kept") & (F.col("tpr") >= dlit(0.95)), F.col("fpr"))).alias("fpr95"),
        F.max(F.when(F.col("kept") & (F.col("fpr") <= dlit(0.05)), F.col("tpr"))).alias("tpr05"),
    )
    t = totals.withColumn("n_rows", F.col("P") + F.col("N"))   # not "n": names are case-insensitive
    good = (F.col("n_rows") >= 2) & (F.col("P") > 0) & (F.col("N") > 0)
    return (t.join(m, "method", "left").select(
        "method",
        F.when(good, F.col("auroc")).otherwise(dlit(0.0)).alias("auroc"),
        F.when(good, F.coalesce(F.col("fpr95"), dlit(1.0))).otherwise(dlit(1.0)).alias("fpr95"),
        F.when(good, F.coalesce(F.col("tpr05"), dlit(0.0))).otherwise(dlit(0.0)).alias("tpr05")))


def all_methods(spark: SparkSession, metrics: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Metrics for every named method; a method without any finite score gets
    the guard value (0.0, 1.0, 0.0)."""
    names = names if names is not None else method_order(spark)
    return (names.join(metrics, "method", "left")
            .select("method", "method_order",
                    F.coalesce("auroc", dlit(0.0)).alias("auroc"),
                    F.coalesce("fpr95", dlit(1.0)).alias("fpr95"),
                    F.coalesce("tpr05", dlit(0.0)).alias("tpr05")))
