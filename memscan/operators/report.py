"""Result table, leaderboard and percent formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_TOP_K
from ..functions.text import format_percent, parse_percent


def result_table(metrics: DataFrame) -> DataFrame:
    """method, method_order, the three metrics as DOUBLE and as "93.1%"."""
    return metrics.select(
        "method", "method_order", "auroc", "fpr95", "tpr05",
        format_percent(F.col("auroc")).alias("auroc_pct"),
        format_percent(F.col("fpr95")).alias("fpr95_pct"),
        format_percent(F.col("tpr05")).alias("tpr05_pct"))


def top_methods(results: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Top-k by the *displayed* (rounded) AUROC; ties keep method order."""
    return (results.withColumn("auroc_rank_value", parse_percent(F.col("auroc_pct")))
            .orderBy(F.col("auroc_rank_value").desc(), F.col("method_order").asc())
            .limit(k)
            .select("method", F.col("auroc_pct").alias("auroc"), F.col("fpr95_pct").alias("fpr95"),
                    F.col("tpr05_pct").alias("tpr05"), "method_order"))
