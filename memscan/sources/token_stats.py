"""Per-token statistics computed elsewhere (by a large model) as an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# token_stats: one row per scored position i (predicting token i+1).
TOKEN_STATS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("lp", T.DoubleType(), True),       # log p(x[i+1] | x[..i])
    T.StructField("mu", T.DoubleType(), True),       # sum_v p ln p at i
    T.StructField("var", T.DoubleType(), True),      # sum_v p (ln p)^2 - mu^2 at i
    T.StructField("lp_xhat", T.DoubleType(), True),  # log-prob of the top-1 token at i
    T.StructField("T", T.IntegerType(), False),      # tokens in the snippet
])

# alt_stats: statistics of the sequence whose token i+1 is replaced by the
# top-1 prediction at i, at positions pos > i.  A missing row means "equal to
# the original statistics" (exact for models of bounded memory).
ALT_STATS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("i", T.IntegerType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("lp", T.DoubleType(), True),
    T.StructField("mu", T.DoubleType(), True),
    T.StructField("var", T.DoubleType(), True),
])


def load_token_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_STATS_SCHEMA).parquet(path)


def load_alt_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALT_STATS_SCHEMA).parquet(path)
