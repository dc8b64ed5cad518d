"""Labelled snippet sources.

``snippets(doc_id BIGINT, text STRING, label INT, variant STRING)`` is the
input of every score.  ``label`` is 1 for a text the model was trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import VARIANTS

SNIPPET_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("variant", T.StringType(), True),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def member_rule(doc_id: Column) -> Column:
    """Ground-truth split of the document table: even ids are the corpus the
    model is estimated from (members), odd ids are held out."""
    return (F.pmod(doc_id, F.lit(2)) == 0).cast("int")


def documents_snippets(spark: SparkSession, sf_dir: str, variant: str = "documents") -> DataFrame:
    """Every document of the ``documents`` table as a labelled snippet."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        member_rule(F.col("doc_id")).alias("label"),
        F.lit(variant).alias("variant"),
    )


def benchmark_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as unlabelled snippets (for contamination scores)."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.lit(None).cast("int").alias("label"),
        F.lit("benchmark").alias("variant"),
    )


def select_fields(df: DataFrame, text_col: str = "input", label_col: str = "label",
                  id_col: str = "doc_id") -> DataFrame:
    """Project a raw labelled set onto the snippet schema.  Sets without an id
    column get one from the row's place in the files."""
    ident = F.col(id_col).cast("long") if id_col in df.columns else F.monotonically_increasing_id()
    return df.select(
        ident.alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(label_col).cast("int").alias("label"),
    )


def load_snippets(spark: SparkSession, variant: str, plain_path: str, paraphrased_path: str,
                  fmt: str = "parquet", text_col: str = "input", label_col: str = "label",
                  id_col: str = "doc_id", schema: str | T.StructType | None = None) -> DataFrame:
    """Load one named variant (with ``schema``, without a pass to infer it).  Names containing ``paraphrased`` come from the
    second source, the others from the first; each source holds one folder
    (or partition) per variant name.  An unknown name is an error."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; choose one of {VARIANTS}")
    base = paraphrased_path if "paraphrased" in variant else plain_path
    reader = spark.read.format(fmt).option("header", "true")
    raw = (reader.schema(schema) if schema is not None else reader).load(f"{base.rstrip('/')}/{variant}")
    return select_fields(raw, text_col, label_col, id_col).withColumn("variant", F.lit(variant))
