"""Result sinks: the formatted table as CSV (header, no index) and the
unformatted values as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def model_id_of(model_name: str) -> str:
    return model_name.split("/")[-1]


#: Name parts of the numeric modes; the first mode set names the run.
MODES = {"half": "_half", "int8": "_int8", "mixed_precision": "_mixed"}


def results_suffix(optimized: bool = True, clip_inf: bool = False, **modes: bool) -> str:
    """Path, then numeric mode; clipping is named with the half mode only."""
    mode = next((m for m in MODES if modes.get(m)), None)
    parts = ["_optimized" if optimized else "_original", MODES.get(mode, "")]
    return "".join(parts) + "_clipped" * (mode == "half" and clip_inf)


def results_name(model_name: str, dataset: str, **flags) -> str:
    return f"{model_id_of(model_name)}_{dataset}{results_suffix(**flags)}_results"


def write_one_file(df: DataFrame, path: str, **options) -> None:
    """Write a small table as one CSV file of exactly this name, on any file
    system Spark writes to.

    Tasks write into a folder of their own beside it, which Spark's committer
    makes safe against retried tasks; only after the job has succeeded is its
    one file renamed to ``path``.  So ``path`` is the old file, the whole new
    one or, if the driver dies between removing and renaming, missing; never a part."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        df.coalesce(1).write.options(**options).csv(folder)
        made = [s.getPath() for s in fs.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-")]
        if len(made) != 1:
            raise RuntimeError(f"{len(made)} files where one was expected")
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        if not fs.rename(made[0], target):
            raise RuntimeError(f"could not rename to {path}")
    finally:
        fs.delete(hadoop.Path(folder), True)


def write_results(results: DataFrame, output_dir: str, model_name: str, dataset: str, **flags) -> str:
    """Write the file ``{model}_{dataset}{suffix}_results.csv`` and a Parquet
    twin with the DOUBLE metrics.  Returns the CSV path."""
    name = results_name(model_name, dataset, **flags)
    base = output_dir.rstrip("/")
    table = results.orderBy("method_order")
    shown = table.select("method", F.col("auroc_pct").alias("auroc"), F.col("fpr95_pct").alias("fpr95"),
                         F.col("tpr05_pct").alias("tpr05"))
    write_one_file(shown, f"{base}/{name}.csv", header="true")     # 122 rows
    table.write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    return f"{base}/{name}.csv"
