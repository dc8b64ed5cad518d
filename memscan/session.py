"""Session set-up and stage materialisation.

Stage tables are written as Parquet under the shared folder the cluster names
in ``spark.checkpoint.dir``; a lost executor then costs a task retry, not a
recomputation of the whole lineage.  Only when the setting is absent (local
runs, tests) do we pick a fresh folder of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "memscan") -> SparkSession:
    """Session for local runs and tests.  On a cluster, use the cluster's."""
    master = master or os.environ.get("MEMSCAN_MASTER", "local[8]")
    b = SparkSession.builder
    ev = os.environ.get("MEMSCAN_EVENT_LOG_DIR")
    if ev:   # stage and task times for profiling, written to a scratch folder
        b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", ev)
    spark = (
        b.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MEMSCAN_DRIVER_MEM", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``memscan`` importable in Python workers (pandas UDF,
    mapInPandas) by adding a zip of the package with ``addPyFile``, once per
    application.  The zip is built on the driver; Spark distributes it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="memscan-pkg-"), "memscan.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(zpath)
    _shipped.add(app)


SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    # the driver collects what is broadcast; file sizes are those of compressed columns
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.autoBroadcastJoinThreshold": "10m",
}


def tune(spark: SparkSession) -> None:
    """Runtime settings the plans rely on (safe to call on any session)."""
    ship_package(spark)
    # AQE: runtime join re-planning (broadcast only when the shuffle statistics
    # prove the side small), partition coalescing and skew-join splitting.
    # A setting of the user's session is left as it is.
    given = {r["key"] for r in spark.sql("SET").collect()}
    for key, value in SETTINGS.items():
        if key not in given:
            spark.conf.set(key, value)


def by_shuffle(df: DataFrame, how: str = "merge") -> DataFrame:
    """A join side that grows with the input, never collected by the driver:
    10 MB of compressed columns are 90 MB as a hash table there.  ``shuffle_hash``
    spares the other side a sort where this one is small in each partition."""
    return df.hint(how)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only if none is set."""
    d = spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="memscan-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir() or d
    return d


#: Spark then deletes a query's shuffle files as it ends; the next garbage collection can be a stage too late
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class StageStore:
    """Writes named stage tables once per run and reads them back.

    Reading the Parquet back gives the optimizer file statistics (so a small
    table can be broadcast on a proven size) and column pruning, which an
    RDD checkpoint would not.
    """

    def __init__(self, spark: SparkSession, run_id: str | None = None):
        self.spark = spark
        root = checkpoint_root(spark)
        self.run_id = run_id or uuid.uuid4().hex
        self.base = f"{root.rstrip('/')}/memscan-stages/{self.run_id}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(*partition_by)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            w.parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))   # an empty table has no file to tell it

    def drop(self, name: str) -> None:
        """Delete a stage whose readers are all written themselves."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def within(self, folder: str) -> "StageStore":
        """The same store, with names of a folder of their own."""
        return StageStore(self.spark, f"{self.run_id}/{folder}")
