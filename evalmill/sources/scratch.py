"""Folders that all executors can read, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset: on a cluster the warehouse, which has to be on a file
    system that all machines share, or this is an error; where Spark runs in this
    process alone, a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext
    if not app.master.startswith("local") or app.master.startswith("local-cluster"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        place = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            raise RuntimeError(f"tables between steps would go to {warehouse} on each machine: set spark.checkpoint.dir to a folder that all executors share")
        return warehouse
    if app.applicationId not in _own:
        _own[app.applicationId] = "file://" + tempfile.mkdtemp(prefix="evalmill-")
    return _own[app.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_folder(spark)}/evalmill/{name}-{uuid.uuid4().hex}"


def tasks_for(rows: DataFrame) -> int:
    """Tasks of a step that needs more of them than Spark would choose by what is read."""
    app = rows.sparkSession
    return max(int(app.conf.get("spark.sql.shuffle.partitions")), 4 * app.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by columns over a fixed number of tasks, for steps whose work is far more than the bytes they read."""
    return rows.repartition(tasks_for(rows), *by)


#: Lets go of what a query has shuffled as soon as it ends, and not when the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back, which cuts its lineage; what was shuffled for it goes at once."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)
