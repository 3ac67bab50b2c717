"""Tables that outlive a lineage, kept where all executors can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import scratch_path as new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: no lineage, no copy in executors' memory."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_prefix(df: DataFrame, prefix: str) -> str:
    """``prefix``, made longer until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix += "_"
    return prefix
