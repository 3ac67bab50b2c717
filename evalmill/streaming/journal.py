"""The judgment journal as a stream, and event windows beyond the reference."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import last_wins


def journal(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's rows to a journal, one folder for each (checkpoint, batch).

    A batch that runs again after a failure replaces its own folder, and a new
    checkpoint begins folders of its own, so nothing is doubled or forgotten.
    Only new rows are written; ``last_judgments`` reads what counts.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_judgments(spark: SparkSession, path: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in a journal."""
    return last_wins(spark.read.schema(schema).parquet(f"{path}/run=*/batch=*"), keys, order)


def completed(judgments: DataFrame) -> DataFrame:
    """The trials that each rater has judged."""
    return judgments.select("rater", "pair_id", "dimension").distinct()


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums of values by window and type; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
