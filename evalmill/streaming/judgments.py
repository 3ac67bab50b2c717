"""Judgments as a stream with one state for each trial: the last one counts, however rows arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scans import exists

KEYS = ["rater", "pair_id", "dimension"]
ROW = "rater long, pair_id long, dimension string, choice string, side string, ord long"
STATE = "choice string, side string, ord long"


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The key's row, if this batch has one that comes after the row of its state; the state becomes that row."""
    best = state.get if state.exists else None
    news = False
    for frame in frames:
        for choice, side, order in zip(frame["choice"], frame["side"], frame["ord"]):
            # Of rows of one order the greater choice and side count, so that no arrival order matters.
            row = (None if pd.isna(choice) else choice, None if pd.isna(side) else side, int(order))
            if best is None or _rank(row) > _rank(best):
                best, news = row, True
    if news:
        state.update(best)
        yield pd.DataFrame([(*key, *best)], columns=[*KEYS, "choice", "side", "ord"])


def _rank(row: tuple) -> tuple:
    choice, side, order = row
    return order, choice or "", side or ""


def latest_judgments(stream: DataFrame) -> DataFrame:
    """A stream of the judgments that become their trial's last one; late and repeated rows give nothing.

    ``stream`` has the columns of ROW; rows without a key part or an order are
    left out.  The state holds one row for each trial and is dealt by its key.
    """
    rows = stream.selectExpr("CAST(rater AS long) AS rater", "CAST(pair_id AS long) AS pair_id", "CAST(dimension AS string) AS dimension", "CAST(choice AS string) AS choice", "CAST(side AS string) AS side", "CAST(ord AS long) AS ord")
    rows = rows.where("rater IS NOT NULL AND pair_id IS NOT NULL AND dimension IS NOT NULL AND ord IS NOT NULL")
    return rows.groupBy(*KEYS).applyInPandasWithState(_latest, ROW, STATE, "update", GroupStateTimeout.NoTimeout)


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over all that has arrived and appends what changes, one folder a batch; begins again where a run of the same checkpoint ended.

    A batch that runs again replaces its own folder.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return latest_judgments(stream).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged(spark: SparkSession, path: str) -> DataFrame:
    """The last judgment of each trial, from what ``follow`` has written; empty where it has written nothing."""
    if not exists(spark, path):
        return spark.createDataFrame([], ROW)
    rows = spark.read.schema(ROW).parquet(f"{path}/run=*/batch=*")
    rank = F.struct("ord", F.coalesce("choice", F.lit("")), F.coalesce("side", F.lit("")))
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct("choice", "side", "ord"), rank).alias("last"))
    return last.select(*KEYS, "last.*")
