"""Queries that write and read back: judgments with state, versions of a table, counted writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..sources import scans, versions
from ..sources.scratch import scratch_path
from ..streaming import judgments as J
from . import bridge as B


@register(f"WITH {B.JUDGMENTS} SELECT rater, pair_id, dimension, arg_max(choice, ord) AS choice, arg_max(side, ord) AS side, max(ord) AS ord FROM judgments GROUP BY 1, 2, 3")
def streamed_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """The last judgment of each trial, from a stream over files that stops halfway and goes on."""
    rows = B.judgments(spark, sf)
    arrived, out, check = (scratch_path(spark, n) for n in ("arrived", "journal", "state"))
    for half in (1, 0):  # the later ids come first, so that the others are late
        rows.where(F.pmod(F.floor(F.col("ord") / 50), F.lit(2)) == half).write.mode("append").parquet(arrived)
        stream = spark.readStream.schema(J.ROW).parquet(arrived)
        J.follow(stream, out, check).awaitTermination()
    return J.judged(spark, out)


_CHANGED = "source IN ('src1', 'src2')"


@register(f"SELECT doc_id AS item, source, CASE WHEN {_CHANGED} THEN n_chars + 1 ELSE n_chars END AS v FROM documents WHERE NOT ({_CHANGED} AND doc_id % 4 = 0) OR source IS NULL")
def versioned_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of a table of all documents, in which the rows of two sources were replaced one after the other."""
    path = scratch_path(spark, "versions")
    docs = B.read(spark, sf, "documents").selectExpr("doc_id AS item", "source", "n_chars AS v")
    versions.replace_all(spark, path, docs)
    for source in ("src1", "src2"):
        new = docs.where((F.col("source") == source) & (F.col("item") % 4 != 0)).withColumn("v", F.col("v") + 1)
        versions.replace_source(spark, path, new, source)
    versions.remove_versions(spark, path)
    return versions.read_version(spark, path, "item long, source string, v long")


@register(
    """WITH d AS (SELECT CASE WHEN n_chars > 3000 THEN 'too long' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents)
    SELECT unnest(['total', 'taken', 'too long', 'language', 'other']) AS outcome, unnest([count(*), count(*) FILTER (reason IS NULL), count(*) FILTER (reason = 'too long'), count(*) FILTER (reason = 'language'), 0]) AS n FROM d"""
)
def counted_write(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest took and skipped, counted by the write itself."""
    d = B.read(spark, sf, "documents").selectExpr("*", "CASE WHEN n_chars > 3000 THEN 'too long' WHEN lang <> 'en' THEN 'language' END AS reason")
    counts = scans.write_counted(d, scratch_path(spark, "ingested"), "reason", ["too long", "language"])
    return spark.createDataFrame(list(counts.items()), "outcome string, n long")
