"""Items, results and judgments projected from the driver's tables, in Spark and in SQL.

Only integer arithmetic on ids is used, so both engines get the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = """gold AS (
  SELECT d.doc_id AS item_id, d.source AS page_id, 'L1' AS task_level, d.lang AS criterion,
         CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS truth, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
judges AS (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS judge)"""

RESULTS = (
    GOLD
    + """,
drawn AS (SELECT *, (item_id * 37 + judge * 101 + n_chars) % 100 AS h FROM gold, judges WHERE (item_id + judge) % 23 <> 0),
results AS (
  SELECT judge, item_id, 0 AS ord, CAST((h * 7) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
         CASE WHEN h < 8 THEN 'unknown' WHEN h < 12 THEN 'Maybe ' WHEN h < 30 + 10 * judge THEN CASE WHEN truth = 'yes' THEN 'no' ELSE 'yes' END ELSE truth END AS answer
  FROM drawn
  UNION ALL SELECT judge, item_id, 1, CAST(0.5 AS DOUBLE), 'no' FROM drawn WHERE item_id % 17 = 0)"""
)

FACT = (
    RESULTS
    + """,
last AS (SELECT judge, item_id, arg_max(answer, ord) AS answer, arg_max(confidence, ord) AS confidence FROM results GROUP BY 1, 2),
fact AS (
  SELECT j.judge, g.item_id, g.page_id, g.task_level, g.criterion, g.truth, l.confidence, l.item_id IS NOT NULL AS answered,
         CASE WHEN l.item_id IS NULL THEN NULL WHEN lower(trim(l.answer)) IN ('yes', 'no') THEN lower(trim(l.answer))
              WHEN g.truth = 'yes' THEN 'no' ELSE 'yes' END AS predicted,
         coalesce(lower(trim(l.answer)) NOT IN ('yes', 'no'), false) AS ambiguous,
         coalesce(lower(trim(l.answer)) = 'unknown', false) AS abstained
  FROM gold g CROSS JOIN judges j LEFT JOIN last l ON l.judge = j.judge AND l.item_id = g.item_id)"""
)

COUNTS = """count(*) FILTER (truth = 'no' AND predicted = 'no') AS tp, count(*) FILTER (truth = 'yes' AND predicted = 'no') AS fp,
  count(*) FILTER (truth = 'no' AND predicted = 'yes') AS fn, count(*) FILTER (truth = 'yes' AND predicted = 'yes') AS tn,
  count(*) FILTER (NOT answered) AS missing, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (abstained) AS abstained"""

JUDGMENTS = """judgments AS (
  SELECT user_id % 8 AS rater, event_id % 200 AS pair_id, CASE event_id % 3 WHEN 0 THEN 'clarity' WHEN 1 THEN 'balance' ELSE 'polish' END AS dimension,
         CASE WHEN (event_id * 31 + user_id * 17) % 10 < 1 THEN 'cannot_tell'
           WHEN (event_id * 31 + user_id * 17) % 10 < 1 + (event_id % 3) * 2 AND (event_id % 5 <> 0 OR user_id % 8 > 5) THEN CASE WHEN event_id % 200 * 7 % 4 < 2 THEN 'B' ELSE 'A' END
           WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END ELSE CASE WHEN event_id % 200 * 7 % 4 < 2 THEN 'A' ELSE 'B' END END AS choice,
         CASE WHEN (event_id * 31 + user_id * 17) % 10 < 1 THEN 'cannot_tell' WHEN (event_id + user_id) % 2 = 0 THEN 'left' ELSE 'right' END AS side, event_id AS ord
  FROM events),
pairs AS (SELECT CAST(unnest(range(200)) AS BIGINT) AS pair_id),
typed AS (SELECT pair_id, CASE WHEN pair_id % 5 = 0 THEN 'validity' ELSE 'preference' END AS pair_type,
          CASE WHEN pair_id % 5 = 0 THEN CASE WHEN pair_id % 2 = 0 THEN 'A' ELSE 'B' END END AS known_worse FROM pairs),
prepared AS (
  SELECT j.rater, j.pair_id, j.dimension, arg_max(j.choice, j.ord) AS choice, arg_max(j.side, j.ord) AS side, max(j.ord) AS ord,
         any_value(t.pair_type) AS pair_type, any_value(t.known_worse) AS known_worse, bool_or(t.known_worse IS NOT NULL) AS is_catch
  FROM judgments j JOIN typed t ON j.pair_id = t.pair_id GROUP BY 1, 2, 3)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    truth = F.when(F.col("quality") == 1, "yes").otherwise("no")
    return rows.select(F.col("doc_id").alias("item_id"), F.col("source").alias("page_id"), F.lit("L1").alias("task_level"), F.col("lang").alias("criterion"), truth.alias("truth"), "n_chars")


def judges(spark: SparkSession) -> DataFrame:
    return spark.range(3).withColumnRenamed("id", "judge")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).withColumn("judge", F.explode(F.array(*(F.lit(j).cast("long") for j in range(3)))))
    h = (F.col("item_id") * 37 + F.col("judge") * 101 + F.col("n_chars")) % 100
    drawn = g.where((F.col("item_id") + F.col("judge")) % 23 != 0).withColumn("h", h)
    flipped = F.when(F.col("truth") == "yes", "no").otherwise("yes")
    answer = F.when(F.col("h") < 8, "unknown").when(F.col("h") < 12, "Maybe ").when(F.col("h") < 30 + 10 * F.col("judge"), flipped).otherwise(F.col("truth"))
    confidence = ((F.col("h") * 7) % 101).cast("double") / F.lit(100).cast("double")
    first = drawn.select("judge", "item_id", F.lit(0).alias("ord"), confidence.alias("confidence"), answer.alias("answer"))
    again = drawn.where("item_id % 17 = 0").select("judge", "item_id", F.lit(1).alias("ord"), F.lit(0.5).alias("confidence"), F.lit("no").alias("answer"))
    return first.union(again)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import scored_fact

    return scored_fact(gold(spark, sf_dir), results(spark, sf_dir), judges(spark))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    draw = (F.col("event_id") * 31 + F.col("user_id") * 17) % 10
    dim = F.when(F.col("event_id") % 3 == 0, "clarity").when(F.col("event_id") % 3 == 1, "balance").otherwise("polish")
    id_, liked = F.col("event_id"), F.col("event_id") % 200 * 7 % 4 < 2
    slip = (draw < 1 + (id_ % 3) * 2) & ((id_ % 5 != 0) | (F.col("user_id") % 8 > 5))
    better = F.when(id_ % 5 == 0, F.when(id_ % 2 == 0, "B").otherwise("A")).otherwise(F.when(liked, "A").otherwise("B"))
    choice = F.when(draw < 1, "cannot_tell").when(slip, F.when(liked, "B").otherwise("A")).otherwise(better)
    side = F.when(draw < 1, "cannot_tell").when((F.col("event_id") + F.col("user_id")) % 2 == 0, "left").otherwise("right")
    return e.select((F.col("user_id") % 8).alias("rater"), (F.col("event_id") % 200).alias("pair_id"), dim.alias("dimension"), choice.alias("choice"), side.alias("side"), F.col("event_id").alias("ord"))


def pairs(spark: SparkSession) -> DataFrame:
    p = F.col("id")
    worse = F.when(p % 5 == 0, F.when(p % 2 == 0, "A").otherwise("B"))
    return spark.range(200).select(p.alias("pair_id"), F.when(p % 5 == 0, "validity").otherwise("preference").alias("pair_type"), worse.alias("known_worse"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.preference import prepared as prepare

    return prepare(judgments(spark, sf_dir), pairs(spark))
