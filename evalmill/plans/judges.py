"""Queries over several judges at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import judges as J
from ..operators import table_judges as T
from ..operators.scoring import mcnemar
from . import bridge as B

_ITEMS = "doc_id AS item_id, 'p' || CAST(doc_id % 97 AS {s}) AS page_id, lang AS track, CASE WHEN doc_id % 3 = 0 THEN 'L1' ELSE 'L4' END AS level, doc_id % 3 AS criterion, CASE WHEN n_chars % 3 = 0 THEN 'no' ELSE 'yes' END AS truth"


@register(
    f"""WITH i AS (SELECT {_ITEMS.format(s="VARCHAR")} FROM documents),
    m AS (SELECT track, level, truth, count(*) AS n, min(item_id) AS f FROM i WHERE item_id % 2 = 0 GROUP BY 1, 2, 3), fit AS (SELECT track, level, arg_max(truth, (n, -f)) AS answer FROM m GROUP BY 1, 2)
    SELECT 'random' AS judge, item_id, CASE WHEN substr(md5(CAST(item_id AS VARCHAR)), 1, 1) < '8' THEN 'yes' ELSE 'no' END AS answer FROM i
    UNION ALL SELECT 'rules', item_id, coalesce(CASE WHEN item_id % 97 % 3 = 0 AND item_id % 97 < 75 THEN (SELECT CASE WHEN any_value(n_regionkey) < 2 THEN 'no' ELSE 'yes' END FROM nation WHERE n_nationkey = item_id % 97 // 3) END, 'unknown') FROM i
    UNION ALL SELECT 'majority', i.item_id, coalesce(fit.answer, 'unknown') FROM i LEFT JOIN fit ON fit.track = i.track AND fit.level = i.level
    UNION ALL SELECT 'canned', item_id, CASE WHEN item_id % 4 = 1 THEN 'no' ELSE 'unknown' END FROM i"""
)
def judged_items(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of four judges, each from the tables that it requires."""
    items = B.read(spark, sf, "documents").selectExpr(*_ITEMS.format(s="STRING").split(", "))
    tables = {
        "report": B.read(spark, sf, "nation").selectExpr("'p' || CAST(n_nationkey * 3 AS STRING) AS page_id", "CASE WHEN n_regionkey < 2 THEN 'no' ELSE 'yes' END AS said"),
        "dev": items.where("item_id % 2 = 0"),
        "answers": items.where("item_id % 4 = 1").select("item_id", F.lit("no").alias("answer")),
    }
    return J.run_judges(items, ["random", "rules", "majority", "canned"], tables)


@register(
    f"""WITH {B.FACT}, ok AS (SELECT judge, item_id, truth = predicted AS ok FROM fact WHERE answered), j AS (SELECT DISTINCT judge FROM ok),
    p AS (SELECT a.judge AS x, b.judge AS y, count(*) AS shared, count(*) FILTER (a.ok AND NOT b.ok) AS b, count(*) FILTER (NOT a.ok AND b.ok) AS c FROM ok a JOIN ok b ON a.item_id = b.item_id WHERE a.judge <> b.judge GROUP BY 1, 2)
    SELECT j.judge AS judge_a, k.judge AS judge_b, p.shared, p.b, p.c FROM j CROSS JOIN j k LEFT JOIN p ON p.x = j.judge AND p.y = k.judge"""
)
def leaderboard_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every judge against every other, null against itself."""
    ok = B.fact(spark, sf).where("answered").select("judge", "item_id", (F.col("truth") == F.col("predicted")).alias("ok"))
    names = ok.select("judge").distinct()
    grid = names.withColumnRenamed("judge", "judge_a").crossJoin(names.withColumnRenamed("judge", "judge_b"))
    return grid.join(mcnemar(ok).select("judge_a", "judge_b", "shared", "b", "c"), ["judge_a", "judge_b"], "left")


@register("SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 13 + 1 END AS w, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 1000 + 256 END AS h FROM part")
def image_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Widths and heights in the headers of PNG bytes; none in other files."""
    signature = "CASE WHEN p_partkey % 4 <> 0 THEN '89504E470D0A1A0A' ELSE 'FFD8FFE000104A46' END"
    content = f"unhex(concat({signature}, '0000000D49484452', lpad(hex(p_size * 13 + 1), 8, '0'), lpad(hex(p_partkey % 1000 + 256), 8, '0'), '0806000000')) AS content"
    rows = B.read(spark, sf, "part").selectExpr("p_partkey", content)
    return rows.select("p_partkey", J.png_size(F.col("content")).alias("s")).select("p_partkey", "s.w", "s.h")


def _long_page(item: dict, assets: dict) -> T.Verdict:
    """no where the page's report names more than its limit."""
    report = assets["report"]
    return ("unknown", None) if report is None else ("no" if report["found"] > 1 else "yes", min(1.0, report["found"] / 4))


@register(
    f"""WITH i AS (SELECT {_ITEMS.format(s="VARCHAR")} FROM documents), a AS (SELECT item_id, page_id, track, CASE WHEN item_id % 4 = 1 THEN 'no' ELSE 'unknown' END AS replay, CASE WHEN item_id % 4 = 1 THEN 0.75::DOUBLE END AS c,
      CASE WHEN n_nationkey IS NULL THEN 'unknown' WHEN n_regionkey > 1 THEN 'no' ELSE 'yes' END AS report, CAST(n_regionkey AS DOUBLE) / 4 AS r FROM i LEFT JOIN nation ON i.page_id = 'p' || CAST(n_nationkey * 3 AS VARCHAR))
    SELECT 'replayed' AS judge, CAST(item_id AS VARCHAR) AS item_id, replay AS answer, c AS confidence FROM a UNION ALL SELECT 'report', CAST(item_id AS VARCHAR), report, r FROM a
    UNION ALL SELECT 'routed', CAST(item_id AS VARCHAR), CASE WHEN track = 'en' THEN report ELSE replay END, CASE WHEN track = 'en' THEN r ELSE c END FROM a"""
)
def page_judges(spark: SparkSession, sf: str) -> DataFrame:
    """Three judges in Python over all items: one that replays, one that reads a page's report, and one that routes by track."""
    items = B.read(spark, sf, "documents").selectExpr(*_ITEMS.format(s="STRING").split(", "))
    tables = {
        "answers": items.where("item_id % 4 = 1").select("item_id", F.lit("no").alias("answer"), F.lit(0.75).alias("confidence")),
        "report": B.read(spark, sf, "nation").selectExpr("'p' || CAST(n_nationkey * 3 AS STRING) AS page_id", "n_regionkey AS found"),
        "unused": items.where(F.raise_error(F.lit("nobody requires this")).isNotNull()),
    }
    replay, report = T.PageJudge("replayed", ("answers",), T.replayed), T.PageJudge("report", ("report",), _long_page)
    return T.run_page_judges(items, [replay, report, T.routed("routed", {"en": report}, rest=replay)], tables).drop("error")
