"""Queries over measurements: every decision rule, controls, items, secondary labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import decisions as D
from ..sources.scratch import written
from . import bridge as B

_CLASSES = list(D.CRITERION)
#: Each column of a measurement, as SQL that both engines read alike, over a (line, class number) row.
_FIELDS = {
    "measured": "v % 11 <> 0",
    "fg": "CASE v % 5 WHEN 0 THEN '#777777' WHEN 1 THEN 'rgb(10, 20, 30)' WHEN 2 THEN '#abc' WHEN 3 THEN 'rgba(0, 0, 0, 0.5)' ELSE 'red' END",
    "bg": "CASE v % 3 WHEN 0 THEN '#FFFFFF' WHEN 1 THEN 'rgb(200,200,200)' ELSE '#767676' END",
    "font_size": "CAST(12 + v % 14 AS DOUBLE)",
    "font_weight": "CASE v % 4 WHEN 0 THEN '700' WHEN 1 THEN 'bold' WHEN 2 THEN 'normal' ELSE '400' END",
    "has_alt": "v % 3 <> 0",
    "alt": "CASE v % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Photo.JPG' WHEN 3 THEN 'img_12' ELSE 'a cat' END",
    "present": "v % 4 <> 0",
    "labelled": "v % 2 = 0",
    "skips": "CAST(v % 3 AS BIGINT)",
    "width": "CAST(v % 40 AS DOUBLE)",
    "height": "CAST(v % 31 AS DOUBLE)",
    "circle_hits": "v % 2 = 1",
    "p_threshold": "CASE WHEN v % 4 = 0 THEN CAST(v % 60 AS DOUBLE) END",
    "p_inline": "v % 10 = 0",
    "p_equivalent": "CASE WHEN v % 9 = 0 THEN true END",
    "p_user_agent": "v % 12 = 0",
    "p_essential": "v % 13 = 0",
    "p_rectangular": "v % 5 <> 0",
    "active": "v % 3 <> 1",
    "obscurer": "v % 2 = 0",
    "entirely_hidden": "v % 4 <> 2",
    "p_author": "v % 7 <> 0",
    "p_opened": "v % 6 = 0",
    "p_configurable": "v % 8 = 0",
    "p_reveal": "false",
    "intersection": "CAST((v * 7) % 400 AS DOUBLE)",
    "covered": "v % 3 <> 0",
    "target_area": "CAST((v * 3) % 500 AS DOUBLE)",
    "scroll_height": "CAST(100 + v % 9 AS DOUBLE)",
    "client_height": "CAST(101 AS DOUBLE)",
    "scroll_width": "CAST(1275 + v % 14 AS DOUBLE)",
    "client_width": "CAST(1279 AS DOUBLE)",
    "device_width": "CAST(1280 AS DOUBLE)",
    "right": "CAST(1270 + v % 15 AS DOUBLE)",
    "left": "CAST(v % 7 - 3 AS DOUBLE)",
    "m_right": "CAST(380 + v % 20 AS DOUBLE)",
    "m_device_width": "CAST(390 AS DOUBLE)",
    "m_scroll_width": "CAST(388 + v % 6 AS DOUBLE)",
    "target_right": "CASE WHEN v % 5 <> 0 THEN CAST(1278 + v % 7 AS DOUBLE) END",
    "target_left": "CASE WHEN v % 5 <> 0 THEN CAST(v % 5 - 2 AS DOUBLE) END",
    "text_overflow": "CASE WHEN v % 3 = 0 THEN 'clip' ELSE 'ellipsis' END",
    "overflow_x": "CASE v % 4 WHEN 0 THEN 'visible' WHEN 1 THEN 'hidden' WHEN 2 THEN 'clip' ELSE 'auto' END",
    "overflow": "CASE WHEN v % 8 = 3 THEN 'hidden' ELSE 'visible' END",
    "delta": "CAST(v % 17 AS DOUBLE)",
    "value": "CASE WHEN v % 2 = 0 THEN 'left' ELSE 'right' END",
    "p_expected": "CASE WHEN v % 3 = 0 THEN 'left' ELSE 'right' END",
    "box": "CASE WHEN v % 5 <> 2 THEN CAST(v % 90 AS BIGINT) END",
    "controlled": "v % 2 = 0",
}
_NAMES = ", ".join(f"'{c}'" for c in _CLASSES)
_SQL_CLASS = f"list_extract([{_NAMES}], CAST(n + 1 AS INTEGER))"
_V = "l_orderkey * 3 + l_linenumber * 5 + l_partkey"


def _columns(dialect: str = "spark") -> str:
    return ", ".join(f'{sql} AS "{name}"' if dialect == "duck" else f"{sql} AS `{name}`" for name, sql in _FIELDS.items())


MEASURED = f"""lines AS (SELECT 'p' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS page_id, (l_orderkey + l_linenumber * 7) % 19 AS n, {_V} AS v FROM lineitem),
meas AS (SELECT page_id, {_SQL_CLASS} AS defect_class, {_columns("duck")} FROM lines),
hexed AS (SELECT *, CASE WHEN fg = '#abc' THEN [170, 187, 204] WHEN fg = '#777777' THEN [119, 119, 119] WHEN fg LIKE 'rgb(%' THEN [10, 20, 30] WHEN fg LIKE 'rgba%' THEN [0, 0, 0] END AS f,
  CASE WHEN bg = '#FFFFFF' THEN [255, 255, 255] WHEN bg = '#767676' THEN [118, 118, 118] ELSE [200, 200, 200] END AS b FROM meas),
lin AS (SELECT *, list_transform(f, lambda c: CASE WHEN c / 255.0::DOUBLE <= 0.03928 THEN c / 255.0::DOUBLE / 12.92 ELSE pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) AS fl,
  list_transform(b, lambda c: CASE WHEN c / 255.0::DOUBLE <= 0.03928 THEN c / 255.0::DOUBLE / 12.92 ELSE pow((c / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) AS bl FROM hexed),
lum AS (SELECT *, 0.2126::DOUBLE * fl[1] + 0.7152::DOUBLE * fl[2] + 0.0722::DOUBLE * fl[3] AS l1, 0.2126::DOUBLE * bl[1] + 0.7152::DOUBLE * bl[2] + 0.0722::DOUBLE * bl[3] AS l2 FROM lin),
m AS (SELECT *, (greatest(l1, l2) + 0.05) / (least(l1, l2) + 0.05) AS ratio, font_size >= 24 OR (font_size >= 18.66 AND (font_weight IN ('700', 'bold'))) AS is_large FROM lum),
fired AS (SELECT *, measured AND coalesce(CASE defect_class
  WHEN 'contrast:degrade' THEN f IS NOT NULL AND ratio < CASE WHEN is_large THEN 3.0 ELSE 4.5 END WHEN 'alt:strip' THEN NOT has_alt WHEN 'alt:garble' THEN alt IN ('Photo.JPG', 'img_12')
  WHEN 'label:orphan' THEN present AND NOT labelled WHEN 'heading:skip' THEN skips > 0
  WHEN 'target:shrink' THEN (width < coalesce(p_threshold, 24) OR height < coalesce(p_threshold, 24)) AND circle_hits AND NOT (p_inline OR coalesce(p_equivalent, false) OR p_user_agent OR p_essential) AND p_rectangular
  WHEN 'focus:obscure' THEN active AND obscurer AND entirely_hidden AND p_author AND NOT p_opened AND NOT p_configurable AND NOT p_reveal
  WHEN 'chart:label-occlude' THEN covered AND intersection > coalesce(p_threshold, 1) WHEN 'overlap:shift' THEN intersection > coalesce(p_threshold, 200) WHEN 'clip:overflow' THEN scroll_height > client_height + 2
  WHEN 'overflow:page' THEN scroll_width > device_width + 1 WHEN 'truncate:ellipsis' THEN text_overflow = 'ellipsis' AND (overflow_x IN ('hidden', 'clip') OR overflow = 'hidden') AND scroll_width > client_width + 2
  WHEN 'protrude:viewport' THEN "right" > device_width + 1 OR "left" < -1 WHEN 'z:occlude' THEN covered AND intersection >= 0.6::DOUBLE * greatest(target_area, 1)
  WHEN 'align:break' THEN delta > coalesce(p_threshold, 8) WHEN 'responsive:fixed-width' THEN m_right > m_device_width + 1 AND "right" <= device_width + 1 ELSE value = p_expected END, false) AS fires FROM m)"""

_CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.CRITERION.items())
_SHOWN = f"""list_distinct_ordered AS (SELECT *, CASE defect_class {_CODES} END AS criterion, CASE WHEN defect_class = 'label:orphan' THEN ['wcag:1.3.1'] WHEN defect_class = 'overlap:shift' THEN ['layout:occlusion']
  WHEN defect_class IN ('z:occlude', 'chart:label-occlude') THEN ['redecheck:element-collision'] WHEN defect_class = 'truncate:ellipsis' THEN ['redecheck:element-protrusion']
  WHEN defect_class = 'overflow:page' AND coalesce(target_right > device_width + 1 OR target_left < -1, false) THEN ['redecheck:viewport-protrusion'] WHEN defect_class = 'protrude:viewport' AND scroll_width > device_width + 1 THEN ['layout:page-overflow']
  WHEN defect_class = 'responsive:fixed-width' THEN list_concat(CASE WHEN m_right > m_device_width + 1 THEN ['redecheck:viewport-protrusion'] ELSE [] END, CASE WHEN m_scroll_width > m_device_width + 1 THEN ['layout:page-overflow'] ELSE [] END) ELSE [] END AS more FROM fired),
shown AS (SELECT *, list_concat([criterion], more) AS criteria FROM list_distinct_ordered WHERE fires)"""


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """One measurement for each line, its class in turn, as a written table: the rules read its columns, not the expressions they come from."""
    rows = B.read(spark, sf, "lineitem").selectExpr("concat('p', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS page_id", "(l_orderkey + l_linenumber * 7) % 19 AS n", f"{_V} AS v")
    rows = rows.selectExpr("page_id", f"element_at(array({_NAMES}), CAST(n + 1 AS INT)) AS defect_class", *(f"{sql} AS `{name}`" for name, sql in _FIELDS.items()))
    return written(rows, "measurements")


@register(f"WITH {MEASURED} SELECT page_id, defect_class, measured, fires FROM fired")
def decision_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each planted defect shows, for all nineteen classes."""
    return D.judged(measurements(spark, sf)).select("page_id", "defect_class", "measured", "fires")


@register(f"WITH {MEASURED} SELECT page_id, CASE WHEN f IS NOT NULL THEN round(ratio, 9) END AS ratio, is_large FROM m WHERE defect_class = 'contrast:degrade'")
def color_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Contrast of text and ground by CSS colours, and whether the text is large; null for a colour that can't be read."""
    rows = measurements(spark, sf).where("defect_class = 'contrast:degrade'")
    return D.with_contrast(rows, F.lit(True)).select("page_id", F.round("_contrast", 9).alias("ratio"), D.large_text(F.col("font_size"), F.col("font_weight")).alias("is_large"))


@register(f"WITH {MEASURED} SELECT defect_class, count(*) AS attempted, count(*) FILTER (fires) AS verified, count(*) FILTER (NOT fires) AS discarded, count(*) FILTER (measured AND NOT fires) AS controls FROM fired GROUP BY 1")
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    """What a build tried, verified and discarded, by class, and the controls it may keep."""
    rows = D.judged(measurements(spark, sf))
    return rows.groupBy("defect_class").agg(F.count("*").alias("attempted"), F.count_if("fires").alias("verified"), F.count_if(~F.col("fires")).alias("discarded"), F.count_if(F.col("measured") & ~F.col("fires")).alias("controls"))


@register(f"WITH {MEASURED} SELECT page_id, defect_class FROM fired WHERE measured AND NOT fires")
def verified_controls(spark: SparkSession, sf: str) -> DataFrame:
    return D.verified_controls(measurements(spark, sf)).select("page_id", "defect_class")


@register(f"WITH {MEASURED}, {_SHOWN} SELECT page_id, defect_class, array_to_string(criteria, ' ') AS criteria FROM shown")
def secondary_labels(spark: SparkSession, sf: str) -> DataFrame:
    return D.verified(measurements(spark, sf)).select("page_id", "defect_class", F.concat_ws(" ", D.criteria_shown()).alias("criteria"))


@register(
    f"""WITH {MEASURED}, {_SHOWN}, k AS (SELECT *, unnest(list_filter(['L1', CASE WHEN controlled THEN 'L2' END, CASE WHEN box IS NOT NULL THEN 'L3' END], lambda x: x IS NOT NULL)) AS level FROM shown)
    SELECT page_id || ':' || defect_class || ':' || lower(level) AS item_id, page_id, defect_class, level, criterion,
      CASE level WHEN 'L1' THEN 'no' WHEN 'L2' THEN CAST(to_json(criteria) AS VARCHAR) ELSE '[' || CAST(box AS VARCHAR) || ',1,2,3]' END AS truth FROM k"""
)
def items_for_mutation(spark: SparkSession, sf: str) -> DataFrame:
    """Page, label-set and box items of each defect that shows."""
    box = F.when(F.col("box").isNotNull(), F.array(F.col("box"), F.lit(1), F.lit(2), F.lit(3)))
    return D.items_of(D.verified(measurements(spark, sf)).withColumn("box", box))


@register(
    f"""WITH {MEASURED}, c AS (SELECT *, CASE defect_class {_CODES} END AS criterion, replace(page_id, substr(page_id, strpos(page_id, '-')), '') AS page FROM fired WHERE measured AND NOT fires)
    SELECT page || ':' || criterion || ':clean' AS item_id, page AS page_id, criterion, min(defect_class) || ':clean-control' AS defect_class, 'yes' AS truth FROM c GROUP BY page, criterion"""
)
def clean_items(spark: SparkSession, sf: str) -> DataFrame:
    """One clean item for each (page, criterion), from the first class that vouches for it."""
    rows = D.verified_controls(measurements(spark, sf)).withColumn("page_id", F.split("page_id", "-")[0])
    return D.clean_items(rows)


@register(f"""WITH {MEASURED} SELECT page_id, CASE WHEN "right" > device_width + 1 THEN 'right' WHEN "left" < -1 THEN 'left' ELSE 'none' END AS edge FROM m WHERE defect_class = 'protrude:viewport'""")
def protruding_edges(spark: SparkSession, sf: str) -> DataFrame:
    return measurements(spark, sf).where("defect_class = 'protrude:viewport'").select("page_id", D.edge_out().alias("edge"))
