"""Queries of planned spending and planned calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import estimate as E
from . import bridge as B

_PRICES = [
    ("tiled", 2.5, 10.0, 0.5, None, 0, 512, True, "tiles", 85, 170, None, None), ("cropped", 0.5, 3.0, 0.5, None, 2700, 4096, True, "crop", None, None, None, None),
    ("patched", 2.0, 10.0, 0.5, 0.055, 0, 512, True, "patch", None, None, 28, 1568), ("fine", 0.2, 1.2, 1.0, None, 100, 1024, True, "patch", None, None, 32, None),
]
_PRICE_SCHEMA = "model string, price_in double, price_out double, discount double, fee double, reasoning long, budget long, batch boolean, rule string, base long, tile long, patch long, most long"
#: Items and pictures of both engines: a pair for each sixth document, a picture for most pages.
_ITEM = "doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'a11y' WHEN 1 THEN 'layout' ELSE 'referring' END AS track, CASE doc_id % 6 WHEN 5 THEN 'design_pair' WHEN 4 THEN 'L5' ELSE concat('L', doc_id % 4 + 1) END AS level, CASE WHEN doc_id % 4 = 1 THEN 'mobile' ELSE 'desktop' END AS viewport, n_chars AS prompt_chars"
_SIZE = "150 + doc_id % 61 * 37 AS w, 200 + doc_id % 47 * 53 AS h"


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = B.read(spark, sf, "documents").select("doc_id", "n_chars")
    items = docs.selectExpr(*_split(_ITEM), "CASE WHEN doc_id % 6 = 5 THEN array(doc_id, doc_id - 1) ELSE array(doc_id) END AS page_ids")
    pictures = docs.where("doc_id % 7 <> 3").selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 4 = 1 THEN 'mobile' ELSE 'desktop' END AS viewport", *_split(_SIZE), "concat('shots/', doc_id, '.png') AS path")
    fallback = spark.createDataFrame([("desktop", 1280, 1600), ("mobile", 390, 1200)], "viewport string, w long, h long")
    return items, pictures, fallback, spark.createDataFrame(_PRICES, _PRICE_SCHEMA)


def _split(text: str) -> list[str]:
    return [part + " AS " + name for part, name in (p.rsplit(" AS ", 1) for p in _commas(text))]


def _commas(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append("")
        else:
            parts[-1] += ch
    return [p.strip() for p in parts]


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) if not isinstance(v, float) else f"{v}::DOUBLE" for v in row) + ")" for row in _PRICES)
_SENT = f"""p AS (SELECT * FROM (VALUES {_VALUES}) v(model, price_in, price_out, discount, fee, reasoning, budget, batch, rule, base, tile, patch, most)),
    i AS (SELECT {_ITEM}, CASE WHEN doc_id % 6 = 5 THEN [doc_id, doc_id - 1] ELSE [doc_id] END AS page_ids FROM documents), k AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 1 THEN 'mobile' ELSE 'desktop' END AS viewport, {_SIZE} FROM documents WHERE doc_id % 7 <> 3),
    e AS (SELECT item_id, track, level, viewport, unnest(page_ids) AS page_id FROM i), s AS (SELECT e.*, k.w IS NOT NULL AS exact, CAST(coalesce(k.w, CASE e.viewport WHEN 'mobile' THEN 390 ELSE 1280 END) AS DOUBLE) AS w, CAST(coalesce(k.h, CASE e.viewport WHEN 'mobile' THEN 1200 ELSE 1600 END) AS DOUBLE) AS h FROM e LEFT JOIN k USING (page_id, viewport)),
    f AS (SELECT *, CASE WHEN greatest(w, h) > 2048 THEN 2048.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS fit, floor(least(w, h) / 1.5) AS unit FROM s), g AS (SELECT *, CASE WHEN least(w * fit, h * fit) > 768 THEN 768.0::DOUBLE / least(w * fit, h * fit) ELSE 1.0::DOUBLE END AS short FROM f),
    t AS (SELECT g.item_id, track, level, viewport, exact, model, CAST(CASE rule WHEN 'tiles' THEN base + tile * ceil(w * fit * short / 512) * ceil(h * fit * short / 512) WHEN 'crop' THEN CASE WHEN w <= 384 AND h <= 384 THEN 258 ELSE 258 * ceil(w / unit) * ceil(h / unit) END
      ELSE least(ceil(w / patch) * ceil(h / patch), coalesce(most, 1000000000)) END AS BIGINT) AS tokens FROM g, p)"""


@register(
    f"""WITH {_SENT}, im AS (SELECT model, viewport, sum(tokens)::BIGINT * 3 AS image_tokens, count(*) FILTER (exact) * 3 AS exact_images, count(*) FILTER (NOT exact) * 3 AS fallback_images FROM t GROUP BY 1, 2),
    x AS (SELECT viewport, count(*) AS items, count(*) * 3 AS calls, sum((prompt_chars + 3) // 4)::BIGINT * 3 AS text_tokens, sum(CASE level WHEN 'L1' THEN 40 WHEN 'L2' THEN 60 WHEN 'L3' THEN 60 WHEN 'L4' THEN 40 WHEN 'design_pair' THEN 40 ELSE 50 END)::BIGINT * 3 AS visible FROM i GROUP BY 1),
    j AS (SELECT im.*, items, calls, text_tokens + image_tokens AS input_tokens, visible, p.* EXCLUDE (model) FROM im JOIN x USING (viewport) JOIN p USING (model))
    SELECT model, viewport, items, calls, input_tokens, visible AS visible_tokens, calls * reasoning AS reasoning_tokens, visible + calls * reasoning AS billed_tokens, calls * budget AS budget_tokens, exact_images, fallback_images,
      round(discount * (input_tokens / 1e6::DOUBLE * price_in + (visible + calls * reasoning) / 1e6::DOUBLE * price_out) * (1 + coalesce(fee, 0)), 2) AS expected_usd, round(discount * (input_tokens / 1e6::DOUBLE * price_in + calls * budget / 1e6::DOUBLE * price_out) * (1 + coalesce(fee, 0)), 2) AS budget_usd FROM j"""
)
def spend_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and dollars of each model and viewport, with exact and fallback images, at three runs."""
    items, pictures, fallback, prices = _tables(spark, sf)
    return E.spend(E.token_sums(items, pictures, fallback, prices, runs=3), prices, ["viewport"])


@register(
    f"""WITH {_SENT}, c AS (SELECT item_id, string_agg(CAST(page_id AS VARCHAR), ' ' ORDER BY page_id) AS pages, count(*) FILTER (exact) AS paths, coalesce(string_agg(CAST(page_id AS VARCHAR) || ':' || viewport, ' ' ORDER BY page_id) FILTER (NOT exact), '') AS missing FROM s GROUP BY 1)
    SELECT item_id, run, pages, paths, missing FROM c, (SELECT unnest([0, 1, 2])::INT AS run)"""
)
def planned_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every planned call with its pages, how many pictures are there, and which are missing."""
    items, pictures, _, _ = _tables(spark, sf)
    rows = E.planned_calls(items, pictures, runs=3)
    pages = F.array_join(F.transform(F.sort_array("page_ids"), lambda x: x.cast("string")), " ")
    by_page = F.array_sort(F.transform("missing", lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("long").alias("page"), x.alias("name"))))
    missing = F.array_join(F.transform(by_page, lambda x: x["name"]), " ")
    return rows.select("item_id", "run", pages.alias("pages"), F.size("paths").cast("long").alias("paths"), missing.alias("missing"))
