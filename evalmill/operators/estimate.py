"""What a run of image calls is planned to send and to cost, by model.

Prices are a short table with one row for each model: model, price_in and
price_out in dollars for a million tokens, discount (what a batch pays of it),
fee (added to the sum), reasoning (tokens a call is expected to think), budget
(most tokens a call may answer), batch (whether batches are offered) and the
model's image rule: ``rule`` is tiles, crop or patch, with base, tile, patch and
most as its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import rounded

# Tokens of an answer by level, of any other level, and characters to a token.
ANSWER_TOKENS, OTHER_ANSWER, CHARS = {"L1": 40, "L2": 60, "L3": 60, "L4": 40, "design_pair": 40}, 50, 4
#: Fixed values of the image rules: the box and the short side that tiles are cut from, their side, and the small image and the unit of crops.
BOX_PX, SHORT_PX, TILE_PX, SMALL_PX, CROP, CROP_TOKENS = 2048, 768, 512, 384, 1.5, 258


def _by_tiles(w: Column, h: Column) -> Column:
    """Number of tiles after the image is made to fit the box, and then its short side."""
    w, h = w.cast("double"), h.cast("double")
    fit = F.when(F.greatest(w, h) > BOX_PX, F.lit(float(BOX_PX)) / F.greatest(w, h)).otherwise(1.0)
    w, h = w * fit, h * fit
    short = F.when(F.least(w, h) > SHORT_PX, F.lit(float(SHORT_PX)) / F.least(w, h)).otherwise(1.0)
    return F.ceil(w * short / TILE_PX) * F.ceil(h * short / TILE_PX)


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image by the rule of the row's model; an error for a rule that is not known."""
    unit = F.floor(F.least(width, height) / CROP)
    crops = F.when((width <= SMALL_PX) & (height <= SMALL_PX), CROP_TOKENS).otherwise(CROP_TOKENS * F.ceil(width / unit) * F.ceil(height / unit))
    patches = F.least(F.ceil(width / F.col("patch")) * F.ceil(height / F.col("patch")), F.col("most"))
    rule = F.col("rule")
    known = F.when(rule == "tiles", F.col("base") + F.col("tile") * _by_tiles(width, height)).when(rule == "crop", crops).when(rule == "patch", patches)
    return known.otherwise(F.raise_error(F.concat(F.lit("no image rule "), F.coalesce(rule, F.lit("null")))).cast("bigint")).cast("bigint")


def images_sent(items: DataFrame, pictures: DataFrame, fallback: DataFrame) -> DataFrame:
    """(item_id, track, level, viewport, page_id, place, w, h, exact) of every image that an item's call sends.

    ``items`` has item_id, track, level, viewport and page_ids; ``pictures`` has
    page_id, viewport, w and h.  A page without a picture is taken at its viewport's
    size in ``fallback`` (viewport, w, h); a viewport without one is an error.
    """
    rows = items.select("item_id", "track", "level", "viewport", F.posexplode("page_ids").alias("place", "page_id"))
    rows = rows.join(pictures.select("page_id", "viewport", "w", "h"), ["page_id", "viewport"], "left")
    rows = rows.join(fallback.select("viewport", F.col("w").alias("_w"), F.col("h").alias("_h")), "viewport", "left")
    exact = F.col("w").isNotNull() & F.col("h").isNotNull()
    size = lambda c: F.when(exact, F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.raise_error(F.concat(F.lit("no size for viewport "), F.coalesce("viewport", F.lit("null")))).cast("bigint")))
    return rows.select("item_id", "track", "level", "viewport", "page_id", "place", size("w").cast("bigint").alias("w"), size("h").cast("bigint").alias("h"), exact.alias("exact"))


def token_sums(items: DataFrame, pictures: DataFrame, fallback: DataFrame, prices: DataFrame, runs: int = 1) -> DataFrame:
    """(model, track, level, viewport, items, calls, text_tokens, image_tokens, exact_images, fallback_images), all runs together.

    Images are counted by size before models come in, so that only these counts
    are multiplied by the number of models.
    """
    by = ["track", "level", "viewport"]
    texts = items.groupBy(*by).agg(F.count("*").alias("items"), F.sum(F.ceil(F.col("prompt_chars") / CHARS)).alias("text_tokens"))
    sizes = images_sent(items, pictures, fallback).groupBy(*by, "w", "h", "exact").agg(F.count("*").alias("n"))
    rules = prices.select("model", "rule", "base", "tile", "patch", "most")
    one = image_tokens(F.col("w"), F.col("h"))
    images = sizes.crossJoin(rules).groupBy("model", *by).agg(  # what is asked for: every size by every model
        F.sum(F.col("n") * one).alias("image_tokens"), F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("exact_images"), F.sum(F.when(F.col("exact"), 0).otherwise(F.col("n"))).alias("fallback_images")
    )
    grid = texts.crossJoin(prices.select("model"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("model", *by)]
    on: Column = same[0] & same[1] & same[2] & same[3]
    rows = grid.alias("a").join(images.alias("b"), on, "left")
    many = lambda c: (F.coalesce(F.col(c), F.lit(0)) * runs).cast("bigint").alias(c)
    return rows.select(*(F.col(f"a.{c}").alias(c) for c in ("model", *by)), "items", (F.col("items") * runs).alias("calls"), *map(many, ("text_tokens", "image_tokens", "exact_images", "fallback_images")))


def spend(sums: DataFrame, prices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens and dollars of each model (and each ``by``): expected, and at the most that calls may answer.

    A model without batches is an error when the query runs.  Dollars are rounded
    to cents by their exact value, halves to even.
    """
    by = by or []
    answer = F.create_map(*(F.lit(x) for pair in ANSWER_TOKENS.items() for x in pair))
    told = F.coalesce(F.try_element_at(answer, F.coalesce("level", F.lit(""))), F.lit(OTHER_ANSWER))
    sums = sums.withColumn("visible", F.col("calls") * told)
    total = sums.groupBy("model", *by).agg(*(F.sum(c).alias(c) for c in ("items", "calls", "text_tokens", "image_tokens", "exact_images", "fallback_images", "visible")))
    rows = total.join(prices.select("model", "price_in", "price_out", "discount", "fee", "reasoning", "budget", "batch"), "model")
    rows = rows.where(F.when(F.col("batch"), True).otherwise(F.raise_error(F.concat(F.lit("no batches for "), F.col("model"))).cast("boolean")))
    read, think = F.col("text_tokens") + F.col("image_tokens"), F.col("calls") * F.col("reasoning")
    dollars = lambda written: rounded(F.col("discount") * (read / F.lit(1e6) * F.col("price_in") + written / F.lit(1e6) * F.col("price_out")) * (1 + F.coalesce("fee", F.lit(0.0))), 2)
    most = F.col("calls") * F.col("budget")
    return rows.select(
        "model", *by, "items", "calls", read.alias("input_tokens"), F.col("visible").alias("visible_tokens"), think.alias("reasoning_tokens"), (F.col("visible") + think).alias("billed_tokens"), most.alias("budget_tokens"),
        "exact_images", "fallback_images", dollars(F.col("visible") + think).alias("expected_usd"), dollars(most).alias("budget_usd"),
    )


def planned_calls(items: DataFrame, pictures: DataFrame, runs: int = 1, seed: int = 0) -> DataFrame:
    """(item_id, run, page_ids, paths, missing): every call that a run would make, with the images it lacks.

    ``pictures`` has page_id, viewport and path.  The two pages of a design pair
    stand in an order of the call's own, by a hash; missing ones are named
    ``page:viewport``.
    """
    calls = items.select("item_id", "level", "viewport", "page_ids", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = calls.select("*", F.posexplode("page_ids").alias("_place", "page_id"))
    drawn = F.when(F.col("level") == "design_pair", F.xxhash64(F.lit(seed), "item_id", "run", "page_id")).otherwise(F.col("_place").cast("bigint"))
    rows = rows.withColumn("_order", drawn).join(pictures.select("page_id", "viewport", "path"), ["page_id", "viewport"], "left")
    image = F.struct("_order", "_place", "page_id", "path", F.concat_ws(":", "page_id", "viewport").alias("name"))
    listed = rows.groupBy("item_id", "run").agg(F.sort_array(F.collect_list(image)).alias("i"))  # a call's images: one, or a pair
    there = F.filter("i", lambda x: x["path"].isNotNull())
    lost = F.filter("i", lambda x: x["path"].isNull())
    return listed.select("item_id", "run", F.transform("i", lambda x: x["page_id"]).alias("page_ids"), F.transform(there, lambda x: x["path"]).alias("paths"), F.transform(lost, lambda x: x["name"]).alias("missing"))
