"""Rules applied to measurements, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def heading_skips(headings: DataFrame, page: str, position: str, level: str) -> DataFrame:
    """Headings more than one level below the heading before them; ties of position go by level."""
    before = F.lag(level).over(Window.partitionBy(page).orderBy(position, level))
    return headings.withColumn("before", before).where(F.col(level) > F.col("before") + 1)


def sibling_deltas(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distance of each value from its siblings' upper median."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    size = F.count("*").over(Window.partitionBy(*by))
    middle = df.withColumn("_place", place).withColumn("_size", size).where(F.col("_place") == F.floor(F.col("_size") / 2) + 1)
    return df.join(middle.select(*by, F.col(value).alias("median")), by).withColumn("delta", F.col(value) - F.col("median"))


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that applies, null if none does."""
    out = F
    for condition, reason in rules:
        out = out.when(condition, reason)
    return out


def all_reasons(checks: list[tuple[Column, str]]) -> Column:
    """Sorted names of the checks that fail."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks)))))


def page_box(answer: str, clip: str, scale: str) -> Column:
    """A box in image pixels moved to page pixels: clip origin plus box over scale."""
    f = lambda s, c: F.col(f"{s}.{c}").cast("double")
    return F.struct(
        (f(clip, "x") + f(answer, "x") / f(scale, "x")).alias("x"), (f(clip, "y") + f(answer, "y") / f(scale, "y")).alias("y"),
        (f(answer, "w") / f(scale, "x")).alias("w"), (f(answer, "h") / f(scale, "y")).alias("h"),
    )


def coverage(registry: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every criterion with counts of distinct failing and passing pages and a status."""
    counts = evidence.groupBy("criterion").agg(
        F.countDistinct(F.when(F.col("truth") == "no", F.col("page_id"))).alias("failing"), F.countDistinct(F.when(F.col("truth") == "yes", F.col("page_id"))).alias("passing")
    )
    out = registry.join(counts, "criterion", "left").select("criterion", F.coalesce("failing", F.lit(0)).alias("failing"), F.coalesce("passing", F.lit(0)).alias("passing"))
    status = F.when((F.col("failing") > 0) & (F.col("passing") > 0), "covered").when(F.col("failing") + F.col("passing") > 0, "partial").otherwise("not_yet")
    return out.withColumn("status", status)


def cost(usage: DataFrame, prices: DataFrame, runs: int = 1, fee: float = 0.0) -> DataFrame:
    """Tokens and dollars of each (split, model); prices are a short list."""
    sums = usage.groupBy("split").agg(F.count("*").alias("items"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    grid = sums.crossJoin(prices)  # a row for each split and model
    dollars = F.col("discount") * runs * (F.col("tokens_in") / F.lit(1e6) * F.col("price_in") + F.col("tokens_out") / F.lit(1e6) * F.col("price_out")) * (1 + fee)
    return grid.select("split", "model", "items", (F.col("tokens_in") * runs).alias("tokens_in"), (F.col("tokens_out") * runs).alias("tokens_out"), dollars.alias("dollars"))


def usage_or_null(runs: DataFrame, key: str, error: str | None = None) -> DataFrame:
    """Token sums of each key, null as soon as one run has no valid usage; runs with an ``error`` are skipped, but counted."""
    counted = F.lit(True) if error is None else F.col(error).isNull()
    bad = F.bool_or(counted & (F.col("tokens").isNull() | (F.col("tokens") <= 0)))
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.when(~bad, F.sum(F.when(counted, F.col("tokens")))).alias("tokens"))


def tile_tokens(width: Column, height: Column, tile: int = 512, base: int = 85, each: int = 170) -> Column:
    """Image tokens by tiles, after fitting to 2048 and the short side to 768."""
    fit = F.least(F.lit(1.0), F.lit(2048.0) / F.greatest(width, height))
    w, h = width * fit, height * fit
    short = F.least(F.lit(1.0), F.lit(768.0) / F.least(w, h))
    return (F.lit(base) + F.lit(each) * F.ceil(w * short / tile) * F.ceil(h * short / tile)).cast("bigint")


def simplest_of_best(cells: DataFrame, order: Column, least_parse: float = 0.98, band: float = 0.01) -> DataFrame:
    """Of the variants that all models parse, the simplest within the band below the best score."""
    ok = cells.groupBy("variant").agg(F.min("parse_rate").alias("parse"), F.avg("score").alias("score")).where(F.col("parse") >= least_parse)
    top = ok.agg(F.max("score").alias("top"))
    near = ok.crossJoin(F.broadcast(top)).where(F.col("score") >= F.col("top") - band)
    return near.agg(F.min_by("variant", order).alias("variant"))
