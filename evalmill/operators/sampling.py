"""Deterministic samples, splits and orders, by hashes instead of seeded shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_bucket


def hash_split(df: DataFrame, key: Column, test_percent: int, name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(hash_bucket(key, 100) < test_percent, "test").otherwise("dev"))


def byte_sum(text: Column) -> Column:
    """Sum of the UTF-8 bytes of a text."""
    hex_ = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.greatest(F.length(hex_), F.lit(2)), F.lit(2))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda s, i: s + F.coalesce(F.conv(F.substring(hex_, i, F.lit(2)), 16, 10).cast("bigint"), F.lit(0)))


def first_of_each(df: DataFrame, by: list[str], order: list[Column], quota: Column | int) -> DataFrame:
    """At most ``quota`` rows of each stratum, in the given order; rank is kept."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= quota)


def round_robin(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """``n`` rows taken in turn from the strata: all firsts, then all seconds.

    No stratum can give more than n rows, so the ranks are cut before the sort.
    """
    ranked = first_of_each(df, by, order, n)
    return ranked.orderBy("rank", *by).limit(n)


def smallest_hashes(df: DataFrame, key: Column, n: int) -> DataFrame:
    return df.orderBy(F.md5(key), key).limit(n)


def interleaved(df: DataFrame, by: list[str], outcome: str, order: list[Column]) -> DataFrame:
    """Place of each row when outcomes alternate within a group, what is left over last."""
    turn = F.row_number().over(Window.partitionBy(*by, outcome).orderBy(*order))
    ranked = df.withColumn("turn", turn)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("turn", outcome)))


def filter_items(items: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal what is wanted, all at once; None leaves a column open."""
    for column, value in wanted.items():
        if value is not None:
            items = items.where(F.col(column) == value)
    return items


def quota_sample(df: DataFrame, by: list[str], order: list[Column], quota: int) -> DataFrame:
    """``quota`` rows of each stratum, in the given order; an error when the query runs if a stratum is short."""
    # The rows of a stratum are cut to its quota first, and only these are counted.
    ranked = first_of_each(df, by, order, quota).withColumn("_size", F.count("*").over(Window.partitionBy(*by)))
    enough = F.when(F.col("_size") >= quota, True).otherwise(F.raise_error(F.concat(F.lit("too few rows in "), F.concat_ws("/", *(F.col(c).cast("string") for c in by)))).cast("boolean"))
    return ranked.where(enough).drop("_size")


def trials(pairs: DataFrame, rater: Column, seed: int = 0) -> DataFrame:
    """(rater, pair_id, dimension, is_catch, turn) of every dimension in a pair's scope, in an order of the rater's own."""
    rows = pairs.select(rater.alias("rater"), "pair_id", (F.col("pair_type") == "validity").alias("is_catch"), F.explode("scope").alias("dimension"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "rater", "pair_id", "dimension"))
    turn = F.row_number().over(Window.partitionBy("rater", "is_catch").orderBy(order, "pair_id", "dimension"))
    return rows.withColumn("turn", turn.cast("long"))


def built_pairs(pages: DataFrame, parents: DataFrame, each: int, seed: int = 0) -> DataFrame:
    """(pair_type, page_a, page_b, viewport, known_worse) of an annotation study.

    Validity pairs are mutated pages with their parents, of which the mutated one
    is worse.  Preference pairs are two pages of a group on a viewport that both
    have, ``each`` of a bucket, in turn from its groups.  A hash flips the sides.
    """
    from .relations import pairs_within, seen_pages

    made = parents.select(F.lit("validity").alias("pair_type"), F.col("parent").alias("a"), F.col("page_id").alias("b"), F.lit("desktop").alias("viewport"))
    key = lambda *c: F.md5(F.concat_ws(":", F.lit(seed), *c))
    of_group = F.row_number().over(Window.partitionBy("bucket", "group").orderBy("_key"))
    of_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy("_g", "group"))
    first = lambda pairs: pairs.withColumn("_g", of_group).where(F.col("_g") <= each)
    keyed = lambda rows, by: pairs_within(rows, by, "page_id").withColumn("_key", key("a", "b", "viewport"))
    # The turns of a bucket are known from the numbers of pairs, so only groups that have one are paired.
    seen, group = seen_pages(pages), ["bucket", "group"]
    same = seen.dropna().groupBy(*group, "viewport", "page_id").agg(F.count("*").alias("n"))
    numbers = same.groupBy(*group, "viewport").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("n")).groupBy(*group).agg(F.sum("n").alias("n")).where("n > 0")
    turns = numbers.select(*group, F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(each)).cast("int"))).alias("_g")).withColumn("_b", of_bucket)
    seen = seen.join(turns.where(F.col("_b") <= each).select(*group).distinct(), group)
    # No pair of the first ``each`` has a larger hash than the last of the first ``each`` of any part of the group: all others go before they are sorted.
    some = first(keyed(seen.where(F.pmod(F.xxhash64("page_id"), F.lit(16)) == 0), [*group, "viewport"]))
    last = some.groupBy(*group).agg(F.max("_key").alias("last"), F.count("*").alias("n")).where(F.col("n") == each)
    held = seen.join(last.select(*group, "last"), group, "left").withColumn("last", F.coalesce("last", F.lit("g")))  # behind all hex digits
    met = first(keyed(held, [*group, "viewport", "last"]).where("_key <= last")).withColumn("_b", of_bucket).where(F.col("_b") <= each)
    rows = made.unionByName(met.select(F.lit("preference").alias("pair_type"), "a", "b", "viewport"))
    flip = F.substring(key("a", "b", "viewport"), 1, 1) < "8"
    worse = F.when(F.col("pair_type") == "validity", F.when(flip, "A").otherwise("B"))
    return rows.select("pair_type", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("page_a"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("page_b"), "viewport", worse.alias("known_worse"))


def assertions(probes: DataFrame, seed: int = 0) -> DataFrame:
    """(item_id, number, text, truth) of one question for each usable probe of a page; a hash decides whether it is told as it is.

    ``probes`` has page_id and specs: structs selector, property, value, other, box.
    """
    from .relations import numbered, usable_box

    rows = numbered(probes, "specs", lambda v: usable_box(v["box"]))
    v, id_ = F.col("value"), F.concat_ws("-", "page_id", F.lit("L4"), F.col("number").cast("string"))
    straight = F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_)), 1, 1) < "8"
    said = F.when(straight, v["value"]).otherwise(v["other"])
    text = F.concat(F.lit("The "), v["property"], F.lit(" of "), v["selector"], F.lit(" is "), said)
    return rows.select(id_.alias("item_id"), "number", text.alias("text"), F.when(straight, "yes").otherwise("no").alias("truth"))


def reverified(items: DataFrame, replacements: DataFrame, invalid_pages: DataFrame, invalid_families: DataFrame) -> DataFrame:
    """Items without those of invalid pages and families, each replaced by its new version where there is one (same columns)."""
    kept = items.join(invalid_pages.select("page_id"), "page_id", "left_anti").join(invalid_families.select("family"), "family", "left_anti")
    new = replacements.select(F.col("item_id").alias("_id"), F.struct(*replacements.columns).alias("_new"))
    return kept.join(new, F.col("item_id") == F.col("_id"), "left").select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in items.columns))
