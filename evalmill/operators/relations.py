"""Joins, sets, sequences and rollups of an evaluation's tables that are one plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from ..sources.scratch import tasks_for


# Joins


def by_page(items: DataFrame, report: DataFrame, answer: str, abstain: str = "unknown") -> DataFrame:
    """Every item with its page's answer in a report; pages without one abstain."""
    return items.join(report.select("page_id", F.col(answer).alias("answer")), "page_id", "left").withColumn("answer", F.coalesce("answer", F.lit(abstain)))


def tagged(findings: DataFrame, tags: str, registry: DataFrame) -> DataFrame:
    """Each finding with the registry's criteria among its tags; tags that the registry lacks go.

    The registry is a short list and is broadcast: joined by a shuffle, all
    findings would go to as many tasks as there are tags.  Findings are hardly
    ever equal, so they are dealt before they are compared.
    """
    rows = findings.withColumn("tag", F.explode(F.array_distinct(tags))).join(F.broadcast(registry.select("tag", "criterion").distinct()), "tag").drop(tags, "tag")
    return rows.repartition(tasks_for(rows), *rows.columns).distinct()


def findings_of(items: DataFrame, classes: DataFrame, findings: DataFrame) -> DataFrame:
    """(item_id, answer): no where the page has a finding of the criterion's class, yes where it has none, nothing for other criteria."""
    mapped = items.join(classes, "criterion")
    hits = findings.select("page_id", "defect_class", F.lit(True).alias("hit")).distinct()
    out = mapped.join(hits, ["page_id", "defect_class"], "left")
    return out.select("item_id", F.when(F.col("hit"), "no").otherwise("yes").alias("answer"))


def mutation_receipts(items: DataFrame) -> DataFrame:
    """(page_id, receipt): the last page question's receipt, or else the first of any level."""
    rows = items.where("door = 'mutation' and page_id is not null")
    page = F.col("level") == "L1"
    out = rows.groupBy("page_id").agg(F.max_by(F.when(page, F.col("receipt")), F.when(page, F.col("ord"))).alias("l1"), F.min_by("receipt", "ord").alias("first"), F.bool_or(page).alias("has"))
    return out.select("page_id", F.when(F.col("has"), F.col("l1")).otherwise(F.col("first")).alias("receipt"))


def in_artifact_order(artifact: DataFrame, ids: str, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Items in the order of an artifact's list of ids, which is kept as ``place`` beside the artifact's columns ``keep``; ids without an item are left out."""
    return artifact.select(*(keep or []), F.posexplode(ids).alias("place", "item_id")).join(items, "item_id")


def next_trial(trials: DataFrame, done: DataFrame) -> DataFrame:
    """The first trial, by ``place``, of each rater that the rater has not judged."""
    left = trials.join(done.select("rater", "pair_id", "dimension"), ["rater", "pair_id", "dimension"], "left_anti")
    return left.groupBy("rater").agg(F.min_by(F.struct("pair_id", "dimension"), "place").alias("t")).select("rater", "t.pair_id", "t.dimension")


def overlaps(a: str, b: str) -> Column:
    """Whether two boxes share an area; boxes that touch do not."""
    f = lambda s, c: F.col(f"{s}.{c}")
    return (f(a, "x") < f(b, "x") + f(b, "w")) & (f(a, "x") + f(a, "w") > f(b, "x")) & (f(a, "y") < f(b, "y") + f(b, "h")) & (f(a, "y") + f(a, "h") > f(b, "y"))


def inside(a: str, b: str) -> Column:
    f = lambda s, c: F.col(f"{s}.{c}")
    return (f(a, "x") >= f(b, "x")) & (f(a, "y") >= f(b, "y")) & (f(a, "x") + f(a, "w") <= f(b, "x") + f(b, "w")) & (f(a, "y") + f(a, "h") <= f(b, "y") + f(b, "h"))


def cell_grid(variants: DataFrame, models: DataFrame, cells: DataFrame) -> DataFrame:
    """Every (variant, model), both short lists, with its cell's numbers where it ran."""
    grid = variants.select("variant").distinct().crossJoin(models.select("model").distinct())
    return grid.join(cells, ["variant", "model"], "left")


def covered_families(failed: DataFrame, controlled: DataFrame, registry: DataFrame) -> DataFrame:
    """Test families with a failing page, a controlled page, and a place in the registry."""
    few = lambda rows: rows.select("family").distinct()
    return few(registry).join(few(failed), "family", "left_semi").join(few(controlled), "family", "left_semi")


#: Rows of a group that one side of a square of pairs holds.
SQUARE = 2048


def pairs_within(rows: DataFrame, by: list[str], id_: str) -> DataFrame:
    """(by, a, b) of any two rows of one group ``by`` whose ids differ, a < b.

    The pairs grow with the square of a group, so they are dealt, not the groups:
    a hash puts a group's rows into blocks of about ``SQUARE``, and every two
    blocks are a key of the join, as is each with itself.  Two rows meet under one
    key only.  The number of tasks is fixed, since Spark would choose it by what
    is read, which is little.
    """
    tasks = tasks_for(rows)
    rows = rows.select(*by, F.col(id_).alias("_id")).dropna()
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / SQUARE).cast("int").alias("_n"))
    dealt = rows.join(sizes, by).withColumn("_k", F.pmod(F.xxhash64("_id"), F.col("_n")).cast("int"))
    square = [*by, "_i", "_j"]
    left = dealt.select(*by, F.col("_id").alias("_l"), F.col("_k").alias("_i"), F.explode(F.sequence("_k", F.col("_n") - 1)).alias("_j"))
    right = dealt.select(*by, F.col("_id").alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"), F.col("_k").alias("_j"))
    met = left.repartition(tasks, *square).hint("merge").join(right.repartition(tasks, *square), square).where("_i < _j OR _l < _r")
    return met.select(*by, F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"))


def seen_pages(pages: DataFrame) -> DataFrame:
    """(bucket, group, page_id, viewport), once for each viewport that a page has."""
    return pages.select("bucket", "group", "page_id", F.explode(F.array_distinct("viewports")).alias("viewport"))


def pairs_by_viewport(pages: DataFrame) -> DataFrame:
    """(a, b, viewport) of pages of one (bucket, group), once for each viewport that both have."""
    return pairs_within(seen_pages(pages), ["bucket", "group", "viewport"], "page_id").select("a", "b", "viewport")


# Sets


def unexpected(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys found that are not expected."""
    return found.select(key).distinct().join(expected.select(key), key, "left_anti")


def is_subset(a: str, b: str) -> Column:
    return F.size(F.array_except(a, b)) == 0


# Sequences


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest order of each key; orders keep their gaps."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f")).select(*keys, *(F.col(f"_f.{c}").alias(c) for c in rest))


def interleaved_catches(trials: DataFrame, by: list[str]) -> DataFrame:
    """Place of each trial when catch trials go in evenly among the others: after each k-th, k from the counts, the rest at the end.

    ``turn`` numbers the trials of each kind from 1.
    """
    sizes = trials.groupBy(*by).agg(F.count_if(~F.col("is_catch")).alias("_p"), F.count_if("is_catch").alias("_c"))
    every = F.greatest(F.lit(1), F.floor(F.col("_p") / (F.col("_c") + 1)))
    rows = trials.join(sizes, by).withColumn("_e", every)
    # a plain trial stands after those before it and the catches they let in; a catch after the plain trials that let it in
    let_in = F.least(F.col("_c"), F.floor((F.col("turn") - 1) / F.col("_e")))
    after = F.when(F.col("turn") * F.col("_e") <= F.col("_p"), F.col("turn") * F.col("_e")).otherwise(F.col("_p"))
    place = F.when(F.col("is_catch"), after + F.col("turn")).otherwise(F.col("turn") + let_in)
    return rows.withColumn("place", place.cast("long")).drop("_p", "_c", "_e")


def classes_in_turn(seeds: DataFrame, seed: str, classes: list[str], each: int) -> DataFrame:
    """(seed, place, defect_class): ``each`` classes for every seed, taken round the list without a gap between seeds."""
    listed = F.array(*map(F.lit, classes))
    at = F.posexplode(F.sequence(F.lit(0), F.lit(each - 1))).alias("place", "j")
    return seeds.select(seed, at).select(seed, "place", F.element_at(listed, ((F.col(seed) * each + F.col("j")) % len(classes) + 1).cast("int")).alias("defect_class"))


def numbered(rows: DataFrame, array: str, keep) -> DataFrame:
    """(all columns, number, value) of an array's entries that ``keep`` takes; numbers count the others too."""
    return rows.select("*", F.posexplode(array).alias("number", "value")).where(keep(F.col("value"))).drop(array)


# Rollups


def commonest(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """The ``n`` commonest values; of equal counts the one seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(n).select(value, "n")


def largest_finding(findings: DataFrame, key: list[str], size: str, order: str) -> DataFrame:
    """The finding of each key with the largest size; of equals the first."""
    rest = [c for c in findings.columns if c not in key]
    best = findings.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(size), -F.col(order))).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest))


def first_examples(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """Sorted list of the ``n`` smallest values of each group; the ranks are cut before values are collected."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    return rows.select(*by, value).distinct().withColumn("_r", rank).where(F.col("_r") <= n).groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("examples"))


def instrument_audit(audited: DataFrame) -> DataFrame:
    """(level, reason, n): audited, valid and invalid items of each level (null reason for the two totals' row kinds), and each reason."""
    invalid = F.size("reasons") > 0
    totals = audited.groupBy("level").agg(F.count("*").alias("audited"), F.count_if(~invalid).alias("valid"), F.count_if(invalid).alias("invalid"))
    rows = totals.select("level", F.explode(F.create_map(F.lit("audited"), "audited", F.lit("valid"), "valid", F.lit("invalid"), "invalid")).alias("kind", "n"))
    reasons = audited.select("level", F.explode("reasons").alias("kind")).groupBy("level", "kind").agg(F.count("*").alias("n"))
    return rows.unionByName(reasons)


def exclusion(eligible: Column, reason: Column, audit: str, geometry: list[str], outside: list[str]) -> Column:
    """Why an item is left out: it is not eligible, its evidence lies outside, or its audit failed; null if it stays."""
    g, o = (F.array(*map(F.lit, names)) for names in (geometry, outside))
    only = (F.size(F.array_except(audit, g)) == 0) & F.arrays_overlap(audit, o)
    return F.when(~eligible, reason).when(F.size(audit) == 0, None).when(only, "outside the screenshot").otherwise("invalid instrument")


def capture_specs(items: DataFrame) -> DataFrame:
    """One capture for each (page, key): whether any item needs a box, and the sorted ids."""
    return items.groupBy("page_id", "key").agg(F.bool_or(F.col("level") == "L3").alias("localises"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def stability(a: DataFrame, b: DataFrame, digest: list[str]) -> DataFrame:
    """(page_id, stable) of pages in either capture: both have it and all digests agree."""
    right = b.select("page_id", *(F.col(c).alias(f"_{c}") for c in digest), F.lit(True).alias("_b"))
    same = F.col("_b") & F.col("_a")
    for c in digest:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.withColumn("_a", F.lit(True)).join(right, "page_id", "full").select("page_id", F.coalesce(same, F.lit(False)).alias("stable"))


def box_digest(boxes: DataFrame, by: list[str], order: str) -> DataFrame:
    """MD5 of each group's boxes in order; a group is one page's elements."""
    text = F.concat_ws(",", *(F.col(c).cast("string") for c in ("x", "y", "w", "h")))
    listed = boxes.groupBy(*by).agg(F.count("*").alias("boxes"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("l"))
    return listed.select(*by, "boxes", F.md5(F.concat_ws(";", F.transform("l", lambda r: r["t"]))).alias("digest"))


def run_diagnostics(runs: DataFrame) -> DataFrame:
    """(judge, calls, parse_rate, refusals, truncated): an answer counts as parsed if it is there, known, and no error."""
    parsed = F.coalesce(F.col("answer") != "unknown", F.lit(False)) & F.col("error").isNull()
    out = runs.groupBy("judge").agg(F.count("*").alias("calls"), F.count_if(parsed).alias("parsed"), F.count_if("refused").alias("refusals"), F.count_if("truncated").alias("truncated"))
    return out.withColumn("parse_rate", ratio("parsed", "calls")).drop("parsed")


def smoke_usage(runs: DataFrame) -> DataFrame:
    """(judge, calls, complete, mean tokens): usage counts only if every run has a positive prompt and a completion of 0 or more."""
    good = F.coalesce((F.col("prompt") > 0) & (F.col("completion") >= 0), F.lit(False))
    out = runs.groupBy("judge").agg(F.count("*").alias("calls"), F.bool_and(good).alias("complete"), F.avg("prompt").alias("p"), F.avg("completion").alias("c"))
    return out.select("judge", "calls", "complete", F.when(F.col("complete"), F.col("p")).otherwise(0.0).alias("mean_prompt"), F.when(F.col("complete"), F.col("c")).otherwise(0.0).alias("mean_completion"))


def actual_cost(runs: DataFrame, price_in: float, price_out: float, discount: float, fee: float = 0.0) -> DataFrame:
    """(judge, usd): runs with an error are skipped; one other run without usage, or no run at all, leaves null."""
    counted = runs.where("error is null")
    missing = F.bool_or(F.col("prompt").isNull() | F.col("completion").isNull())
    usd = (F.sum("prompt") / 1e6 * price_in + F.sum("completion") / 1e6 * price_out) * discount * (1 + fee)
    got = counted.groupBy("judge").agg(F.when(~missing, usd).alias("usd"))
    return runs.select("judge").distinct().join(got, "judge", "left")


def source_of(page: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The source of the first prefix that the page's id has, or other."""
    out = F
    for prefix, source in prefixes:
        out = out.when(page.startswith(prefix), source)
    return out.otherwise("other")


def clipped(box: str, width: Column, height: Column) -> Column:
    """A box held to a page; what lies outside gives a size of 0."""
    f = lambda c: F.col(f"{box}.{c}").cast("double")
    zero = F.lit(0.0)
    x, y = F.least(F.greatest(f("x"), zero), width), F.least(F.greatest(f("y"), zero), height)
    right, bottom = F.least(F.greatest(f("x") + f("w"), zero), width), F.least(F.greatest(f("y") + f("h"), zero), height)
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def usable_box(box: Column) -> Column:
    """Four finite numbers with a positive width and height."""
    finite = ~F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(box) == 4) & finite & (F.try_element_at(box, F.lit(3)) > 0) & (F.try_element_at(box, F.lit(4)) > 0), F.lit(False))
