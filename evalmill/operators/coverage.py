"""How far each success criterion is covered by verified pages, families of defects, and tests of behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .instrument import coverage_status

# How many success criteria each guideline of version 2.2 has (4.1.1 was removed), the tests of behaviour, and the criterion that needs a focus state.
_GUIDELINES = {"1.1": 1, "1.2": 9, "1.3": 6, "1.4": 13, "2.1": 4, "2.2": 6, "2.3": 3, "2.4": 13, "2.5": 8, "3.1": 6, "3.2": 6, "3.3": 9, "4.1": 3}
_REMOVED = {"4.1.1"}
TESTS = ("MFT", "INV", "DIR")
NEEDS_FOCUS = "2.4.11"
CONTROL = ":clean-control"


def success_criteria() -> list[str]:
    """All criteria as dotted numbers, in their order."""
    return [c for g, n in _GUIDELINES.items() for k in range(1, n + 1) if (c := f"{g}.{k}") not in _REMOVED]


def _counted(rows: DataFrame, column: str, name: str) -> DataFrame:
    """(criterion, name): a sorted list of (value, items) of a column with few values."""
    counts = rows.groupBy("criterion", column).agg(F.count("*").alias("n"))
    return counts.groupBy("criterion").agg(F.sort_array(F.collect_list(F.struct(F.col(column).alias("value"), F.col("n").alias("items")))).alias(name))


def families(items: DataFrame, cases: DataFrame) -> DataFrame:
    """(criterion, family, paired, covered) of each family of defects that stands in a criterion's items.

    A family is paired if a verified mutation fails on a page and a measured
    control of it passes on one.  A paired family is covered if items name all
    tests of behaviour, ``cases`` (criterion, family, test) has all of them, and,
    for the criterion about hidden focus, an item shows the focus.
    """
    c = F.col
    made = (c("level") == "L1") & (c("door") == "mutation")
    control = c("defect_class").endswith(CONTROL)
    rows = items.where("defect_class is not null").withColumn("family", F.regexp_replace("defect_class", CONTROL + "$", ""))
    yes = lambda x: F.coalesce(x, F.lit(False))
    seen = rows.groupBy("criterion", "family").agg(
        F.bool_or(yes(made & ~control & (c("truth") == "no") & c("verified"))).alias("fails"),
        F.bool_or(yes(made & control & (c("truth") == "yes") & c("control") & ~c("fires"))).alias("passes"),
        *(F.bool_or(yes(F.array_contains("tests", t))).alias(t) for t in TESTS),
        F.bool_or(yes(c("focus_shown"))).alias("focus"),
    )
    known = cases.where(c("test").isin(*TESTS)).groupBy("criterion", "family").agg(F.count_distinct("test").alias("known"))
    all_tests: Column = F.lit(True)
    for t in TESTS:
        all_tests = all_tests & c(t)
    full = seen.join(known, ["criterion", "family"], "left").withColumn("paired", c("fails") & c("passes"))
    covered = c("paired") & all_tests & (F.coalesce("known", F.lit(0)) == len(TESTS)) & ((c("criterion") != NEEDS_FOCUS) | c("focus"))
    return full.select("criterion", "family", "paired", covered.alias("covered"))


def coverage_report(registry: DataFrame, items: DataFrame, cases: DataFrame, limits: DataFrame) -> DataFrame:
    """One row for each registered criterion: its evidence and how far it is covered.

    ``items`` has criterion, page_id, level, door, truth, defect_class, verified,
    control, fires, tests and focus_shown; ``limits`` lists criteria whose known
    limit stands.  A criterion without items has counts of 0 and empty lists.
    """
    l1 = F.col("level") == "L1"
    counts = items.groupBy("criterion").agg(
        F.count("*").alias("items"), F.count_distinct(F.when(l1 & (F.col("truth") == "no"), F.col("page_id"))).alias("failing_pages"), F.count_distinct(F.when(l1 & (F.col("truth") == "yes"), F.col("page_id"))).alias("conforming_pages")
    )
    of = families(items, cases).groupBy("criterion").agg(
        F.sort_array(F.collect_set(F.when(F.col("paired"), F.col("family")))).alias("paired_families"), F.sort_array(F.collect_set(F.when(F.col("covered"), F.col("family")))).alias("families")
    )
    out = registry.select("criterion")
    for part in (counts, _counted(items, "door", "doors"), _counted(items, "level", "levels"), of, limits.select("criterion", F.lit(True).alias("limited")).distinct()):
        out = out.join(part, "criterion", "left")
    none = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("items", "failing_pages", "conforming_pages")}
    none |= {n: F.coalesce(F.col(n), F.array().cast("array<string>")) for n in ("paired_families", "families")}
    none |= {n: F.coalesce(F.col(n), F.array().cast("array<struct<value: string, items: bigint>>")) for n in ("doors", "levels")}
    out = out.withColumns({**none, "limited": F.coalesce("limited", F.lit(False))}).withColumns({"covered_families": F.size("families"), "behavioral": F.size("families") > 0})
    return out.join(coverage_status(out), "criterion")
