"""Judges by name: each turns items and the tables it requires into answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import by_page, findings_of
from .scoring import majority_vote

Answers = Callable[..., DataFrame]


@dataclass(frozen=True)
class Judge:
    """A name, the tables that it requires, and the plan that gives (item_id, answer)."""

    name: str
    requires: tuple[str, ...]
    answers: Answers


REGISTRY: dict[str, Judge] = {}


def judge(name: str, *requires: str) -> Callable[[Answers], Answers]:
    """Registers a plan as a judge; two of one name are an error."""

    def keep(answers: Answers) -> Answers:
        if name in REGISTRY:
            raise ValueError(f"a judge is called {name} already")
        REGISTRY[name] = Judge(name, requires, answers)
        return answers

    return keep


def run_judges(items: DataFrame, names: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """(judge, item_id, answer) of the named judges, one plan for all; only the tables that one requires are read."""
    out = None
    for name in names:
        one = REGISTRY[name]
        if missing := [t for t in one.requires if t not in tables]:
            raise ValueError(f"{name} requires {', '.join(missing)}")
        rows = one.answers(items, *(tables[t] for t in one.requires)).select(F.lit(name).alias("judge"), "item_id", "answer")
        out = rows if out is None else out.unionByName(rows)
    return out


@judge("canned", "answers")
def _canned(items: DataFrame, answers: DataFrame) -> DataFrame:
    return items.select("item_id").join(answers, "item_id", "left").select("item_id", F.coalesce("answer", F.lit("unknown")).alias("answer"))


@judge("rules", "report")
def _rules(items: DataFrame, report: DataFrame) -> DataFrame:
    return by_page(items, report, "said")


@judge("layout", "classes", "findings")
def _layout(items: DataFrame, classes: DataFrame, findings: DataFrame) -> DataFrame:
    return items.select("item_id").join(findings_of(items, classes, findings), "item_id", "left").select("item_id", F.coalesce("answer", F.lit("unknown")).alias("answer"))


@judge("majority", "dev")
def _majority(items: DataFrame, dev: DataFrame) -> DataFrame:
    """The commonest truth of each (track, level) of the dev items; unknown where there are none."""
    fit = majority_vote(dev, ["track", "level"], "truth", "item_id").select("track", "level", "answer")
    return items.join(fit, ["track", "level"], "left").select("item_id", F.coalesce("answer", F.lit("unknown")).alias("answer"))


@judge("random")
def _random(items: DataFrame) -> DataFrame:
    """yes or no by a hash of the item's id."""
    return items.select("item_id", F.when(F.substring(F.md5(F.col("item_id").cast("string")), 1, 1) < "8", "yes").otherwise("no").alias("answer"))


def png_size(content: Column) -> Column:
    """(width, height) in the header of a PNG file; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("w"), number(21).alias("h")))
