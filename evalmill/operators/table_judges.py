"""Judges written in Python, run as one table function over all items.

A judge sees an item and, of the tables that it requires, the row of the item
or of its page.  Only required tables are joined, each once for all judges that
name it; items of a page are judged together.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

Verdict = tuple[str, float | None]
#: Tasks that the items of one judge and page may be dealt to.
PARTS = 16


@dataclass(frozen=True)
class PageJudge:
    """A name, the tables it requires, and a function of (item, {table: row or None}) that gives (answer, confidence)."""

    name: str
    requires: tuple[str, ...]
    answer: Callable[[dict, dict], Verdict]


def replayed(item: dict, assets: dict) -> Verdict:
    """The recorded answer; unknown where there is none."""
    said = assets["answers"] or {}
    return said.get("answer") or "unknown", said.get("confidence")


def routed(name: str, routes: dict[str, PageJudge], by: str = "track", rest: PageJudge | None = None) -> PageJudge:
    """A judge that hands each item to the judge of its track, and items of other tracks to ``rest``, or to nobody."""
    requires = tuple(dict.fromkeys(t for j in [*routes.values(), *([rest] if rest else [])] for t in j.requires))

    def answer(item: dict, assets: dict) -> Verdict:
        one = routes.get(item.get(by), rest)
        return one.answer(item, {t: assets[t] for t in one.requires}) if one else ("unknown", None)

    return PageJudge(name, requires, answer)


def _function(judges: dict[str, PageJudge]):
    """The table function; it keeps a page's parsed assets while it judges the page's items."""

    @F.udtf(returnType="judge string, item_id string, answer string, confidence double, error string")
    class Judging:
        def __init__(self) -> None:
            self.seen: dict[str, dict | None] = {}

        def eval(self, row: Row) -> Iterator[tuple]:
            one, item = judges[row["judge"]], json.loads(row["item"])
            texts = json.loads(row["assets"])
            assets = {}
            for table in one.requires:
                text = texts.get(table)
                if text not in self.seen:
                    self.seen[text] = None if text is None else json.loads(text)
                assets[table] = self.seen[text]
            try:
                answer, confidence = one.answer(item, assets)
                yield row["judge"], row["item_id"], answer, confidence, None
            except Exception as error:  # one item that a judge can't take is a row of its own, not the end of the run
                yield row["judge"], row["item_id"], "unknown", None, f"{type(error).__name__}: {error}"

        def terminate(self) -> None:
            self.seen.clear()

    return Judging


def run_page_judges(items: DataFrame, judges: list[PageJudge], tables: dict[str, DataFrame]) -> DataFrame:
    """(judge, item_id, answer, confidence, error) of all judges for all items.

    ``items`` has item_id, page_id and what the judges look at.  A table with an
    item_id is joined by it, any other by page_id, one row for each key.  A judge
    that fails on an item answers unknown and says why.  A required table that is
    not there is an error, before anything runs; the others are not read.
    """
    by_name = {j.name: j for j in judges}
    if len(by_name) < len(judges):
        raise ValueError("two judges of one name")
    needed = list(dict.fromkeys(t for j in judges for t in j.requires))
    if missing := [t for t in needed if t not in tables]:
        raise ValueError(f"required tables are missing: {', '.join(missing)}")
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("page_id").cast("string").alias("page_id"), F.to_json(F.struct(*items.columns)).alias("item"))
    for table in needed:
        key = "item_id" if "item_id" in tables[table].columns else "page_id"
        asset = tables[table].select(F.col(key).cast("string").alias(key), F.to_json(F.struct(*tables[table].columns)).alias(f"_{table}"))
        rows = rows.join(asset, key, "left")
    said = F.to_json(F.struct(*(F.col(f"_{t}").alias(t) for t in needed))) if needed else F.lit("{}")
    asked = F.explode(F.array(*(F.lit(n) for n in by_name)))
    rows = rows.select("item_id", "page_id", "item", said.alias("assets"), asked.alias("judge"), F.pmod(F.xxhash64("item_id"), F.lit(PARTS)).alias("part"))
    return _function(by_name)(rows.asTable().partitionBy("judge", "page_id", "part"))
