"""Defects planted in the source of pages, as edits of spans, and taken out again.

An edit replaces the code points from ``start`` to ``end`` of one page by a text.
Edits are rows, chosen and joined as such; those of a page are applied in one
pass, and every character outside their spans stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.elements import attribute
from ..sources.scratch import dealt, written
from .measure import candidates

# By severity, the contrast, heights and sizes that are planted; a file name for an alternative text; a width far past the page.
RATIO = {"mild": 3.8, "moderate": 2.8, "severe": 1.8}
CLIP_PX = {"mild": 24, "moderate": 18, "severe": 12}
TARGET_PX = {"mild": 22, "moderate": 18, "severe": 12}
SIZE_PX = {"mild": 13, "moderate": 11, "severe": 27}
FILE_NAMES = ("IMG_20240117_0932.jpg", "DSC_0042.JPG", "image1.png", "photo_final_v2.jpeg")
WIDE_PX = 3000


def grey_for(ratio: float, ground: float = 1.0) -> int:
    """The channel of a grey that has a contrast to a ground of the given luminance."""
    light = (ground + 0.05) / ratio - 0.05
    s = 12.92 * light if light <= 0.03928 / 12.92 else 1.055 * light ** (1 / 2.4) - 0.055
    return round(255 * min(max(s, 0.0), 1.0))


def chosen(elements: DataFrame, seed: int = 0) -> DataFrame:
    """One candidate for each (page, class): the one with the smallest hash of seed, class and number."""
    key = F.struct(F.xxhash64(F.lit(seed), "defect_class", "node"), F.col("node"))
    return candidates(elements).groupBy("row", "defect_class").agg(F.min_by("node", key).alias("node"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;")), F.lit('"'))


def _edit(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))


def set_attribute(name: str, value: Column) -> Column:
    """The edit that gives an element's start tag an attribute: in the place of the old one, or first."""
    first = F.col("tag_start") + 1 + F.length("tag")
    said = F.concat(F.lit(f" {name}="), _quoted(value))
    return _edit(F.coalesce(attribute(name, "start"), first), F.coalesce(attribute(name, "end"), first), said)


def add_style(css: Column) -> Column:
    """The edit that appends declarations to an element's style."""
    prior = F.rtrim(F.regexp_replace(F.coalesce(attribute("style"), F.lit("")), r"[;\s]+$", ""))
    return set_attribute("style", F.when(prior == "", css).otherwise(F.concat(prior, F.lit("; "), css)))


def edits(elements: DataFrame, plants: DataFrame, severity: str = "moderate") -> DataFrame:
    """(row, defect_class, node, before, after, p_expected, edit) for ``plants`` (row, node, defect_class); one row for each edit.

    ``before`` and ``after`` are the receipt: what the element said, and what it says now.
    """
    level, low = F.substring("tag", 2, 1).cast("int"), F.least(F.substring("tag", 2, 1).cast("int") + 2, F.lit(6))
    new_tag = F.concat(F.lit("h"), low.cast("string"))
    rows = plants.select("row", "node", "defect_class").join(elements, ["row", "node"])
    junk = F.element_at(F.array(*map(F.lit, FILE_NAMES)), (F.pmod(F.xxhash64("row", "node"), F.lit(len(FILE_NAMES))) + 1).cast("int"))
    grey = grey_for(RATIO[severity])
    css = {
        "contrast:degrade": f"color: rgb({grey},{grey},{grey}); background-color: rgb(255,255,255)",
        "target:shrink": f"min-width:0;min-height:0;width:{TARGET_PX[severity]}px;height:{TARGET_PX[severity]}px;padding:0;font-size:8px;line-height:1;overflow:hidden;box-sizing:border-box",
        "clip:overflow": f"display:block;height:{CLIP_PX[severity]}px;overflow:hidden",
        "protrude:viewport": f"display:block;width:{WIDE_PX}px;max-width:none",
        "align:flip": "text-align:center",
        "weight:strip": "font-weight:normal",
        "size:jitter": f"font-size:{SIZE_PX[severity]}px",
    }
    expected = {"align:flip": "center", "weight:strip": "400", "size:jitter": f"{SIZE_PX[severity]}px"}
    is_, alt, bound = (lambda name: F.col("defect_class") == name), attribute("alt"), F.concat(attribute("for"), F.lit("-detached"))
    tag_name = F.col("tag_start") + 1
    renamed = F.array(_edit(tag_name, tag_name + 2, new_tag), F.when(F.col("close_end") > F.col("close_start"), _edit(F.col("close_start") + 2, F.col("close_start") + 4, new_tag)))
    said, before, after, expects = F, F, F, F
    for name, text in css.items():
        said, after = said.when(is_(name), F.array(add_style(F.lit(text)))), after.when(is_(name), F.lit(text))
        before = before.when(is_(name), attribute("style"))
    for name, text in expected.items():
        expects = expects.when(is_(name), F.lit(text))
    said = said.when(is_("alt:strip"), F.array(_edit(attribute("alt", "start"), attribute("alt", "end"), F.lit(""))))
    said = said.when(is_("alt:garble"), F.array(set_attribute("alt", junk))).when(is_("label:orphan"), F.array(set_attribute("for", bound))).when(is_("heading:skip"), renamed)
    before = before.when(F.col("defect_class").isin("alt:strip", "alt:garble"), alt).when(is_("label:orphan"), attribute("for")).when(is_("heading:skip"), F.concat(F.lit("h"), level.cast("string")))
    after = after.when(is_("alt:garble"), junk).when(is_("label:orphan"), bound).when(is_("heading:skip"), new_tag)
    out = rows.select("row", "defect_class", "node", before.alias("before"), after.alias("after"), expects.alias("p_expected"), F.explode(F.array_compact(said)).alias("edit"))
    return out


def without_conflicts(edits_: DataFrame, page: list[str], plant: list[str]) -> DataFrame:
    """Edits (page, plant, start, end, text, rank) of the plants that can be made together on each page.

    Edits of a page that overlap, directly or through others, are one group; so
    are those that insert at the same place.  Edits that only touch are not.  In
    each group the edit of the smallest rank wins, and a plant stays if all its
    edits win.  One pass over each page's edits in order of their start.
    """
    order = Window.partitionBy(*page).orderBy("start", "end", "rank", *plant)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce((F.col("start") >= F.max("end").over(ahead)) & (F.col("start") > F.lag("start").over(order)), F.lit(True))
    groups = edits_.withColumn("_apart", apart).withColumn("_group", F.sum(F.col("_apart").cast("int")).over(order))
    first = Window.partitionBy(*page, "_group").orderBy("rank", *plant, "start")
    ranked = groups.withColumn("_wins", F.row_number().over(first) == 1)
    whole = Window.partitionBy(*page, *plant)
    return ranked.withColumn("_all", F.bool_and("_wins").over(whole)).where("_all").drop("_apart", "_group", "_wins", "_all")


def applied(pages: DataFrame, edits_: DataFrame, by: list[str], html: str = "html") -> DataFrame:
    """Pages with their edits (by, start, end, text) applied in one pass, and ``undo``, the edits that take them back.

    Edits of a page must not overlap.  Pages without edits stay as they are.
    """
    return _edited(pages.join(_listed(edits_, by), by, "left"), html)


def _listed(edits_: DataFrame, by: list[str]) -> DataFrame:
    return edits_.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_edits"))


def _edited(rows: DataFrame, html: str) -> DataFrame:
    source, list_ = F.col(html), F.coalesce(F.col("_edits"), F.array().cast("array<struct<start: int, end: int, text: string>>"))
    rows = rows.withColumn("_edits", list_)
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("_edits", i - 1)["end"])
    pieces = F.transform("_edits", lambda e, i: F.concat(F.substring(source, before(i) + 1, e["start"] - before(i)), e["text"]))
    rest = F.substring(source, F.coalesce(F.element_at(F.col("_edits"), F.lit(-1))["end"], F.lit(0)) + 1, F.length(source))
    grown = lambda i: F.aggregate(F.slice(F.col("_edits"), F.lit(1), i), F.lit(0), lambda n, e: n + F.length(e["text"]) - (e["end"] - e["start"]))
    undo = F.transform("_edits", lambda e, i: F.struct((e["start"] + grown(i)).alias("start"), (e["start"] + grown(i) + F.length(e["text"])).alias("end"), F.substring(source, e["start"] + 1, e["end"] - e["start"]).alias("text")))
    rows = rows.withColumn("undo", F.when(F.size("_edits") > 0, undo).otherwise(F.col("_edits")))
    changed = F.concat(F.array_join(pieces, ""), rest)
    return rows.withColumn(html, F.when(F.size("_edits") > 0, changed).otherwise(source)).drop("_edits")


def mutated(numbered: DataFrame, elements: DataFrame, severity: str = "moderate", seed: int = 0, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages, receipts): each page once for each class that can be planted on it, with one defect of that class.

    The pages have the columns of ``numbered``, ``defect_class`` and ``undo``, and
    are not written (see :func:`mutants`); the receipts name the element, what it
    said before and after, and what a style class should now measure.
    """
    plants = planted(elements, severity, seed)
    pages = mutants(numbered, plants, html).withColumn("defect_class", F.col("plant.defect_class")).drop("plant", "was")
    return pages, plants.select("row", "plant.*").distinct()


def planted(elements: DataFrame, severity: str = "moderate", seed: int = 0) -> DataFrame:
    """(row, plant, edit) of one defect of each class that each page can take, written once; ``plant`` has the class and the receipt."""
    plant = F.struct("defect_class", "node", "before", "after", "p_expected").alias("plant")
    return written(edits(elements, chosen(elements, seed), severity).select("row", plant, "edit"), "edits")


def mutants(numbered: DataFrame, plants: DataFrame, html: str = "html") -> DataFrame:
    """Each page once for each of its :func:`planted` defects, with ``plant``, ``undo``, and ``was``, the page before.

    All mutants are many times the pages, so none is written or moved: pages are
    dealt once, to where their edits are, and each copy is made there for what
    reads it.  A second reader makes them again.
    """
    listed = _listed(dealt(plants.select("row", "plant", "edit.*"), "row"), ["row", "plant"])
    copies = dealt(numbered, "row").join(listed.hint("shuffle_hash"), "row")
    return _edited(copies.withColumn("was", F.col(html)), html)


def undone(pages: DataFrame, html: str = "html") -> DataFrame:
    """Mutated pages with their ``undo`` applied, each where it is."""
    return _edited(pages.withColumnRenamed("undo", "_edits"), html)


def mutated_together(numbered: DataFrame, elements: DataFrame, severity: str = "moderate", seed: int = 0, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages, receipts): each page once, with one defect of each class that goes with the others; ranks come from a hash of class and page."""
    rows = edits(elements, chosen(elements, seed), severity).withColumn("rank", F.xxhash64(F.lit(seed), "row", "defect_class"))
    rows = rows.select("row", "defect_class", "node", "before", "after", "p_expected", "rank", "edit.*")
    kept = written(without_conflicts(rows, ["row"], ["defect_class"]), "edits")
    receipts = kept.select("row", "defect_class", "node", "before", "after", "p_expected").distinct()
    return written(applied(numbered, kept.select("row", "start", "end", "text"), ["row"], html), "mutants"), receipts
