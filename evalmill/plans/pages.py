"""Queries over the source of ``pages``: elements, candidates, measurements, and planted defects that show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import decisions as D
from ..operators import measure as M
from ..operators import mutate
from ..sources.elements import element_table, numbered_pages
from ..sources.scratch import written
from . import bridge as B

#: Start tags outside comments and raw text, as DuckDB reads them.
_TAGS = r"""tags AS (SELECT page_id, lower(unnest(regexp_extract_all(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<(script|style|title)([^>]*)>.*?</(script|style|title)[^>]*>', '<\1\2>', 'gsi'), '<([A-Za-z][^\s/>]*)', 1))) AS tag FROM pages)"""
_TEXT = ", ".join(f"'{t}'" for t in M.TEXT_TAGS)
_BLOCK = ", ".join(f"'{t}'" for t in M.BLOCK_TAGS)


def _tables(spark: SparkSession, sf: str, text: bool = True) -> tuple[DataFrame, DataFrame]:
    pages = numbered_pages(B.read(spark, sf, "pages"))
    return pages, element_table(pages, text=text)


@register(f"WITH {_TAGS} SELECT page_id, tag, count(*) AS elements FROM tags GROUP BY 1, 2")
def page_elements(spark: SparkSession, sf: str) -> DataFrame:
    """How many elements of each tag every page has."""
    pages, elements = _tables(spark, sf)
    return pages.select("row", "page_id").join(elements, "row").groupBy("page_id", "tag").agg(F.count("*").alias("elements"))


@register(None)
def element_nesting(spark: SparkSession, sf: str) -> DataFrame:
    """By tag: how many elements, how deep, how many are never closed by a tag of their own, and how much text and how many elements they hold."""
    _, elements = _tables(spark, sf)
    unclosed = (F.col("close_start") == F.col("close_end")) & ~F.col("tag").isin("br", "meta", "img", "link", "input", "hr")
    return elements.groupBy("tag").agg(F.count("*").alias("elements"), F.max("depth").alias("deepest"), F.count_if(unclosed).alias("unclosed"), F.sum("n_text").alias("text_chars"), F.sum(F.col("last") - F.col("node")).alias("inside"))


@register(
    f"""WITH {_TAGS}, c AS (SELECT page_id, unnest(list_filter([CASE WHEN tag IN ({_TEXT}) THEN 'contrast:degrade' END, CASE WHEN tag IN ({_TEXT}) THEN 'clip:overflow' END, CASE WHEN tag IN ({_TEXT}, {_BLOCK}) THEN 'protrude:viewport' END,
      CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4') THEN 'heading:skip' END, CASE WHEN tag IN ('a', 'button') THEN 'target:shrink' END, CASE WHEN tag IN ('p', 'li', 'td', 'dd', 'blockquote') THEN 'align:flip' END,
      CASE WHEN tag SIMILAR TO 'h[1-6]' THEN 'weight:strip' END, CASE WHEN tag SIMILAR TO 'h[1-6]' THEN 'size:jitter' END], lambda x: x IS NOT NULL)) AS defect_class FROM tags)
    SELECT page_id, defect_class, count(*) AS candidates FROM c GROUP BY 1, 2"""
)
def defect_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """How many elements of every page a defect of each class can be planted on."""
    pages, elements = _tables(spark, sf)
    return pages.select("row", "page_id").join(M.candidates(elements), "row").groupBy("page_id", "defect_class").agg(F.count("*").alias("candidates"))


@register(None)
def measured_pages(spark: SparkSession, sf: str) -> DataFrame:
    """By page and class: on how many candidates the source answers the class's rule, and on how many it fires."""
    pages, elements = _tables(spark, sf)
    asked = M.candidates(elements).select("row", "node", "defect_class")
    rows = D.judged(M.measurements(elements, asked))
    counts = rows.groupBy("row", "defect_class").agg(F.count("*").alias("candidates"), F.count_if("measured").alias("measured"), F.count_if("fires").alias("fires"))
    return pages.select("row", "page_id").join(counts, "row").drop("row")


def _verdicts(mutants: DataFrame, plants: DataFrame) -> DataFrame:
    """(row, defect_class, measured, fires) of each planted defect, measured anew on the mutated source.

    Each mutated page is a page of its own, numbered by its page and class; an edit
    adds no element, so numbers stay.  Each is scanned whole as it is made, and of
    its elements those are kept that the measurement of its class reads.
    """
    numbered = lambda name: F.col("row") * len(D.CRITERION) + F.array_position(F.array(*map(F.lit, D.CRITERION)), F.col(name))
    fresh = mutants.select(numbered("plant.defect_class").alias("row"), "html", "plant")
    elements = element_table(fresh, text=False, near=(F.col("plant.node"), M.read_tags(F.col("plant.defect_class"))))
    asked = plants.select("row", "plant.*").distinct()
    asked = asked.select(numbered("defect_class").alias("row"), "node", "defect_class", F.col("row").alias("source_row"), "p_expected")
    return D.judged(M.measurements(elements, asked)).select(F.col("source_row").alias("row"), "defect_class", "measured", "fires")


@register(None)
def mutated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with a defect of each class that it can take: the receipt, what the source is now, whether the class shows, and whether undoing gives the page back."""
    pages, elements = _tables(spark, sf, text=False)
    plants = mutate.planted(elements)
    mutants = mutate.mutants(pages, plants)
    # What is told of each mutant is narrow and written first; no mutant itself is.
    told = mutate.undone(mutants.withColumn("html_sha256", F.sha2("html", 256)))
    told = written(told.select("row", "html_sha256", "plant.*", "page_id", (F.col("html") == F.col("was")).alias("restored")), "mutants")
    rows = told.join(_verdicts(mutants, plants), ["row", "defect_class"])
    return rows.select("defect_class", "html_sha256", "node", "before", "after", "measured", "fires", "page_id", "restored")


@register(None)
def pages_with_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with all defects that go together on it: their classes, and what its source is now."""
    pages, elements = _tables(spark, sf)
    mutants, receipts = mutate.mutated_together(pages, elements)
    classes = receipts.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("defect_class")), " ").alias("classes"))
    return mutants.join(classes, "row", "left").select("page_id", F.coalesce("classes", F.lit("")).alias("classes"), F.sha2("html", 256).alias("html_sha256"), (F.size("undo") > 0).alias("changed"))
