"""What each filter of a chain removes, alone, in every order, and by its Shapley share.

Words are counted as relations: texts are exploded into words, aggregated by
(document, word) and then by document, which gives totals and distinct counts.
The other flags are joined to these.  One aggregate then counts the documents of
each part for each of the 32 sets of failed filters, and every order of the
filters is answered from these 32 counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_SETS = range(1 << len(FILTERS))
_KEY = ["doc", "digest"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def word_totals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, digest, words, distinct_words) of each different text of each id.

    Words are runs without white space, case kept.  Whole texts are dealt by
    document once; both aggregates of the words then need no further exchange.
    Rows that repeat an id and a text may be dealt to many tasks: each task
    counts its own rows of them by an empty word that stands before each text.
    """
    dealt = _texts(docs, id_col, text_col).withColumn("part_of_input", F.spark_partition_id()).repartition(*_KEY, "part_of_input")
    split = F.split(F.regexp_replace("text", "[\\t-\\r ]+", " "), " ")
    words = dealt.select(*_KEY, "part_of_input", F.explode(F.concat(F.array(F.lit("")), F.filter(split, lambda w: w != ""))).alias("word"))
    by_word = words.groupBy(*_KEY, "part_of_input", "word").agg(F.count("*").alias("n"))
    empty = F.col("word") == ""
    by_task = by_word.groupBy(*_KEY, "part_of_input").agg(
        F.sum(F.when(empty, F.col("n")).otherwise(0)).alias("rows"), F.sum(F.when(empty, 0).otherwise(F.col("n"))).alias("all_words"), F.count_if(~empty).alias("distinct_words")
    )
    return by_task.groupBy(*_KEY).agg(F.max(F.expr("all_words div rows")).alias("words"), F.max("distinct_words").alias("distinct_words"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc, digest, part, n_rows, failed): the set of failed filters as bits, A the lowest.

    A: under 200 words.  B: fewer than half of the words are distinct.  C: more
    than one character in fifty is one of A-Z.  D: a character of ``#$%&*|``.
    E: a smaller id has the same text, compared by SHA-256.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        (100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text)).alias("c"),
        text.rlike("[#$%&*|]").alias("d"),
    )
    own = own.groupBy(*_KEY, "part", "c", "d").agg(F.count("*").alias("n_rows"))
    # The first of equal texts is found by its id, not by its text: no text, however frequent, is a join key.
    first = own.groupBy("digest").agg(F.min("doc").alias("doc")).where("doc is not null").select("doc", "digest", F.lit(True).alias("first"))
    flags = own.join(first, _KEY, "left").join(word_totals(docs, id_col, text_col).withColumnsRenamed({"doc": "d_", "digest": "g_"}), (F.col("doc").eqNullSafe(F.col("d_"))) & (F.col("digest") == F.col("g_")), "left")
    words, distinct = F.coalesce("words", F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("c"), F.col("d"), F.col("doc").isNotNull() & F.col("first").isNull()]
    failed: Column = F.lit(0)
    for bit, fail in enumerate(fails):
        failed = failed + F.when(fail, 1 << bit).otherwise(0)
    return flags.select(*_KEY, "part", "n_rows", failed.alias("failed"))


def failure_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part: arrays of 32 counts (all, good, toxic), by the set of failed filters."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("doc is not null")
    rows = failed.join(marks, "doc", "left")
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    columns = [F.sum(F.when((F.col("failed") == m) & mark, F.col("n_rows")).otherwise(0)).alias(f"{k}{m}") for k, mark in kinds.items() for m in _SETS]
    return rows.groupBy("part").agg(*columns).select("part", *(F.array(*(f"{k}{m}" for m in _SETS)).alias(k) for k in kinds))


def interaction(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the 32 counts of a part."""
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(map("".join, permutations(FILTERS)))), " ")))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"))
    steps = steps.withColumn("before", F.expr(f"aggregate(filter(sequence(1, {len(FILTERS)}), i -> i < step), 0, (x, i) -> x | shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1))"))

    def total(of: str, test: str) -> Column:
        return F.expr(f"aggregate(sequence(0, {_SETS[-1]}), 0L, (x, m) -> x + if({test}, {of}[m], 0L))")

    removed, share = "(m & own) != 0 AND (m & before) = 0", sum(1 for _ in permutations(FILTERS))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", "(m & (own | before)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(m & own) != 0 AND (m & before) != 0").alias("redundant"),
        total("n", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in an equal share of all orders.
        F.expr(f"aggregate(sequence(1, {_SETS[-1]}), 0L, (x, m) -> x + if((m & own) != 0, n[m] * ({share} div bit_count(m)), 0L))").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What filters A to E keep and remove in each part, for all 120 orders, step by step.

    Defined cases: a null text is empty; a null part is the empty part; each
    repeated row counts; a row without id has no smaller id and is none, so it
    never fails E; a document with several labels is good (toxic) if one says
    so; labels without id are ignored; an empty table gives no rows; other
    columns are ignored.
    """
    return interaction(failure_counts(failures(docs, id_col, text_col, part_col), labels))
