"""Documents to training tokens: five stages, each over all rows the one before kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of ``documents``.  ``run`` writes each result as Parquet in the
session's shared folder and reads it back for the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalmill.llm.decontaminate import drop_contaminated
from evalmill.llm.minhash import near_duplicates
from evalmill.llm.mixing import mixed
from evalmill.llm.planes import read_token_files, write_token_files
from evalmill.llm.quality import fit_quality, keep_good
from evalmill.llm.shared import free_prefix, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier scores below 0.5.

    Null and empty texts score as a typical text does; repeated rows each count.
    """
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, on five-word shingles.

    Documents without words, and rows without an id, are in no group and stay.
    Rows that repeat an id are one document: it goes if one of them is not the
    first of its group, and otherwise the row with the smallest text stays.
    """
    p = free_prefix(docs, "_near_")
    kept = near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias(p + "id")).agg(F.bool_and("kept").alias(p + "kept")).where(F.col(p + "kept"))
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col(p + "id"), "left_semi")
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    return named.withColumn(p + "n", one).where(F.col(p + "n") == 1).drop(p + "n").union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, and repeated rows each count."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of rare sources, at most twice over, so that sources come nearer to equal weights.

    A null source is one of its own; documents without words are taken once.
    """
    return mixed(docs, max_repeats=2.0).select(*(F.col(f"`{c}`") for c in docs.columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids in bit-plane files; gives each document's place as read back from them.

    A null or empty text is the end id alone; rows that repeat an id stand one
    after the other; rows without one come first, with the smallest 64-bit id.
    """
    path = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing_sources", mix_sources),
    ("token_output", token_files),
]

#: SQL expresses none of the learned, hashed or tokenised stages; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
