"""Queries that write an evaluation's files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..sources import scans, tables
from ..sources.scratch import scratch_path
from . import bridge as B

_JUDGED = "CAST(user_id AS {s}) AS rater, CAST(event_id % 40 AS {s}) AS pair_id, event_type AS dimension, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'cannot_tell' END AS choice, event_id AS ord"


@register(f"SELECT rater, pair_id, dimension, arg_max(choice, ord) AS choice, max(ord) AS ord FROM (SELECT {_JUDGED.format(s='VARCHAR')} FROM events) GROUP BY 1, 2, 3")
def judgment_files(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments in two files of a folder, scanned together; the last one of each key."""
    from ..operators.scoring import last_wins

    folder = scratch_path(spark, "judgments")
    e = B.read(spark, sf, "events").selectExpr(*_JUDGED.format(s="STRING").split(", "))
    scans.write_lines(e.where("ord % 2 = 0"), f"{folder}/even.jsonl", ["ord"])
    scans.write_lines(e.where("ord % 2 = 1"), f"{folder}/odd.jsonl", ["ord"])
    got = scans.read_judgments(spark, folder).select("rater", "pair_id", "dimension", "choice", "ord")
    return last_wins(got, ["rater", "pair_id", "dimension"], "ord")


@register("SELECT CAST(p_partkey AS VARCHAR) AS pair_id, CASE WHEN p_size % 5 = 0 THEN 'validity' ELSE 'preference' END AS pair_type, CASE WHEN p_size % 5 = 0 THEN 'A' END AS known_worse, p_brand AS page_a, p_type AS page_b FROM part")
def pair_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs written in order as JSON lines, null fields left out, and read back."""
    path = scratch_path(spark, "pairs")
    pairs = B.read(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS pair_id", "CASE WHEN p_size % 5 = 0 THEN 'validity' ELSE 'preference' END AS pair_type", "CASE WHEN p_size % 5 = 0 THEN 'A' END AS known_worse", "p_brand AS page_a", "p_type AS page_b")
    scans.write_lines(pairs, path, ["pair_id"])
    return scans.read_lines(spark, path, scans.PAIR)


@register("SELECT p_partkey AS id, p_type AS kind, CAST(p_retailprice AS DOUBLE) AS price FROM part")
def tab_separated(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    B.read(spark, sf, "part").selectExpr("p_partkey AS id", "p_type AS kind", "CAST(p_retailprice AS DOUBLE) AS price").write.option("sep", "\t").option("header", True).csv(path)
    return scans.read_tsv(spark, path, "id BIGINT, kind STRING, price DOUBLE")


@register("SELECT CAST(o_custkey AS VARCHAR) AS \"group\", CAST(o_orderkey AS VARCHAR) AS name, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS size FROM orders")
def nested_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of objects in JSON, one for each customer, as one row for each inner entry."""
    n = B.read(spark, sf, "orders").selectExpr("CAST(o_custkey AS STRING) AS g", "CAST(o_orderkey AS STRING) AS k", "struct(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS size) AS v")
    text = n.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select(F.to_json(F.create_map("g", "m")).alias("text"))
    return scans.entries(text, scans.map_of_maps(F.col("text"), "STRUCT<size: BIGINT>")).select("group", "name", "value.size")


_ITEM = {
    "item_id": "CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE CAST(doc_id AS {s}) END", "page_id": "source", "task_level": "CASE WHEN doc_id % 11 = 0 THEN 'L9' ELSE 'L1' END", "track": "'a11y'",
    "criterion_code": "CASE WHEN doc_id % 7 = 0 THEN 'wcag' WHEN doc_id % 13 = 0 THEN 'layout:x' ELSE 'wcag:1.1.1' END", "question": "'q'", "annotation_unit": "'page'",
    "ground_truth": "CASE WHEN n_chars % 3 = 0 THEN 'maybe' ELSE 'yes' END", "door": "'rules'", "receipt": "'r'", "evidence": "'e'", "split": "CASE WHEN doc_id % 5 = 0 THEN 'train' ELSE 'dev' END", "canary": "'c'",
}


@register(
    f"""WITH i AS (SELECT doc_id, {', '.join(f'{v.format(s="VARCHAR")} AS {k}' for k, v in _ITEM.items())} FROM documents)
    SELECT doc_id, concat_ws('; ', CASE WHEN trim(item_id) = '' THEN 'item_id: missing' END, CASE WHEN task_level = 'L9' THEN 'task_level: not one of L1, L2, L3, L4, design_pair' END, CASE WHEN split = 'train' THEN 'split: not one of dev, test, holdout' END,
      CASE WHEN criterion_code = 'wcag' THEN 'criterion_code: not namespace:local' END, CASE WHEN criterion_code = 'layout:x' THEN 'namespace: does not fit' END, CASE WHEN task_level = 'L1' AND ground_truth = 'maybe' THEN 'ground_truth: not yes or no' END) AS violations FROM i"""
)
def item_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Items written as JSON lines and read by the validated scan, with why each is refused."""
    path = scratch_path(spark, "items")
    d = B.read(spark, sf, "documents").selectExpr("CAST(doc_id AS STRING) AS metadata", *(f"{v.format(s='STRING')} AS {k}" for k, v in _ITEM.items()), "named_struct('source', 's', 'license', 'l', 'retrieval_date', 'd') AS provenance")
    scans.write_lines(d, path, ["metadata"])
    got = tables.with_violations(tables.read_items(spark, path), tables.item_rules())
    return got.select(F.col("metadata").cast("long").alias("doc_id"), F.concat_ws("; ", "violations").alias("violations"))


@register("SELECT doc_id FROM documents WHERE 'wcag:1.' || CAST(doc_id % 9 AS VARCHAR) IN ('wcag:1.1', 'wcag:1.4') AND doc_id % 4 <> 0")
def registered_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose code is well formed and in the registry."""
    registry = spark.createDataFrame([("wcag:1.1",), ("wcag:1.4",), ("wcag",)], "criterion string")
    d = B.read(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 'wcag' ELSE 'wcag:1.' || CAST(doc_id % 9 AS STRING) END AS code")
    return tables.registered(d, "code", registry).select("doc_id")


@register(
    """SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 6 = 0 THEN 'license: missing' END, CASE WHEN doc_id % 5 = 0 THEN 'bucket: not one of synth, real' END, CASE WHEN doc_id % 7 = 0 THEN 'seed: not a whole number' END) AS violations FROM documents"""
)
def page_violations(spark: SparkSession, sf: str) -> DataFrame:
    d = B.read(spark, sf, "documents").selectExpr(
        "doc_id", "'p' AS page_id", "CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE 'real' END AS bucket", "source", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'l' END AS license", "'d' AS retrieval_date", "'c' AS canary",
        "CASE WHEN doc_id % 7 = 0 THEN '1.5' WHEN doc_id % 3 = 0 THEN '12' END AS seed", "array('desktop') AS viewports",
    )
    return tables.with_violations(d, tables.page_rules(["synth", "real"])).select("doc_id", F.concat_ws("; ", "violations").alias("violations"))


@register("SELECT doc_id, source, CASE WHEN source = 'src1' AND n_chars % 4 = 0 THEN 'quarantine' ELSE 'kept' END AS place FROM documents")
def quarantine_sink(spark: SparkSession, sf: str) -> DataFrame:
    """One source's bad rows set apart, both parts written and read back."""
    d = B.read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    found = []
    for place, rows in zip(("kept", "quarantine"), scans.quarantined(d, "src1", F.col("n_chars") % 4 == 0)):
        path = scratch_path(spark, place)
        scans.write_lines(rows, path, ["doc_id"])
        found.append(scans.read_lines(spark, path, "doc_id BIGINT, source STRING").withColumn("place", F.lit(place)))
    return found[0].unionByName(found[1])


@register("SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src1'")
def without_source(spark: SparkSession, sf: str) -> DataFrame:
    return scans.without_source(B.read(spark, sf, "documents").select("doc_id", "source"), "src1")


@register("SELECT CASE WHEN n_chars > 3000 THEN 'too long' WHEN lang <> 'en' THEN 'language' ELSE 'taken' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = B.read(spark, sf, "documents").selectExpr("CASE WHEN n_chars > 3000 THEN 'too long' WHEN lang <> 'en' THEN 'language' END AS reason")
    return scans.ingest_counts(d, "reason")


@register(
    """WITH m AS (SELECT DISTINCT event_type AS manifest, event_id % 30 AS item_id FROM events), w AS (SELECT DISTINCT event_id % 30 AS item_id FROM events WHERE event_type = 'purchase')
    SELECT manifest, count(*) AS n FROM m GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w) AND count(*) FILTER (item_id IN (SELECT item_id FROM w)) = count(*)"""
)
def matching_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifests that list just the wanted ids."""
    e = B.read(spark, sf, "events").selectExpr("event_type AS manifest", "event_id % 30 AS item_id")
    return scans.matching_manifest(e, e.where("manifest = 'purchase'"))


@register("SELECT lang, '| ' || lang || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || coalesce(CAST(max(n_chars) FILTER (n_chars > 100000) AS VARCHAR), '-') || ' |' AS line FROM documents GROUP BY 1")
def markdown_report(spark: SparkSession, sf: str) -> DataFrame:
    d = B.read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max(F.when(F.col("n_chars") > 100000, F.col("n_chars"))).alias("most"))
    return d.select("lang", scans.markdown_rows(d, ["lang", "n", "most"]).alias("line"))
