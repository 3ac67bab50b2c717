"""Scans and sinks of an evaluation's files: results, judgments, pairs, corpora, manifests, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

RESULT = "item_id STRING, answer STRING, confidence DOUBLE, refused BOOLEAN, ord BIGINT"
JUDGMENT = "rater STRING, pair_id STRING, dimension STRING, choice STRING, side STRING, ord BIGINT"
PAIR = "pair_id STRING, pair_type STRING, known_worse STRING, page_a STRING, page_b STRING"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, which may be a pattern, is there, asked of the file system that holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines with a schema; an absent path is an empty table if ``missing_ok``, else an error.  Blank lines are skipped."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_results(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    """The rows of several result files, each with the name of its judge."""
    frames = [read_lines(spark, path, RESULT).withColumn("judge", F.lit(judge)) for judge, path in named.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.jsonl`` of a folder, with the file's name; an absent folder is an empty table.

    The rows' order is (file, ord): ``ord`` counts within a file.
    """
    path = f"{folder.rstrip('/')}/*.jsonl"
    if not exists(spark, path):
        return spark.createDataFrame([], JUDGMENT + ", file STRING")
    return spark.read.schema(JUDGMENT).json(path).select("*", F.col("_metadata.file_name").alias("file"))


def write_lines(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines with sorted keys, in an order; one row a line, null fields left out."""
    keys = sorted(df.columns)
    df.orderBy(*by).select(F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys))).alias("value")).write.text(path)


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, page_id, provenance, html path) of the pages below ``root/<bucket>/<page>/`` that have both files."""
    path = f"{root.rstrip('/')}/*/*"
    provenance = spark.read.text(f"{path}/provenance.json", wholetext=True).select(F.col("value").alias("provenance"), F.col("_metadata.file_path").alias("p"))
    html = spark.read.format("binaryFile").load(f"{path}/page.html").select(F.col("path").alias("html"))
    bucket, page = (F.regexp_extract("p", r"([^/]+)/([^/]+)/[^/]+$", i) for i in (1, 2))
    left = provenance.select(bucket.alias("bucket"), page.alias("page_id"), "provenance")
    bucket, page = (F.regexp_extract("html", r"([^/]+)/([^/]+)/[^/]+$", i) for i in (1, 2))
    return left.join(html.select(bucket.alias("bucket"), page.alias("page_id"), "html"), ["bucket", "page_id"])


_PROVENANCE = "page_id STRING, url STRING, viewports ARRAY<STRING>, metadata STRUCT<variant: STRING, genre: STRING, defect_class: STRING, severity: STRING, parent: STRING>"


def _glob(names: list[str] | None) -> str:
    """A pattern for folders of these names, or of any."""
    if names is None:
        return "*"
    return "{" + ",".join(re.sub(r"([\\*?\[\]{},])", r"\\\1", n) for n in names) + "}"


def read_corpus(spark: SparkSession, root: str, buckets: list[str] | None = None, pages: list[str] | None = None) -> DataFrame:
    """The pages of a corpus folder (``root/<bucket>/<page>/``) that have their provenance and their source.

    Only folders of the named buckets and pages are listed and read.  Gives
    page_id, bucket, variant (clean by default), viewports (desktop by default),
    group (of real pages their genre, else the one template), defect_class,
    severity, parent, url, page_path, and screenshots, a map from each viewport
    to its picture's path, null where there is none.  Pictures and sources are
    listed, not read.  A folder without a match is an empty table.
    """
    place = f"{root.rstrip('/')}/{_glob(buckets or ['real', 'synthetic'])}/{_glob(pages)}"
    names = [F.element_at(F.split("path", "/"), -i).alias(n) for i, n in ((3, "bucket"), (2, "folder"))]

    def listed(pattern: str) -> DataFrame:
        if not exists(spark, f"{place}/{pattern}"):
            return spark.createDataFrame([], "path string, content binary")
        return spark.read.format("binaryFile").load(f"{place}/{pattern}").select("path", "content")

    said = listed("provenance.json").select(*names, F.from_json(F.decode("content", "UTF-8"), _PROVENANCE).alias("p"))
    sources = listed("page.html").select(*names, F.col("path").alias("page_path"))
    shot = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^screenshot_(.+)\.png$", 1)
    shots = listed("screenshot_*.png").select(*names, F.struct(shot.alias("viewport"), "path").alias("s"))
    shots = shots.groupBy("bucket", "folder").agg(F.map_from_entries(F.collect_list("s")).alias("there"))
    rows = said.join(sources, ["bucket", "folder"]).join(shots, ["bucket", "folder"], "left")
    viewports = F.when(F.size("p.viewports") > 0, F.col("p.viewports")).otherwise(F.array(F.lit("desktop")))
    group = F.when(F.col("bucket") == "real", F.coalesce("p.metadata.genre", F.lit("unknown"))).otherwise("synthetic-standard")
    rows = rows.select(
        F.col("p.page_id").alias("page_id"), "bucket", F.coalesce("p.metadata.variant", F.lit("clean")).alias("variant"), viewports.alias("viewports"), group.alias("group"), F.col("p.metadata.defect_class").alias("defect_class"),
        F.col("p.metadata.severity").alias("severity"), F.col("p.metadata.parent").alias("parent"), F.col("p.url").alias("url"), "page_path", "there",
    )
    pictures = F.map_from_arrays("viewports", F.transform("viewports", lambda v: F.try_element_at("there", v)))
    return rows.withColumn("screenshots", pictures).drop("there")


def first_bucket(pages: DataFrame, buckets: list[str]) -> DataFrame:
    """Of a page that stands in several buckets, the row of the first one in the list."""
    order = F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket"))
    at = F.row_number().over(Window.partitionBy("page_id").orderBy(order))
    return pages.where(order > 0).withColumn("_at", at).where("_at = 1").drop("_at")


def exactly_one(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, or an error when the query runs if a key stands in more than one."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = rows.withColumn("_n", n)
    return checked.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"more than one row of {key} "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows below a header, with fields of up to ten million characters."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("maxCharsPerColumn", 10_000_000).csv(path)


def map_of_maps(text: Column, value: str) -> Column:
    """A JSON object of objects as MAP<STRING, MAP<STRING, value>>."""
    return F.from_json(text, f"MAP<STRING, MAP<STRING, {value}>>")


def entries(df: DataFrame, nested: Column) -> DataFrame:
    """(group, name, value) of a map of maps."""
    outer = df.select(F.explode(nested).alias("group", "inner"))
    return outer.select("group", F.explode("inner").alias("name", "value"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def without_source(rows: DataFrame, source: str, column: str = "source") -> DataFrame:
    """Every row but those of a source; rows without a source stay."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(source)))


def quarantined(rows: DataFrame, source: str, bad: Column, column: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go to quarantine): of one source, those for which ``bad`` holds."""
    goes = F.col(column).eqNullSafe(F.lit(source)) & F.coalesce(bad, F.lit(False))
    return rows.where(~goes), rows.where(goes)


def ingest_counts(rows: DataFrame, reason: str) -> DataFrame:
    """Rows taken (null reason) and skipped, by reason."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("taken")).alias("outcome")).agg(F.count("*").alias("n"))


def write_counted(rows: DataFrame, path: str, reason: str, reasons: list[str]) -> dict[str, int]:
    """Writes the rows without a reason as Parquet, and counts all rows by reason in that same pass.

    Gives ``taken``, a number for each of ``reasons``, ``other`` for any reason
    besides, and ``total``; the counts come from the write's own job.
    """
    seen = Observation()
    why = F.col(reason)
    counts = [F.count_if(why == r).alias(r) for r in reasons]
    marked = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(why.isNull()).alias("taken"), F.count_if(why.isNotNull() & ~why.isin(*reasons)).alias("other"), *counts)
    marked.where(why.isNull()).drop(reason).write.parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def matching_manifest(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """The manifests (manifest, item_id) whose set of ids is that of ``wanted`` (item_id)."""
    want, ids = wanted.select("item_id").distinct(), manifests.select("manifest", "item_id").distinct()
    sizes = ids.groupBy("manifest").agg(F.count("*").alias("n"))
    hits = ids.join(want, "item_id").groupBy("manifest").agg(F.count("*").alias("hits"))
    total = want.agg(F.count("*").alias("total"))  # one row
    return sizes.join(hits, "manifest").join(F.broadcast(total)).where("n = hits and n = total").select("manifest", "n")


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """A table's row in Markdown; numbers as Spark shows them, null as a dash."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), F.lit(" |"))
