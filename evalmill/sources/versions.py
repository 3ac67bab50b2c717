"""A table of many sources in which one source's rows are replaced at once, for readers too.

Rows lie in folders that never change.  A version is a small file, written last,
that lists the folders and the sources in each that no longer count.  A reader
takes the newest version, or one that it names, and keeps seeing it whatever is
written later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class VersionTaken(RuntimeError):
    """Another writer has made the version meanwhile; nothing of this one shows."""


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, its class of paths)."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the committed versions, in order."""
    fs, place = _files(spark, path)
    folder = place(f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _entries(spark: SparkSession, path: str, version: int) -> list[dict]:
    text = spark.read.text(f"{path}/versions/{version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)["entries"]


def _commit(spark: SparkSession, path: str, version: int, entries: list[dict]) -> int:
    fs, place = _files(spark, path)
    draft, final = place(f"{path}/versions/.{uuid.uuid4().hex}"), place(f"{path}/versions/{version:012d}.json")
    if fs.exists(final):
        raise VersionTaken(f"version {version} of {path}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "entries": entries}).encode()))
    out.close()
    # A rename does not replace a file on a cluster's file system, so of two writers one fails.
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise VersionTaken(f"version {version} of {path}")
    return version


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None, column: str = "source") -> DataFrame:
    """The rows of a version, the newest by default; no version yet is an empty table."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    rows = None
    for entry in _entries(spark, path, known[-1] if version is None else version):
        part = spark.read.schema(schema).parquet(f"{path}/data/{entry['folder']}")
        if entry["without"]:
            # null is a source of its own: it goes only where it was replaced itself
            named = [s for s in entry["without"] if s is not None]
            gone = F.coalesce(F.col(column).isin(*named), F.lit(False)) if named else F.lit(False)
            part = part.where(~gone & (F.col(column).isNotNull() if None in entry["without"] else F.lit(True)))
        rows = part if rows is None else rows.unionByName(part)
    return spark.createDataFrame([], schema) if rows is None else rows


def replace_source(spark: SparkSession, path: str, new: DataFrame, source: str | None, column: str = "source") -> int:
    """Makes a version in which the rows of ``source`` are those of ``new``; only these are written.

    Rows of ``new`` with another source are an error when they are written.  To
    run it again with the same rows gives the same table.  Where the job fails,
    or another writer was first, the newest version stays what it was.
    """
    known = versions(spark, path)
    entries = _entries(spark, path, known[-1]) if known else []
    folder = uuid.uuid4().hex
    right = F.col(column).eqNullSafe(F.lit(source))
    checked = F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("a row of another source: "), F.coalesce(F.col(column), F.lit("null")))).cast("boolean"))
    new.where(checked).write.parquet(f"{path}/data/{folder}")
    kept = [{"folder": e["folder"], "without": [*(s for s in e["without"] if s != source), source]} for e in entries if e.get("only", "") != [source]]
    return _commit(spark, path, (known[-1] if known else 0) + 1, [*kept, {"folder": folder, "without": [], "only": [source]}])


def replace_all(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Makes a version of ``rows`` alone, of any sources: a first load, or the folders of many replacements as one."""
    known = versions(spark, path)
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}")
    return _commit(spark, path, (known[-1] if known else 0) + 1, [{"folder": folder, "without": []}])


def remove_versions(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Removes all but the last ``keep`` versions, and folders that none of these names; gives the removed numbers.

    Folders of writers that have not committed go as well, so nobody may be writing.
    """
    known = versions(spark, path)
    gone, stay = known[: max(len(known) - keep, 0)], known[max(len(known) - keep, 0) :]
    used = {e["folder"] for v in stay for e in _entries(spark, path, v)}
    fs, place = _files(spark, path)
    for v in gone:
        fs.delete(place(f"{path}/versions/{v:012d}.json"), False)
    data = place(f"{path}/data")
    for status in fs.listStatus(data) if fs.exists(data) else ():
        if status.getPath().getName() not in used:
            fs.delete(status.getPath(), True)
    return gone
