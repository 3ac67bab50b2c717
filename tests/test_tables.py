"""Versions of a table, judgments with state, counted writes."""

import random

import pytest
from pyspark.sql import functions as F

from evalmill.operators import crops, instrument, sampling, scoring
from evalmill.sources import scans, versions
from evalmill.streaming import judgments

SCHEMA = "item long, source string, v string"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def held(spark, path, version=None):
    return sorted(((r.item, r.source, r.v) for r in versions.read_version(spark, path, SCHEMA, version).collect()), key=str)


def test_a_source_is_replaced_for_all_readers_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert held(spark, path) == [] and versions.versions(spark, path) == []
    versions.replace_all(spark, path, rows_of(spark, (1, "a", "old"), (2, "a", "old"), (3, "b", "old"), (4, None, "old")))
    pinned = versions.read_version(spark, path, SCHEMA)
    for _ in range(2):  # again with the same rows: the same table
        versions.replace_source(spark, path, rows_of(spark, (9, "a", "new")), "a")
        assert held(spark, path) == [(3, "b", "old"), (4, None, "old"), (9, "a", "new")]
    versions.replace_source(spark, path, rows_of(spark, (5, None, "new")), None)
    assert held(spark, path) == [(3, "b", "old"), (5, None, "new"), (9, "a", "new")]
    versions.replace_source(spark, path, spark.createDataFrame([], SCHEMA), "b")
    assert held(spark, path) == [(5, None, "new"), (9, "a", "new")]
    assert sorted(r.item for r in pinned.collect()) == [1, 2, 3, 4] and len(held(spark, path, 1)) == 4
    assert versions.remove_versions(spark, path, keep=2) == [1, 2, 3]
    assert held(spark, path) == [(5, None, "new"), (9, "a", "new")] and len(held(spark, path, 4)) == 3


def test_a_failure_before_the_commit_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    versions.replace_all(spark, path, rows_of(spark, (1, "a", "old")))
    with pytest.raises(Exception, match="a row of another source"):
        versions.replace_source(spark, path, rows_of(spark, (2, "b", "x")), "a")
    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.replace_source(spark, path, rows_of(spark, (2, "a", "new")), "a")
    assert held(spark, path) == [(1, "a", "old")]
    with monkeypatch.context() as m:  # a second writer that began from the same version
        m.setattr(versions, "versions", lambda *a: [])
        with pytest.raises(versions.VersionTaken):
            versions.replace_source(spark, path, rows_of(spark, (3, "a", "new")), "a")
    assert held(spark, path) == [(1, "a", "old")]
    versions.remove_versions(spark, path)
    assert held(spark, path) == [(1, "a", "old")]


def test_streamed_judgments_stop_and_go_on(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(4), rng.choice(["x", "y"]), rng.choice(["A", "B", None]), rng.choice(["left", "right"]), rng.randrange(60)) for _ in range(300)]
    rows += rows[:40] + [(None, 1, "x", "A", "left", 99), (1, None, "x", "A", "left", 99), (1, 1, None, "A", "left", 99), (1, 1, "x", "A", "left", None)]
    source, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    assert judgments.judged(spark, out).count() == 0

    def run():
        stream = spark.readStream.schema(judgments.ROW).option("maxFilesPerTrigger", 1).parquet(source)
        judgments.follow(stream, out, check).awaitTermination()

    for part in range(3):  # stops after each, and goes on from its checkpoint
        for k in range(2):
            spark.createDataFrame(rows[(2 * part + k) :: 6], judgments.ROW).coalesce(1).write.mode("append").parquet(source)
        run()
    run()  # nothing new
    want = {}
    for r in rows:
        if None not in (*r[:3], r[5]):
            want[r[:3]] = max(want.get(r[:3], (-1, "", "")), (r[5], r[3] or "", r[4] or ""))
    got = {(r.rater, r.pair_id, r.dimension): (r.ord, r.choice or "", r.side or "") for r in judgments.judged(spark, out).collect()}
    assert got == want


def test_a_counted_write_is_one_pass(spark, tmp_path):
    rows = spark.range(100).withColumn("why", F.expr("CASE WHEN id % 3 = 0 THEN 'long' WHEN id % 7 = 0 THEN 'odd' WHEN id = 1 THEN 'lang' END"))
    spark.sparkContext.setJobGroup("counted", "counted")
    counts = scans.write_counted(rows, f"{tmp_path}/kept", "why", ["long", "lang", "none"])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("counted")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    by = {r.why: r["count"] for r in rows.groupBy("why").count().collect()}
    assert counts == {"total": 100, "taken": by[None], "long": by["long"], "lang": 1, "none": 0, "other": by["odd"]} and len(jobs) == 1
    assert spark.read.parquet(f"{tmp_path}/kept").count() == by[None]


def plain_clip(box, local, screen, page):
    """The region along both axes, step by step in floats."""
    out = []
    for k, (low, high) in enumerate(((320.0, 1024.0), (240.0, 768.0))):
        start, size = box[k], box[2 + k]
        wanted = size + 96 if local else min(screen[k], max(low, min(size + 96, high)))
        length = min(max(wanted, 1.0), page[k])
        at = min(max(start + size / 2 - length / 2, 0.0), max(page[k] - length, 0.0))
        if local:
            at = min(at, start)
            length = min(max(length, start + size - at), page[k] - at)
        out.append((at, length))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def test_crops_match_plain_steps(spark):
    rng = random.Random(8)
    rows = [([rng.uniform(-50, 1400), rng.uniform(-50, 3000), rng.uniform(1, 1500), rng.uniform(1, 1500)], rng.random() < 0.5, rng.choice(["desktop", "mobile", "watch"]), float(rng.choice([390, 1280, 1400])), float(rng.choice([300, 900, 4000]))) for _ in range(400)]
    frame = spark.createDataFrame(rows, "b array<double>, local boolean, viewport string, pw double, ph double")
    box = F.struct(*(F.col("b")[i].alias(k) for i, k in enumerate("xywh")))
    size = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    clip = crops.source_clip(box, F.col("local"), size(F.lit(1280.0), F.lit(800.0)), size(F.col("pw"), F.col("ph")))
    for r in frame.withColumn("c", clip).withColumn("p", crops.picture_size(F.col("viewport"), F.col("c"))).collect():
        want = plain_clip(r.b, r.local, (1280.0, 800.0), (r.pw, r.ph))
        assert tuple(r.c) == want
        if r.viewport == "watch":
            assert tuple(r.p) == (None, None)
            continue
        most = crops.LARGEST[r.viewport]
        scale = min(most[0] / want[2], most[1] / want[3], 1.0)
        assert tuple(r.p) == (max(1, round(want[2] * scale)), max(1, round(want[3] * scale)))


def test_keys_without_an_item_are_reported_or_refused(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "item_id long, page string")
    results = spark.createDataFrame([("a", 1), ("a", 1), ("a", 9), ("a", 9), ("a", 8), ("b", 3), ("b", None)], "judge string, item_id long")
    got = {(r.judge, r.page): (r.expected, r.matched, r.missing, r.duplicates, r.match_rate) for r in scoring.join_contract(items, results, ["page"]).collect()}
    assert got == {("a", "x"): (2, 1, 1, 1, 0.5), ("a", "y"): (1, 0, 1, 0, 0.0), ("b", "x"): (2, 0, 2, 0, 0.0), ("b", "y"): (1, 1, 0, 0, 1.0)}
    assert {(r.judge, r["keys"], r.attempts, tuple(r.examples)) for r in scoring.unknown_keys(items, results, 1).collect()} == {("a", 2, 3, (8,)), ("b", 1, 1, ())}
    with pytest.raises(Exception, match="no item has the key"):
        scoring.checked_keys(items, results).collect()
    assert scoring.checked_keys(items, results.where("item_id < 4")).count() == 3


def test_a_short_stratum_is_an_error(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(4)] + [("b", 1)], "k string, i int")
    assert sampling.quota_sample(rows.where("k is null or k = 'a'"), ["k"], [F.col("i")], 3).count() == 6
    with pytest.raises(Exception, match="too few rows"):
        sampling.quota_sample(rows, ["k"], [F.col("i")], 3).collect()


def test_the_audit_gate_fails_on_any_reason(spark):
    rows = spark.createDataFrame([(1, []), (2, [])], "id int, reasons array<string>")
    assert instrument.all_valid(rows).count() == 2
    with pytest.raises(Exception, match="invalid instrument: x, y"):
        instrument.all_valid(rows.union(spark.createDataFrame([(3, ["x", "y"])], rows.schema))).collect()
