"""Registered queries against their SQL on the smallest tables, and the rules of the scan."""

import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from evalmill import catalog
from evalmill.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "documents labels events lineitem part conversations".split()
CHOSEN = (
    "parse_responses", "score_all_levels", "decision_rules", "items_for_mutation",
    "l1_by_criterion", "l2_multilabel", "ece_total", "mcnemar_counts", "alpha_nominal", "promote_gates", "round_robin_sample", "coverage_matrix", "cost_rollup")


def _rows(frame):
    show = lambda v: "" if v is None or v != v else f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in row) for row in frame)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert _rows(got.select(*columns).collect()) == _rows(want)


def test_listing_queries_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_item_rules_name_what_is_wrong(spark, tmp_path):
    good = {
        "item_id": "i", "page_id": "p", "task_level": "L1", "track": "a11y", "criterion_code": "wcag:1.1.1", "question": "q", "annotation_unit": "page", "ground_truth": "yes",
        "door": "rules", "receipt": '{"a":1}', "evidence": "e", "split": "dev", "canary": "c", "provenance": {"source": "s", "license": "l", "retrieval_date": "d"},
    }
    bad = good | {"track": "layout", "ground_truth": "maybe", "receipt": "{}", "provenance": {"source": "s", "license": " "}}
    path = tmp_path / "items.jsonl"
    path.write_text("\n".join(["", json.dumps(good), json.dumps(bad), ""]))
    valid, rejected = tables.valid_and_rejected(tables.read_items(spark, str(path)), tables.item_rules())
    assert valid.count() == 1
    assert rejected.first().violations == ["namespace: does not fit", "ground_truth: not yes or no", "receipt: empty", "provenance.license: missing", "provenance.retrieval_date: missing"]


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"task_level": "L2", "ground_truth": '["wcag:1.1.1"]'}, None),
        ({"task_level": "L2", "ground_truth": '["x"]'}, "ground_truth: not a list of codes"),
        ({"task_level": "L3", "annotation_unit": "element", "ground_truth": '{"selector": "#a", "bbox": [1, 2, 3, 4]}', "anchor": {"selector": "#a"}}, None),
        ({"task_level": "L3", "annotation_unit": "element", "ground_truth": '{"selector": "#a", "bbox": [1, 2, 3]}', "anchor": {"selector": "#a"}}, "ground_truth: not a selector with four numbers"),
        ({"task_level": "L4", "annotation_unit": "element"}, "anchor: missing"),
        ({"task_level": "L4", "annotation_unit": "element", "anchor": {"type": "element"}}, "anchor: neither selector nor bbox"),
        ({"task_level": "L4", "annotation_unit": "element", "anchor": {"bbox": [1, 2, 3, "Infinity"]}}, "anchor: bbox is not four numbers"),
        ({"task_level": "L4", "annotation_unit": "region", "anchor": {"type": "named_region", "name": "top"}}, "anchor: region without type, name or bbox"),
        ({"anchor": {"selector": "#a"}}, "anchor: not wanted"),
    ],
)
def test_each_level_has_its_shape(spark, tmp_path, change, reason):
    good = {
        "item_id": "i", "page_id": "p", "task_level": "L1", "track": "a11y", "criterion_code": "wcag:1.1.1", "question": "q", "annotation_unit": "page", "ground_truth": "yes",
        "door": "rules", "receipt": '{"a":1}', "evidence": "e", "split": "dev", "canary": "c", "provenance": {"source": "s", "license": "l", "retrieval_date": "d"},
    }
    path = tmp_path / "items.jsonl"
    path.write_text(json.dumps(good | change))
    row = tables.with_violations(tables.read_items(spark, str(path)), tables.item_rules()).first()
    assert row.violations == ([reason] if reason else [])


def test_files_of_an_evaluation(spark, tmp_path):
    import hashlib

    from evalmill.sources import scans

    assert scans.read_lines(spark, str(tmp_path / "none.jsonl"), "a LONG", missing_ok=True).count() == 0
    assert scans.read_judgments(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "j").mkdir()
    for name, rows in (("b", ["2"]), ("a", ["0", "1"])):
        (tmp_path / "j" / f"{name}.jsonl").write_text("\n".join(json.dumps({"rater": r, "pair_id": "p", "choice": "A", "ord": k}) for k, r in enumerate(rows)) + "\n\n")
    (tmp_path / "j" / "notes.txt").write_text("x")
    got = scans.read_judgments(spark, str(tmp_path / "j")).orderBy("file", "ord").collect()
    assert [(r.file, r.rater) for r in got] == [("a.jsonl", "0"), ("a.jsonl", "1"), ("b.jsonl", "2")]
    for bucket, page, html in (("synth", "p1", True), ("real", "p1", True), ("real", "p2", False)):
        folder = tmp_path / "corpus" / bucket / page
        folder.mkdir(parents=True)
        (folder / "provenance.json").write_text(json.dumps({"page_id": page}))
        if html:
            (folder / "page.html").write_text("<p>x</p>")
    pages = scans.read_pages(spark, str(tmp_path / "corpus"))
    assert {(r.bucket, r.page_id) for r in pages.collect()} == {("synth", "p1"), ("real", "p1")}
    assert [(r.bucket, r.page_id) for r in scans.first_bucket(pages, ["real", "synth"]).collect()] == [("real", "p1")]
    with pytest.raises(Exception, match="more than one row"):
        scans.exactly_one(pages, "page_id").collect()
    (tmp_path / "t.tsv").write_text("id\ttext\n1\ta, b\n2\t" + "c" * 200_000 + "\n")
    assert [len(r.text) for r in scans.read_tsv(spark, str(tmp_path / "t.tsv"), "id LONG, text STRING").orderBy("id").collect()] == [4, 200_000]
    digest = scans.file_digests(spark, str(tmp_path / "t.tsv")).first()
    assert digest.sha256 == hashlib.sha256((tmp_path / "t.tsv").read_bytes()).hexdigest()
    pairs = spark.createDataFrame([("b", "validity", "A"), ("a", "preference", None)], "pair_id string, pair_type string, known_worse string")
    scans.write_lines(pairs.coalesce(1), str(tmp_path / "pairs"), ["pair_id"])
    lines = [line for p in sorted((tmp_path / "pairs").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['{"pair_id":"a","pair_type":"preference"}', '{"known_worse":"A","pair_id":"b","pair_type":"validity"}']


def test_replace_by_source(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "item long, source string")
    new = spark.createDataFrame([(3, "a")], "item long, source string")
    assert sorted(r.item for r in tables.replaced_by_source(old, new, "a").collect()) == [2, 3]
    path = str(tmp_path / "t")
    tables.write_replacing_source(old, path)
    tables.write_replacing_source(new, path)
    assert sorted(r.item for r in spark.read.parquet(path).collect()) == [2, 3]


def test_journal_keeps_the_last_judgment(spark, tmp_path):
    from evalmill.streaming.journal import journal, last_judgments

    schema = "rater long, pair_id long, choice string, ord long"
    inbox = str(tmp_path / "in")
    for rows in ([(1, 1, "A", 0), (1, 2, "B", 1)], [(1, 1, "B", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(inbox)
        stream = spark.readStream.schema(schema).json(inbox)
        journal(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    last = lambda: [(r.pair_id, r.choice) for r in last_judgments(spark, str(tmp_path / "out"), schema, ["rater", "pair_id"], "ord").orderBy("pair_id").collect()]
    assert last() == [(1, "B"), (2, "B")]
    spark.createDataFrame([(1, 2, "A", 9)], schema).write.json(str(tmp_path / "in2"))
    journal(spark.readStream.schema(schema).json(str(tmp_path / "in2")), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(60)
    assert last() == [(1, "B"), (2, "A")]


def test_answer_scan_sees_every_row_and_refusal(spark, tmp_path):
    said = ["I can't help", "I cannot help", "I can't assist", "I cannot assist", "I'm unable to", "I am unable to", "I won't", "As an AI", "I'm not able to"]
    rows = [(i, f"Well, {t} with that.", ("en", "de", None)[i % 3]) for i, t in enumerate(said)] + [(20, "Yes, it is.", "fr"), (21, None, "en"), (22, "yesterday, no", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.refusal, r.said) for r in catalog.queries()["answer_scan"](spark, str(tmp_path)).collect()}
    assert got == {i: (True, None) for i in range(9)} | {20: (False, "yes"), 21: (False, None), 22: (False, "no")}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {i: (a, b) for i, a, b in db.execute(f"SELECT doc_id, refusal, said FROM ({catalog.oracle_sql()['answer_scan']})").fetchall()} == got
    db.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    whole = catalog.queries()["answer_scan"](spark, SF).select("doc_id", "refusal", "said").collect()
    assert _rows(whole) == _rows(db.execute(f"SELECT doc_id, refusal, said FROM ({catalog.oracle_sql()['answer_scan']})").fetchall())


def test_aggregated_runs_where_most_runs_have_no_answer(spark, tmp_path):
    ids = [(1, i) for i in (5, 10, 15, 20, 6, 7, 12)] + [(2, i) for i in (25, 30)] + [(3, i) for i in (41, 46, 35, 40)]
    spark.createDataFrame(ids, "user_id long, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["aggregated_runs"](spark, str(tmp_path))
    assert {r.user_id: r.answer for r in got.collect()} == {1: "b", 2: None, 3: "a"}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert _rows(got.collect()) == _rows(db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['aggregated_runs']})").fetchall())


def test_answer_scan_ends_words_as_its_sql_does(spark, tmp_path):
    texts = ["nonoñcob yes", "noñcob yes", "ñno yes", "no_ yes", "no2 Yes", "éyes", "no\u0663", "no\u0301", "no\u200d", "İ'm unable to", "as an aİ", "AS AN AI: NO", "no\nyes"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = _rows(catalog.queries()["answer_scan"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == _rows(db.execute(f"SELECT doc_id, refusal, said FROM ({catalog.oracle_sql()['answer_scan']})").fetchall())


def test_pairs_of_large_groups_are_dealt_and_equal_their_sql(spark, tmp_path, monkeypatch):
    from evalmill.operators import relations

    monkeypatch.setattr(relations, "SQUARE", 16)
    # groups of 200, 3 and 1 rows, more groups of a brand than it has places, ids that stand twice in one group and in two, and nulls
    rows = [(i, "A", 1 + i // 200, "t") for i in range(400)] + [(i, "B", i % 7, "t") for i in range(400, 420)] + [(5, "A", 1, "t"), (5, "B", 2, "t"), (402, "B", 3, "u"), (900, None, 1, "t"), (None, "B", 2, "t"), (901, "C", 1, "t"), (902, "C", None, "t"), (903, "C", None, "t")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("combination_pairs", "pairs_by_viewport", "build_pairs"):
        got = catalog.queries()[name](spark, str(tmp_path))
        assert _rows(got.collect()) == _rows(db.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()), name
    for name in ("combination_pairs", "pairs_by_viewport"):
        tasks = catalog.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions()
        assert tasks >= 4 * spark.sparkContext.defaultParallelism, name


def test_families_are_made_distinct_before_they_are_joined(spark):
    plan = catalog.queries()["covered_families"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    right = [line for line in plan.splitlines() if ":- Aggregate [family" in line or "+- Aggregate [family" in line]
    assert len(right) >= 2, plan


def test_findings_are_not_dealt_by_tag(spark):
    got = catalog.queries()["criteria_of_tags"](spark, SF)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().sparkPlan().toString()
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert _rows(got.select("id", "criterion").collect()) == _rows(db.execute(f"SELECT id, criterion FROM ({catalog.oracle_sql()['criteria_of_tags']})").fetchall())
