"""Corpus folders and judges in Python."""

import json
from urllib.parse import unquote

import pytest

from evalmill.operators import table_judges as T
from evalmill.sources import scans


def lay(root, bucket, page, prov, html=True, shots=()):
    folder = root / bucket / page
    folder.mkdir(parents=True)
    if prov is not None:
        (folder / "provenance.json").write_text(json.dumps(prov, indent=1))
    if html:
        (folder / "page.html").write_text("<p>x</p>")
    for s in shots:
        (folder / f"screenshot_{s}.png").write_bytes(b"x")


def corpus(root):
    lay(root, "real", "a", {"page_id": "a", "url": "u", "metadata": {"genre": "shop"}, "viewports": ["desktop", "mobile"]}, shots=["desktop"])
    lay(root, "real", "b{1}", {"page_id": "b{1}"}, shots=["desktop", "tablet"])
    lay(root, "real", "nohtml", {"page_id": "nohtml"}, html=False)
    lay(root, "synthetic", "c", {"page_id": "c", "metadata": {"variant": "mutated", "defect_class": "alt:strip", "severity": "mild", "parent": "d"}, "viewports": []})
    lay(root, "synthetic", "noprov", None)
    lay(root, "other", "e", {"page_id": "e"})


def test_corpus_folders_are_read_as_pages(spark, tmp_path):
    corpus(tmp_path)
    rows = {r.page_id: r for r in scans.read_corpus(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"a", "b{1}", "c"}
    a, b, c = (rows[k] for k in ("a", "b{1}", "c"))
    assert (a.bucket, a.variant, a.group, a.viewports, a.url) == ("real", "clean", "shop", ["desktop", "mobile"], "u")
    assert a.screenshots["mobile"] is None and a.screenshots["desktop"].endswith("/real/a/screenshot_desktop.png") and a.page_path.endswith("/real/a/page.html")
    assert (b.group, b.viewports, list(b.screenshots)) == ("unknown", ["desktop"], ["desktop"])
    assert (c.group, c.variant, c.defect_class, c.severity, c.parent, c.viewports) == ("synthetic-standard", "mutated", "alt:strip", "mild", "d", ["desktop"])


def test_a_filter_lists_only_its_folders(spark, tmp_path):
    corpus(tmp_path)
    files = lambda **k: sorted({unquote(f).split("/")[-2] for f in scans.read_corpus(spark, f"file://{tmp_path}", **k).inputFiles()})
    assert files(buckets=["synthetic"]) == ["c", "noprov"] and files(pages=["b{1}", "zz"]) == ["b{1}"] and files(buckets=["real"], pages=["c"]) == []
    assert [r.page_id for r in scans.read_corpus(spark, f"file://{tmp_path}", ["real"], ["b{1}"]).collect()] == ["b{1}"]
    assert scans.read_corpus(spark, f"file://{tmp_path}/none").count() == 0


def test_a_corpus_on_a_path_that_only_spark_can_open(spark, tmp_path):
    corpus(tmp_path)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.corpus.link./in", f"file://{tmp_path}")
    assert {r.page_id for r in scans.read_corpus(spark, "viewfs://corpus/in").collect()} == {"a", "b{1}", "c"}


def test_judges_see_their_tables_and_no_others(spark):
    def failing(item, assets):
        if item["item_id"] == 2:
            raise ValueError("no picture")
        return item["kind"], 0.5

    items = spark.createDataFrame([(1, "p", "x"), (2, "p", "y"), (3, "q", "x"), (4, None, "y")], "item_id long, page_id string, kind string")
    answers = spark.createDataFrame([(1, "no", 0.9), (3, None, None)], "item_id long, answer string, confidence double")
    pages = spark.createDataFrame([("p", 7)], "page_id string, n int")
    by_page = T.PageJudge("pages", ("pages",), lambda item, assets: ("none" if assets["pages"] is None else str(assets["pages"]["n"]), None))
    replay, odd = T.PageJudge("replay", ("answers",), T.replayed), T.PageJudge("odd", (), failing)
    out = T.run_page_judges(items, [by_page, replay, odd, T.routed("route", {"x": by_page}, "kind")], {"answers": answers, "pages": pages, "other": items})
    got = {(r.judge, r.item_id): (r.answer, r.confidence, r.error) for r in out.collect()}
    assert [got["pages", str(i)][0] for i in (1, 2, 3, 4)] == ["7", "7", "none", "none"]
    assert [got["replay", str(i)][:2] for i in (1, 2, 3, 4)] == [("no", 0.9), ("unknown", None), ("unknown", None), ("unknown", None)]
    assert got["odd", "2"] == ("unknown", None, "ValueError: no picture") and got["odd", "1"] == ("x", 0.5, None)
    assert [got["route", str(i)][0] for i in (1, 2, 3, 4)] == ["7", "unknown", "none", "unknown"] and len(got) == 16
    with pytest.raises(ValueError, match="missing: pages"):
        T.run_page_judges(items, [by_page], {"answers": answers})
    with pytest.raises(ValueError, match="two judges"):
        T.run_page_judges(items, [replay, replay], {"answers": answers})


def test_replayed_runs_equal_the_plan_that_replays(spark):
    from evalmill.operators.judges import run_judges

    items = spark.createDataFrame([(i, f"p{i % 3}") for i in range(30)], "item_id long, page_id string")
    answers = items.where("item_id % 2 = 0").selectExpr("item_id", "CASE WHEN item_id % 3 = 0 THEN 'yes' ELSE 'no' END AS answer", "0.5D AS confidence")
    one = {(int(r.item_id), r.answer) for r in T.run_page_judges(items, [T.PageJudge("replay", ("answers",), T.replayed)], {"answers": answers}).collect()}
    assert one == {(r.item_id, r.answer) for r in run_judges(items, ["canned"], {"answers": answers.select("item_id", "answer")}).collect()}
