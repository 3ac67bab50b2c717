"""Elements of pages, what is measured on them, and planted defects, against plain versions."""

import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmill.operators import decisions, measure, mutate
from evalmill.plans.pages import mutated_pages
from evalmill.sources.elements import VOID, element_table, numbered_pages, scan
from evalmill.sources.scratch import shared_folder, written

PAGE = """<!DOCTYPE html><html><body style="color:#111"><h1 id=top>Titel &amp; more</h1><h2>Zwei</h2>
<div style='background: #EEE; font-size:20px'><p class="x" title="a > b">Erster <b>fett</b> é😀</p><p style="color: rgb(1,2,3) !important;">Zweiter</p></div>
<img src="a.png" alt="Ein Hund"><img alt='' src=b.png><img src=c.png>
<form><label for="name">Name</label><input id="name"><label>In <select></select></label><input type=hidden id=h><textarea aria-label="T"></textarea><input id=lost></form>
<ul><li><a href="/1">Eins</a><li><a href="/2" style="margin-left:0px">Zwei</a></ul><h3>Drei</h3><script>if (a<b) "<p>";</script><!-- <p>no</p> --></body></html>"""


class Plain(HTMLParser):
    """A tree of well-formed pages: (tag, parent, attributes, own words)."""

    def __init__(self):
        super().__init__()
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.rows.append([tag, self.open[-1] if self.open else -1, {k: v or "" for k, v in reversed(attrs)}, []])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.open.pop()

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]][3].extend(data.split())


TREES = st.recursive(
    st.sampled_from(["one", " two &lt; ", "é", "", "<br>", "<img alt='x y'>", "<!-- <b> -->"]),
    lambda inner: st.builds(lambda tag, attrs, body: f"<{tag}{attrs}>{''.join(body)}</{tag}>", st.sampled_from(["div", "span", "section", "b"]), st.sampled_from(["", ' id="a"', " title='q > r' x", ' style="color:red" style="color:blue"', " k=v"]), st.lists(inner, max_size=4)),
    max_leaves=20,
)


@settings(max_examples=200, deadline=None)
@given(TREES)
def test_elements_of_well_formed_pages_match_a_plain_tree(html):
    plain, rows = Plain(), list(scan(html))
    plain.feed(html)
    plain.close()
    assert [(r[4], r[2], {a["name"]: a["value"] for a in r[5]}, r[11].split()) for r in rows] == [tuple(r) for r in plain.rows]
    for r in rows:
        node, last, parent = r[:3]
        inside = [x[0] for x in rows if is_inside(rows, x[0], node)]
        assert inside == list(range(node + 1, last + 1)) and html[r[6] : r[7]].startswith(f"<{r[4]}") and (parent < node)
        if r[9] > r[8]:
            assert html[r[8] : r[9]] == f"</{r[4]}>"
        assert all(html[a["start"] : a["end"]].strip().lower().startswith(a["name"]) for a in r[5])
        assert r[10] == sum(len(w) for x in [node, *inside] for w in rows[x][11].split())


def is_inside(rows, x, node):
    while x != -1:
        x = rows[x][2]
        if x == node:
            return True
    return False


def test_broken_pages_keep_what_can_be_read():
    tags = lambda html: [(r[4], r[2]) for r in scan(html)]
    assert tags("<p>a<p>b<div>c") == [("p", -1), ("p", -1), ("div", -1)]
    assert tags("<ul><li>1<li>2<ul><li>3</ul></ul></b>") == [("ul", -1), ("li", 0), ("li", 0), ("ul", 2), ("li", 3)]
    assert tags("<a b=\"x><i>") == [("a", -1), ("i", 0)] and tags("<") == tags("") == tags("x < y") == []
    assert tags("<table><tr><td>1<td>2<tr><td>3</table>") == [("table", -1), ("tr", 0), ("td", 1), ("td", 1), ("tr", 0), ("td", 4)]
    assert tags("<script><b></script><i>") == [("script", -1), ("i", -1)] and tags("<script><b>") == [("script", -1)]
    assert len(list(scan("<div>" * 30_000))) == 30_000


def pages_of(spark, htmls, ids=None):
    rows = [(i, "u", h, 1, 2) for i, h in zip(ids or range(len(htmls)), htmls)]
    return numbered_pages(spark.createDataFrame(rows, "page_id long, url string, html string, node int, last int"))


ODD = [PAGE, None, "", "no tags", "<p>", PAGE.replace("\n", ""), "<h2>x</h2><h4>y</h4><input><label for=q>z</label>"]


def inherited(rows, node, own):
    while node != -1:
        if own(rows[node]) is not None:
            return own(rows[node])
        node = rows[node][2]


def plain_style(row, name):
    style = next((a["value"].lower() for a in row[5] if a["name"] == "style"), "")
    found = [v for k, _, v in (d.partition(":") for d in style.split(";")) if k.strip() == name]
    return found[-1].replace("!important", "").strip() if found else None


def test_measurements_match_plain_walks(spark):
    pages = pages_of(spark, ODD, [1, 2, None, 2, 5, 6, 7])
    elements = element_table(pages)
    asked = elements.select("row", "node").crossJoin(spark.createDataFrame([(c,) for c in ("contrast:degrade", "alt:strip", "label:orphan", "heading:skip", "overlap:shift")], "defect_class string"))
    got = {(r.row, r.node, r.defect_class): r for r in decisions.judged(measure.measurements(elements, asked)).collect()}
    count = 0
    for p in pages.collect():
        rows = list(scan(p.html))
        order = [(r[0], int(r[4][1])) for r in rows if r[4] in measure.HEADINGS]
        skips = sum(b[1] > a[1] + 1 for a, b in zip(order, order[1:]))
        fors = {a["value"] for r in rows if r[4] == "label" for a in r[5] if a["name"] == "for"}
        for r in rows:
            count += 1
            m = got[p.row, r[0], "contrast:degrade"]
            assert m.fg == (inherited(rows, r[0], lambda x: plain_style(x, "color")) or "rgb(0, 0, 0)")
            ground = lambda x: plain_style(x, "background-color") or plain_style(x, "background")
            assert m.bg == (inherited(rows, r[0], ground) or "rgb(255, 255, 255)")
            size = lambda x: (plain_style(x, "font-size") or "").removesuffix("px") or measure.HEADING_PX.get(x[4])
            assert m.font_size == float(inherited(rows, r[0], size) or 16)
            assert m.font_weight == (inherited(rows, r[0], lambda x: "700" if x[4] in (*measure.HEADINGS, "b", "strong", "th") else None) or "400")
            attrs = {a["name"]: a["value"] for a in r[5]}
            assert (got[p.row, r[0], "alt:strip"].fires, got[p.row, r[0], "alt:strip"].alt) == ("alt" not in attrs, attrs.get("alt"))
            control = r[4] in ("select", "textarea") or (r[4] == "input" and attrs.get("type", "") not in measure.UNLABELLED_TYPES)
            labelled = attrs.get("id", "") in fors - {""} or "aria-label" in attrs or any(x[4] == "label" and x[0] < r[0] <= x[1] for x in rows)
            assert (got[p.row, r[0], "label:orphan"].measured, got[p.row, r[0], "label:orphan"].fires) == (control, control and not labelled)
            assert (got[p.row, r[0], "heading:skip"].measured, got[p.row, r[0], "heading:skip"].fires) == (bool(order), skips > 0)
            assert not got[p.row, r[0], "overlap:shift"].measured
    assert count * 5 == len(got) and element_table(pages.limit(0)).count() == 0


def test_an_element_that_is_not_there_is_not_measured(spark):
    pages = pages_of(spark, ["<p>x</p>"])
    asked = pages.selectExpr("row", "99 AS node", "'alt:strip' AS defect_class")
    row = decisions.judged(measure.measurements(element_table(pages), asked)).first()
    assert (row.measured, row.fires) == (False, False)


@pytest.mark.parametrize("severity", ["mild", "moderate", "severe"])
def test_planted_defects_show_and_can_be_taken_out(spark, severity):
    pages = pages_of(spark, ODD)
    elements = element_table(pages)
    mutants, receipts = mutate.mutated(pages, elements, severity)
    sources, plants = {r.row: r.html for r in pages.collect()}, {(r.row, r.defect_class): r for r in receipts.collect()}
    rows = mutants.collect()
    assert {r.defect_class for r in rows if sources[r.row] == PAGE} == {"contrast:degrade", "alt:strip", "alt:garble", "label:orphan", "heading:skip", "target:shrink", "clip:overflow", "protrude:viewport", "align:flip", "weight:strip", "size:jitter"}
    for r in rows:
        source, at, back, kept = sources[r.row], 0, "", []
        for e in r.undo:  # outside the spans, every character is the source's
            kept.append(r.html[at : e.start])
            back += kept[-1] + e.text
            at = e.end
        assert back + r.html[at:] == source and r.html != source
        tree, was = list(scan(r.html)), list(scan(source))
        assert len(tree) == len(was) and [x[2] for x in tree] == [x[2] for x in was]
        plant = plants[r.row, r.defect_class]
        changed = [i for i, (x, y) in enumerate(zip(tree, was)) if (x[4], [(a["name"], a["value"]) for a in x[5]]) != (y[4], [(a["name"], a["value"]) for a in y[5]])]
        assert changed == [plant.node]
    fresh = numbered_pages(mutants.selectExpr("row AS source", "defect_class", "html"))
    asked = fresh.join(receipts.withColumnRenamed("row", "source"), ["source", "defect_class"])
    controls = element_table(fresh).where("tag = 'input'").selectExpr("row", "node AS control")  # for labels, the control that the label named
    first = controls.groupBy("row").agg({"control": "min"}).withColumnRenamed("min(control)", "control")
    asked = asked.join(first, "row", "left").selectExpr("row", "CASE WHEN defect_class = 'label:orphan' THEN control ELSE node END AS node", "defect_class", "source", "p_expected")
    shown = decisions.judged(measure.measurements(element_table(fresh), asked)).collect()
    clean = measure.measurements(elements, receipts.selectExpr("row", "node", "defect_class", "p_expected"))
    before = {(r.row, r.defect_class): r.fires for r in decisions.judged(clean).collect()}
    for r in shown:
        # The skipped level may have no heading before it, and one line of text fits into a taller box.
        if r.defect_class != "heading:skip" and (r.defect_class != "clip:overflow" or severity == "severe"):
            assert r.fires, (r.defect_class, r.source)
        if r.defect_class not in ("label:orphan", "heading:skip"):
            assert not before[r.source, r.defect_class]


def test_a_promoted_heading_skips_a_level(spark):
    pages = pages_of(spark, ["<h1>a</h1><h2>b</h2><p>c</p>"])
    elements = element_table(pages)
    plant = elements.where("tag = 'h2'").selectExpr("row", "node", "'heading:skip' AS defect_class")
    edits = mutate.edits(elements, plant).selectExpr("row", "edit.*")
    row = mutate.applied(pages, edits, ["row"]).first()
    assert row.html == "<h1>a</h1><h4>b</h4><p>c</p>"
    assert [r.skipped for r in measure.heading_skips(element_table(numbered_pages(mutate.applied(pages, edits, ["row"]).drop("row", "undo")))).orderBy("node").collect()] == [False, True]


def plain_groups(edits):
    """The plants that win all their groups; edits are (plant, start, end, rank)."""
    groups, end, last = [], -1, None
    for e in sorted(edits, key=lambda e: (e[1], e[2], e[3], e[0])):
        if groups and (e[1] < end or e[1] == last):
            groups[-1].append(e)
        else:
            groups.append([e])
        end, last = max(end, e[2]), e[1]
    winners = {id(min(g, key=lambda e: (e[3], e[0], e[1]))) for g in groups}
    return {p for p in {e[0] for e in edits} if all(id(e) in winners for e in edits if e[0] == p)}


def test_conflicts_are_settled_by_groups(spark):
    rng = random.Random(4)
    edits = []
    for page in range(40):
        for plant in range(rng.randrange(1, 9)):
            for _ in range(rng.choice([1, 1, 2])):
                start = rng.randrange(60)
                edits.append((page, f"d{plant}", start, start + rng.choice([0, 1, 3, 9]), "t", (plant * 7 + page) % 9))
    edits = [e for i, e in enumerate(edits) if e[:4] not in {x[:4] for x in edits[:i]}]
    got = mutate.without_conflicts(spark.createDataFrame(edits, "row int, defect_class string, start int, end int, text string, rank int"), ["row"], ["defect_class"]).collect()
    for page in range(40):
        assert {r.defect_class for r in got if r.row == page} == plain_groups([(p, s, e, k) for q, p, s, e, _, k in edits if q == page])


def test_defects_planted_together_touch_each_page_once(spark):
    pages = pages_of(spark, ODD)
    mutants, receipts = mutate.mutated_together(pages, element_table(pages))
    sources, rows = {r.row: r.html for r in pages.collect()}, mutants.collect()
    assert len(rows) == len(ODD)
    back = mutate.applied(mutants.select("row", "html"), mutants.selectExpr("row", "explode(undo) AS e").selectExpr("row", "e.*"), ["row"])
    assert {r.row: r.html for r in back.collect()} == sources
    assert receipts.count() == sum(len({(r.row, r.defect_class) for r in receipts.where(f"row = {k}").collect()}) for k in sources)


def test_pages_are_scanned_by_all_tasks(spark):
    source = spark.range(200, numPartitions=1).selectExpr("id AS page_id", "concat('<h1>a</h1><h2>b</h2><p>', id, '</p>') AS html")
    pages = numbered_pages(source)
    elements = element_table(pages)
    mutants, _ = mutate.mutated(pages, elements)
    for rows in (pages, elements, mutants):
        sizes = [n for n in rows.select("row").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert max(sizes) < sum(sizes) / 2, sizes
    assert {r.row for r in pages.collect()} == set(range(200))


def test_mutants_are_not_written(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40_000)]  # each once, so that copies of a page don't pack
    rows = [(i, "u", f"<h1>a</h1><h2>b</h2><ul><li><a href='/'>{i}</a></ul><p>{' '.join(words[i * 2000 : i * 2000 + 2000])}</p>") for i in range(20)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    top = Path(shared_folder(spark).removeprefix("file://"), "evalmill")
    before = set(top.glob("*"))
    got = mutated_pages(spark, str(tmp_path)).collect()
    assert len(got) == 20 * 8 and all(r.restored for r in got)
    sizes = {p.name: sum(f.stat().st_size for f in p.glob("*.parquet")) for p in set(top.glob("*")) - before}
    assert sum(sizes.values()) < 2 * sum(f.stat().st_size for f in (tmp_path / "pages.parquet").glob("*.parquet")), sizes


def test_what_is_shuffled_for_a_written_table_goes_with_it(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks()) if b.isShuffle()}
    before, rows = shuffled(), spark.range(1000).repartition(7, "id")
    counts = written(rows.selectExpr("id % 10 AS k").groupBy("k").count(), "counts")
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled() - before
    assert rows.count() == 1000 and shuffled() - before  # what is not written is left to Spark
    assert counts.agg({"count": "sum"}).first()[0] == 1000


def test_elements_near_a_plant_tell_what_all_do(spark):
    pages = pages_of(spark, [*ODD, "<a style='width:9px;height:9px'>x</a><b>y</b><button>z</button>"]).select("row", "html")
    elements = element_table(pages)
    classes = spark.createDataFrame([(c, i) for i, c in enumerate(decisions.CRITERION)], "defect_class string, k int")
    asked = elements.crossJoin(classes).selectExpr("row", "node", "defect_class", "'center' AS p_expected", "row * 1000000 + node * 1000 + k AS number")
    asked = written(asked, "asked")
    told = ["number", "defect_class", "measured", "fires"]
    whole = decisions.judged(measure.measurements(elements, asked)).select(*told).collect()
    fresh = pages.join(asked, "row").selectExpr("number AS row", "html", "node AS at", "defect_class")
    near = element_table(fresh, text=False, near=(fresh["at"], measure.read_tags(fresh["defect_class"])))
    assert "text" not in near.columns and near.count() < element_table(fresh).count() / 2
    ones = asked.selectExpr("number AS row", "node", "defect_class", "p_expected", "number")
    assert sorted(decisions.judged(measure.measurements(near, ones)).select(*told).collect()) == sorted(whole)
    assert {r.defect_class for r in whole if r.fires} >= {"alt:strip", "label:orphan", "heading:skip", "target:shrink"}
