"""Queries over joins, sets, sequences and rollups, on tables projected from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import text as T
from ..operators import crops, scoring
from ..operators import relations as R
from . import bridge as B


def _sql(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table, written so that both engines read them alike."""
    return B.read(spark, sf, table).selectExpr(*columns)


_PAGE = "'p' || CAST(doc_id % 97 AS STRING) AS page_id"


@register("""SELECT item, d.page_id, coalesce(r.answer, 'unknown') AS answer FROM (SELECT doc_id AS item, 'p' || CAST(doc_id % 97 AS VARCHAR) AS page_id FROM documents) d
  LEFT JOIN (SELECT 'p' || CAST(n_nationkey * 3 AS VARCHAR) AS page_id, CASE WHEN n_regionkey < 2 THEN 'no' ELSE 'yes' END AS answer FROM nation) r ON r.page_id = d.page_id""")
def items_by_page_report(spark: SparkSession, sf: str) -> DataFrame:
    report = _sql(spark, sf, "nation", "'p' || CAST(n_nationkey * 3 AS STRING) AS page_id", "CASE WHEN n_regionkey < 2 THEN 'no' ELSE 'yes' END AS said")
    return R.by_page(_sql(spark, sf, "documents", "doc_id AS item", _PAGE), report, "said")


_REGISTRY = "SELECT CAST(unnest(['wcag111', 'wcag143', 'wcag412']) AS VARCHAR) AS tag, CAST(unnest(['1.1.1', '1.4.3', '4.1.2']) AS VARCHAR) AS criterion"


@register(f"""SELECT DISTINCT id, r.criterion FROM (SELECT event_id AS id, unnest([CASE WHEN event_id % 2 = 0 THEN 'wcag111' ELSE 'best' END, CASE WHEN event_id % 3 = 0 THEN 'wcag143' ELSE 'wcag111' END]) AS tag FROM events) e JOIN ({_REGISTRY}) r ON r.tag = e.tag""")
def criteria_of_tags(spark: SparkSession, sf: str) -> DataFrame:
    registry = spark.createDataFrame([("wcag111", "1.1.1"), ("wcag143", "1.4.3"), ("wcag412", "4.1.2")], "tag string, criterion string")
    e = _sql(spark, sf, "events", "event_id AS id", "array(CASE WHEN event_id % 2 = 0 THEN 'wcag111' ELSE 'best' END, CASE WHEN event_id % 3 = 0 THEN 'wcag143' ELSE 'wcag111' END) AS tags")
    return R.tagged(e, "tags", registry)


@register("""WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, 'p' || CAST(doc_id % 97 AS VARCHAR) AS page_id, CASE doc_id % 3 WHEN 0 THEN 'overlap' WHEN 1 THEN 'clip' END AS cls FROM documents),
  f AS (SELECT DISTINCT 'p' || CAST(event_id % 50 AS VARCHAR) AS page_id, CASE WHEN event_id % 4 = 0 THEN 'overlap' ELSE 'other' END AS cls FROM events)
  SELECT item_id, CASE WHEN f.page_id IS NOT NULL THEN 'no' ELSE 'yes' END AS answer FROM i LEFT JOIN f ON f.page_id = i.page_id AND f.cls = i.cls WHERE i.cls IS NOT NULL""")
def layout_findings(spark: SparkSession, sf: str) -> DataFrame:
    items = _sql(spark, sf, "documents", "CAST(doc_id AS STRING) AS item_id", _PAGE, "doc_id % 3 AS criterion")
    findings = _sql(spark, sf, "events", "'p' || CAST(event_id % 50 AS STRING) AS page_id", "CASE WHEN event_id % 4 = 0 THEN 'overlap' ELSE 'other' END AS defect_class")
    return R.findings_of(items, spark.createDataFrame([(0, "overlap"), (1, "clip")], "criterion long, defect_class string"), findings)


@register("""WITH r AS (SELECT event_id AS ord, user_id AS page_id, event_id % 3 = 0 AS l1, 'r' || CAST(event_id AS VARCHAR) AS receipt FROM events WHERE event_id % 5 <> 0)
  SELECT page_id, CASE WHEN bool_or(l1) THEN arg_max(receipt, ord) FILTER (l1) ELSE arg_min(receipt, ord) END AS receipt FROM r GROUP BY 1""")
def mutation_receipts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sql(spark, sf, "events", "event_id AS ord", "user_id AS page_id", "CASE WHEN event_id % 3 = 0 THEN 'L1' ELSE 'L3' END AS level", "CASE WHEN event_id % 5 = 0 THEN 'rules' ELSE 'mutation' END AS door", "'r' || CAST(event_id AS STRING) AS receipt")
    return R.mutation_receipts(rows)


@register("""WITH l AS (SELECT list(doc_id ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS ids, doc_id // 500 AS artifact FROM documents GROUP BY 2),
  a AS (SELECT artifact, unnest(range(len(ids))) AS place, unnest(ids) AS id FROM l) SELECT a.artifact, a.place, d.doc_id AS item_id, d.lang FROM a JOIN documents d ON d.doc_id = a.id""")
def items_in_artifact_order(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, in the order in which the list of their artifact, of up to 500, names them."""
    docs = _sql(spark, sf, "documents", "doc_id AS item_id", "lang")
    named = F.struct(F.md5(F.col("item_id").cast("string")).alias("h"), F.col("item_id").alias("id"))
    lists = docs.groupBy(F.expr("item_id div 500").alias("artifact")).agg(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["id"]).alias("ids"))
    return R.in_artifact_order(lists, "ids", docs, ["artifact"]).select("artifact", F.col("place").cast("long").alias("place"), "item_id", "lang")


@register("""WITH t AS (SELECT o_custkey % 7 AS rater, o_orderkey % 40 AS pair_id, o_orderkey % 3 AS dimension, o_orderkey AS place FROM orders),
  d AS (SELECT DISTINCT user_id % 7 AS rater, event_id % 40 AS pair_id, event_id % 3 AS dimension FROM events WHERE user_id % 3 = 0)
  SELECT rater, arg_min(pair_id, place) AS pair_id, arg_min(dimension, place) AS dimension FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.rater = t.rater AND d.pair_id = t.pair_id AND d.dimension = t.dimension) GROUP BY 1""")
def next_trials(spark: SparkSession, sf: str) -> DataFrame:
    trials = _sql(spark, sf, "orders", "o_custkey % 7 AS rater", "o_orderkey % 40 AS pair_id", "o_orderkey % 3 AS dimension", "o_orderkey AS place")
    done = _sql(spark, sf, "events", "event_id", "user_id % 7 AS rater", "event_id % 40 AS pair_id", "event_id % 3 AS dimension").where("user_id % 3 = 0")
    return R.next_trial(trials, done)


_BOXES = "CAST(l_partkey % 60 AS DOUBLE) AS ax, CAST(l_suppkey % 50 AS DOUBLE) AS ay, CAST(l_linenumber * 4 AS DOUBLE) AS aw, CAST(l_quantity AS DOUBLE) AS ah"


@register(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_BOXES} FROM lineitem)
  SELECT l_orderkey, l_linenumber, ax < 50 AND ax + aw > 10 AND ay < 40 AND ay + ah > 5 AS overlaps, ax >= 10 AND ay >= 5 AND ax + aw <= 50 AND ay + ah <= 40 AS inside,
    greatest(0, least(ax + aw, 45) - least(ax, 45)) AS w, greatest(0, least(ay + ah, 30) - least(ay, 30)) AS h FROM b""")
def boxes_and_viewports(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap with a crop, containment in it, and the size held to a page of 45 by 30."""
    b = B.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(c.strip() for c in _BOXES.split(", ")))
    b = b.select("l_orderkey", "l_linenumber", F.struct(*(F.col(f"a{k}").alias(k) for k in "xywh")).alias("a"), F.expr("named_struct('x', 10D, 'y', 5D, 'w', 40D, 'h', 35D)").alias("b"))
    c = R.clipped("a", F.lit(45.0), F.lit(30.0))
    return b.select("l_orderkey", "l_linenumber", R.overlaps("a", "b").alias("overlaps"), R.inside("a", "b").alias("inside"), c["w"].alias("w"), c["h"].alias("h"))


def _clip_sql(at: str, size: str, screen: float, page: float, low: float, high: float, axis: str) -> str:
    length = f"least(greatest(CASE WHEN local THEN {size} + 96 ELSE least({screen}, greatest({low}, least({size} + 96, {high}))) END, 1), {page})"
    place = f"least(greatest({at} + {size} / 2 - ({length}) / 2, 0), greatest({page} - ({length}), 0))"
    return f"CASE WHEN local THEN least({place}, {at}) ELSE {place} END AS c{axis}, CASE WHEN local THEN least(greatest({length}, {at} + {size} - least({place}, {at})), {page} - least({place}, {at})) ELSE {length} END AS l{axis}"


_TARGET = "CAST(l_partkey * 7 % 1300 AS DOUBLE) AS bx, CAST(l_suppkey * 31 % 2400 AS DOUBLE) AS \"by\", CAST(l_linenumber * 170 + l_partkey % 9 AS DOUBLE) AS bw, CAST(l_quantity * 23 AS DOUBLE) AS bh, l_orderkey % 3 = 0 AS local"


@register(
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_TARGET} FROM lineitem),
    c AS (SELECT *, {_clip_sql("bx", "bw", 1280, 1290, 320, 1024, "x")}, {_clip_sql('"by"', "bh", 800, 2500, 240, 768, "y")} FROM b),
    s AS (SELECT *, least(1024 / lx, 768 / ly, 1.0::DOUBLE) AS scale FROM c)
    SELECT l_orderkey, l_linenumber, cx AS x, cy AS y, lx AS w, ly AS h, greatest(1, CAST(round_even(lx * scale, 0) AS INT)) AS width, greatest(1, CAST(round_even(ly * scale, 0) AS INT)) AS height FROM s"""
)
def source_clips(spark: SparkSession, sf: str) -> DataFrame:
    """The region that shows each target, and the size of its picture."""
    b = B.read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *(c.strip().replace('"', "`") for c in _TARGET.split(", ")))
    box = F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bw").alias("w"), F.col("bh").alias("h"))
    size = lambda w, h: F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h"))
    rows = b.withColumn("c", crops.source_clip(box, F.col("local"), size(1280, 800), size(1290, 2500)))
    rows = rows.withColumn("p", crops.picture_size(F.lit("desktop"), F.col("c")))
    return rows.select("l_orderkey", "l_linenumber", "c.*", F.col("p.w").alias("width"), F.col("p.h").alias("height"))


_ATTEMPTS = "r AS (SELECT judge, CASE WHEN item_id % 19 = 0 THEN item_id + 1000000000 ELSE item_id END AS item_id FROM results)"


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    return B.results(spark, sf).select("judge", F.expr("CASE WHEN item_id % 19 = 0 THEN item_id + 1000000000 ELSE item_id END").alias("item_id"))


@register(
    f"""WITH {B.FACT}, {_ATTEMPTS}, a AS (SELECT judge, item_id, count(*) AS n FROM r GROUP BY 1, 2), g AS (SELECT gold.item_id, criterion, j.judge FROM gold, (SELECT DISTINCT judge FROM r) j)
    SELECT g.judge, g.criterion, count(*) AS expected, count(n) AS matched, count(*) - count(n) AS missing, coalesce(sum(n - 1), 0)::BIGINT AS duplicates, CAST(count(n) AS DOUBLE) / count(*) AS match_rate
    FROM g LEFT JOIN a ON a.judge = g.judge AND a.item_id = g.item_id GROUP BY 1, 2"""
)
def join_contract(spark: SparkSession, sf: str) -> DataFrame:
    """How many items of each judge and criterion are matched, missing, and answered more than once."""
    return scoring.join_contract(B.gold(spark, sf), _attempts(spark, sf), ["criterion"])


@register(
    f"""WITH {B.FACT}, {_ATTEMPTS}, u AS (SELECT judge, item_id, count(*) AS n FROM r WHERE item_id NOT IN (SELECT item_id FROM gold) GROUP BY 1, 2)
    SELECT judge, count(*) AS keys, sum(n)::BIGINT AS attempts, array_to_string(list_sort(list(item_id))[1:5], ' ') AS examples FROM u GROUP BY 1"""
)
def unknown_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The results whose key no item has, by judge, with the first of them."""
    return scoring.unknown_keys(B.gold(spark, sf), _attempts(spark, sf)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), " "))


@register("""WITH c AS (SELECT p_size % 4 AS variant, p_partkey % 3 AS model, count(*) AS n FROM part WHERE (p_size % 4) * 3 + p_partkey % 3 <> 5 GROUP BY 1, 2)
  SELECT v.variant, m.model, c.n FROM (SELECT DISTINCT p_size % 4 AS variant FROM part) v CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS model FROM part) m LEFT JOIN c ON c.variant = v.variant AND c.model = m.model""")
def ablation_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = _sql(spark, sf, "part", "p_size % 4 AS variant", "p_partkey % 3 AS model")
    return R.cell_grid(p, p, p.where("variant * 3 + model <> 5").groupBy("variant", "model").agg(F.count("*").alias("n")))


@register("""SELECT DISTINCT r AS family FROM (SELECT unnest(range(12))::BIGINT AS r) WHERE r IN (SELECT event_id % 15 FROM events WHERE event_type = 'purchase') AND r IN (SELECT user_id % 9 FROM events)""")
def covered_families(spark: SparkSession, sf: str) -> DataFrame:
    failed = B.read(spark, sf, "events").where("event_type = 'purchase'").selectExpr("event_id % 15 AS family")
    return R.covered_families(failed, _sql(spark, sf, "events", "user_id % 9 AS family"), spark.range(12).withColumnRenamed("id", "family"))


_VIEWPORTS = "CASE WHEN p_partkey % 3 = 0 THEN {l}'desktop'{r} WHEN p_partkey % 3 = 1 THEN {l}'desktop', 'mobile'{r} ELSE {l}'mobile', 'tablet'{r} END"


@register(f"""WITH p AS (SELECT p_partkey AS id, p_brand, p_size, p_type, {_VIEWPORTS.format(l='[', r=']')} AS v FROM part)
  SELECT a.id AS a, b.id AS b, unnest(list_intersect(a.v, b.v)) AS viewport FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id < b.id""")
def pairs_by_viewport(spark: SparkSession, sf: str) -> DataFrame:
    pages = _sql(spark, sf, "part", "p_brand AS bucket", "p_size AS `group`", "p_partkey AS page_id", f"{_VIEWPORTS.format(l='array(', r=')')} AS viewports")
    return R.pairs_by_viewport(pages)


@register("SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def unexpected_ids(spark: SparkSession, sf: str) -> DataFrame:
    return R.unexpected(_sql(spark, sf, "events", "user_id AS id"), _sql(spark, sf, "documents", "doc_id AS id").where("id % 2 = 0"), "id")


@register("SELECT conv_id, list_sort(list_distinct(list(role)))::VARCHAR = '[assistant, user]' OR len(list_distinct(list(role))) = 1 AND any_value(role) IN ('user', 'assistant') AS known, (list_distinct(list(role ORDER BY turn)))[1] IS NOT NULL AS has_roles FROM conversations GROUP BY 1")
def known_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a conversation's roles are a subset of the known ones."""
    c = B.read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    c = c.withColumn("allowed", F.array(F.lit("user"), F.lit("assistant")))
    return c.select("conv_id", R.is_subset("roles", "allowed").alias("known"), (F.size("roles") > 0).alias("has_roles"))


@register("SELECT user_id, event_type, min(event_id) AS ord FROM events GROUP BY 1, 2")
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_wins(_sql(spark, sf, "events", "user_id", "event_type", "event_id AS ord"), ["user_id", "event_type"], "ord")


@register("""WITH RECURSIVE t AS (SELECT l_orderkey AS k, l_linenumber AS id, l_linenumber % 3 = 0 AS c, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 = 0 ORDER BY l_linenumber, l_partkey, l_suppkey) AS turn FROM lineitem),
  s AS (SELECT k, count(*) FILTER (NOT c) AS p, count(*) FILTER (c) AS n FROM t GROUP BY 1),
  e AS (SELECT t.*, p, n, greatest(1, p // (n + 1)) AS every FROM t JOIN s ON s.k = t.k)
  SELECT k, turn, c AS is_catch, CASE WHEN c THEN least(turn * every, p) + turn ELSE turn + least(n, (turn - 1) // every) END AS place FROM e""")
def catch_interleave(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("k", "is_catch").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    rows = _sql(spark, sf, "lineitem", "l_orderkey AS k", "l_linenumber", "l_partkey", "l_suppkey", "l_linenumber % 3 = 0 AS is_catch").withColumn("turn", turn)
    return R.interleaved_catches(rows.select("k", "turn", "is_catch"), ["k"])


@register("SELECT s AS seed, j AS place, (['a', 'b', 'c', 'd', 'e'])[CAST((s * 3 + j) % 5 + 1 AS INTEGER)] AS defect_class FROM (SELECT doc_id AS s FROM documents), (SELECT unnest(range(3))::INTEGER AS j)")
def classes_in_turn(spark: SparkSession, sf: str) -> DataFrame:
    return R.classes_in_turn(_sql(spark, sf, "documents", "doc_id AS seed"), "seed", list("abcde"), 3)


@register("SELECT doc_id, n::INTEGER AS number, w AS value FROM (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS w FROM (SELECT doc_id, [lang, source, CAST(n_chars AS VARCHAR)] AS x FROM documents)) WHERE w <> 'en'")
def numbered_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    d = _sql(spark, sf, "documents", "doc_id", "array(lang, source, CAST(n_chars AS STRING)) AS x")
    return R.numbered(d, "x", lambda v: v != "en").select("doc_id", "number", "value")


@register("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY count(*) DESC, min(p_partkey) LIMIT 12")
def commonest_types(spark: SparkSession, sf: str) -> DataFrame:
    return R.commonest(_sql(spark, sf, "part", "p_type", "p_partkey"), "p_type", "p_partkey", 12)


@register("SELECT user_id, max(value) AS value, arg_min(event_id, (-value, event_id)) AS event_id FROM events GROUP BY 1")
def largest_finding(spark: SparkSession, sf: str) -> DataFrame:
    return R.largest_finding(_sql(spark, sf, "events", "user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@register("SELECT lang, list_sort(list(doc_id))[:25]::VARCHAR AS examples FROM documents GROUP BY 1")
def first_examples(spark: SparkSession, sf: str) -> DataFrame:
    got = R.first_examples(_sql(spark, sf, "documents", "lang", "doc_id"), ["lang"], "doc_id", 25)
    return got.select("lang", F.concat(F.lit("["), F.concat_ws(", ", F.transform("examples", lambda x: x.cast("string"))), F.lit("]")).alias("examples"))


_FAILS = "[CASE WHEN n_chars % 3 = 0 THEN 'page_id_mismatch' END, CASE WHEN n_chars % 5 = 0 THEN 'evidence_bbox_not_visible' END, CASE WHEN n_chars % 7 = 0 THEN 'localization_gold_not_contained_in_source_crop' END]"
_AUDIT = f"a AS (SELECT doc_id, lang AS level, list_filter({_FAILS}, lambda x: x IS NOT NULL) AS reasons FROM documents)"
_GEOMETRY = ["evidence_bbox_not_visible", "localization_gold_not_contained_in_source_crop"]


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, "documents", "doc_id", "lang AS level", f"array_compact(array({_FAILS[1:-1]})) AS reasons")


@register(f"""WITH {_AUDIT} SELECT level, 'audited' AS kind, count(*) AS n FROM a GROUP BY 1 UNION ALL SELECT level, 'valid', count(*) FILTER (len(reasons) = 0) FROM a GROUP BY 1 UNION ALL SELECT level, 'invalid', count(*) FILTER (len(reasons) > 0) FROM a GROUP BY 1
  UNION ALL SELECT level, reason, count(*) FROM (SELECT level, unnest(reasons) AS reason FROM a) GROUP BY 1, 2""")
def instrument_audit(spark: SparkSession, sf: str) -> DataFrame:
    return R.instrument_audit(_audited(spark, sf))


@register(f"""WITH {_AUDIT}, e AS (SELECT doc_id, reasons, doc_id % 6 <> 0 AS ok FROM a) SELECT CASE WHEN NOT ok THEN 'not eligible' WHEN len(reasons) = 0 THEN NULL
  WHEN NOT list_contains(reasons, 'page_id_mismatch') AND list_contains(reasons, 'evidence_bbox_not_visible') THEN 'outside the screenshot' ELSE 'invalid instrument' END AS reason, count(*) AS n FROM e GROUP BY 1""")
def exclusion_histogram(spark: SparkSession, sf: str) -> DataFrame:
    why = R.exclusion(F.col("doc_id") % 6 != 0, F.lit("not eligible"), "reasons", _GEOMETRY, _GEOMETRY[:1])
    return _audited(spark, sf).groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@register("SELECT user_id % 50 AS page_id, event_type AS key, bool_or(event_id % 9 = 0) AS localises, list_sort(list_distinct(list(event_id)))::VARCHAR AS ids FROM events GROUP BY 1, 2")
def capture_specs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sql(spark, sf, "events", "user_id % 50 AS page_id", "event_type AS key", "CASE WHEN event_id % 9 = 0 THEN 'L3' ELSE 'L1' END AS level", "event_id AS item_id")
    ids = F.concat(F.lit("["), F.concat_ws(", ", F.transform("item_ids", lambda x: x.cast("string"))), F.lit("]"))
    return R.capture_specs(rows).select("page_id", "key", "localises", ids.alias("ids"))


@register("""WITH a AS (SELECT user_id AS page_id, count(*) AS n, sum(event_id % 10) AS d FROM events WHERE event_id % 3 <> 0 GROUP BY 1), b AS (SELECT user_id AS page_id, count(*) AS n, sum(event_id % 10) AS d FROM events WHERE event_id % 3 <> 0 OR event_id % 21 = 0 GROUP BY 1)
  SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.n = b.n AND a.d = b.d, false) AS stable FROM a FULL JOIN b ON a.page_id = b.page_id""")
def capture_stability(spark: SparkSession, sf: str) -> DataFrame:
    e = _sql(spark, sf, "events", "user_id AS page_id", "event_id")
    sums = lambda df: df.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("event_id") % 10).alias("d"))
    return R.stability(sums(e.where("event_id % 3 <> 0")), sums(e.where("event_id % 3 <> 0 OR event_id % 21 = 0")), ["n", "d"])


@register("""SELECT conv_id, count(*) AS boxes, md5(string_agg(CAST(turn AS VARCHAR) || ',' || CAST(length(text) AS VARCHAR) || ',' || CAST(length(role) AS VARCHAR) || ',7', ';' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def box_digests(spark: SparkSession, sf: str) -> DataFrame:
    return R.box_digest(_sql(spark, sf, "conversations", "conv_id", "turn", "turn AS x", "length(text) AS y", "length(role) AS w", "7 AS h"), ["conv_id"], "turn")


_RUNS = "user_id % 4 AS judge, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'yes' END AS answer, CASE WHEN event_id % 7 = 0 THEN 'boom' END AS error, event_id % 6 = 0 AS refused, event_id % 11 = 0 AS truncated, " \
    "CASE WHEN user_id % 4 <> 1 OR event_id % 14 <> 3 THEN CAST(event_id % 900 + 1 AS DOUBLE) END AS prompt, CAST(CASE WHEN user_id % 4 = 2 AND event_id % 50 = 0 THEN -1 ELSE event_id % 70 END AS DOUBLE) AS completion"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return B.read(spark, sf, "events").selectExpr(*_RUNS.split(", "))


@register(f"WITH r AS (SELECT {_RUNS} FROM events) SELECT judge, count(*) AS calls, count(*) FILTER (answer <> 'unknown' AND error IS NULL)::DOUBLE / count(*) AS parse_rate, count(*) FILTER (refused) AS refusals, count(*) FILTER (truncated) AS truncated FROM r GROUP BY 1")
def run_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_diagnostics(_runs(spark, sf))


@register(f"""WITH r AS (SELECT {_RUNS} FROM events), s AS (SELECT judge, count(*) AS calls, bool_and(coalesce(prompt > 0 AND completion >= 0, false)) AS complete, avg(prompt) AS p, avg(completion) AS c FROM r GROUP BY 1)
  SELECT judge, calls, complete, round(CASE WHEN complete THEN p ELSE 0 END, 6) AS mean_prompt, round(CASE WHEN complete THEN c ELSE 0 END, 6) AS mean_completion FROM s""")
def smoke_usage(spark: SparkSession, sf: str) -> DataFrame:
    return R.smoke_usage(_runs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_prompt", "mean_completion")})


@register(f"""WITH r AS (SELECT {_RUNS} FROM events) SELECT judge, round(CASE WHEN NOT bool_or(prompt IS NULL OR completion IS NULL) FILTER (error IS NULL) THEN (sum(prompt) FILTER (error IS NULL) / 1e6 * 0.5 + sum(completion) FILTER (error IS NULL) / 1e6 * 3) * 0.5 END, 9) AS usd FROM r GROUP BY 1""")
def actual_cost(spark: SparkSession, sf: str) -> DataFrame:
    return R.actual_cost(_runs(spark, sf), 0.5, 3.0, 0.5).withColumn("usd", F.round("usd", 9))


@register("SELECT CASE WHEN p LIKE 'p1%' THEN 'synth' WHEN p LIKE 'p2%' THEN 'real' WHEN p LIKE 'p%' THEN 'page' ELSE 'other' END AS source, count(DISTINCT p) AS pages, count(*) AS items FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE 'p' END || CAST(doc_id AS VARCHAR) AS p FROM documents) GROUP BY 1")
def pages_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = _sql(spark, sf, "documents", "CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE 'p' END || CAST(doc_id AS STRING) AS page_id")
    rows = d.withColumn("source", R.source_of(F.col("page_id"), [("p1", "synth"), ("p2", "real"), ("p", "page")]))
    return rows.groupBy("source").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("items"))


@register("SELECT lang AS track, list_sort(list_distinct(list(source)))::VARCHAR AS labels, list(doc_id ORDER BY doc_id)[:5]::VARCHAR AS boxes FROM documents GROUP BY 1")
def random_pools(spark: SparkSession, sf: str) -> DataFrame:
    """What a random judge may draw from: each track's labels in order, and its first boxes."""
    show = lambda c: F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))
    d = _sql(spark, sf, "documents", "lang AS track", "source", "doc_id")
    labels = d.groupBy("track").agg(F.array_sort(F.collect_set("source")).alias("l"))
    boxes = R.first_examples(d, ["track"], "doc_id", 5)
    return labels.join(boxes, "track").select("track", show("l").alias("labels"), show("examples").alias("boxes"))


_WORDS = "'Wcag: ' || CAST(doc_id AS {s}) || ' /' || lang || '..' AS t, CASE doc_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN ' END ' ELSE 'center' END AS al, CASE doc_id % 4 WHEN 0 THEN '700' WHEN 1 THEN '650' WHEN 2 THEN 'bold' ELSE 'x' END AS wt, " \
    "'a{{background: url(x' || CAST(doc_id AS {s}) || '.png)}} b{{c: url(data:1)}}' AS css, 'wcag:1.' || CAST(doc_id % 5 AS {s}) || '.' || CAST(doc_id % 13 AS {s}) AS code, 'f' || CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.css?v=1' ELSE '.bin' END AS path"


@register(f"""WITH w AS (SELECT doc_id, n_chars, {_WORDS.format(s='VARCHAR')} FROM documents)
  SELECT doc_id, regexp_replace(regexp_replace(t, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS slug, CASE lower(trim(al)) WHEN 'start' THEN 'left' WHEN 'end' THEN 'right' ELSE lower(trim(al)) END AS align,
    CASE WHEN wt IN ('700', 'bold') THEN 'bold' ELSE 'normal' END AS weight, replace(css, 'url(x' || CAST(doc_id AS VARCHAR) || '.png)', 'none') AS css, 'wcag' || replace(split_part(code, ':', 2), '.', '') AS tag,
    CASE WHEN CAST('0x' || substr(sha256(t), 1, 2) AS BIGINT) % 2 = 0 THEN 'A' ELSE 'B' END AS side, CASE WHEN path LIKE '%.PNG' THEN 'image/png' WHEN path LIKE '%.css%' THEN 'text/css' ELSE 'application/octet-stream' END AS mime,
    'data:text/css;base64,' || base64(encode(code)) AS uri, substr(sha256('["' || code || '","' || CAST(n_chars AS VARCHAR) || '"]'), 1, 20) AS key, 'Is ' || code || ' met in ' || lang2 || '?' AS prompt,
    n_chars % 100 <= greatest(64, greatest(n_chars, 1) * 0.05::DOUBLE) AS confined FROM (SELECT w.*, d.lang AS lang2 FROM w JOIN documents d USING (doc_id))""")
def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    w = B.read(spark, sf, "documents").selectExpr("doc_id", "n_chars", "lang", *_WORDS.format(s="STRING").split(", "))
    c = F.col
    return w.select(
        "doc_id", T.slug(c("t")).alias("slug"), T.alignment(c("al")).alias("align"), T.weight_label(c("wt")).alias("weight"), T.without_css_urls(c("css")).alias("css"), T.axe_tag(c("code")).alias("tag"),
        T.pseudo_truth(c("t")).alias("side"), T.mime_of(c("path")).alias("mime"), T.data_uri(F.encode("code", "UTF-8"), F.lit("text/css")).alias("uri"), T.capture_key([c("code"), c("n_chars")]).alias("key"),
        T.filled(F.lit("Is {code} met in {lang}?"), {"code": c("code"), "lang": c("lang")}).alias("prompt"), T.confined(c("n_chars"), c("n_chars") % 100).alias("confined"),
    )


@register("""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct([doc_id % 12, (doc_id * 7) % 12]), lambda x: x)), lambda x: '1.4.' || CAST(x AS VARCHAR)), ' ') AS criteria, '1.4.' || CAST(doc_id % 12 AS VARCHAR) AS listed,
  CASE WHEN doc_id % 3 = 0 THEN 'A' WHEN doc_id % 3 = 1 THEN 'B' END AS side FROM documents""")
def criterion_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Requirement keys to success criteria in the order of versions, the first of a list written as text, and coded sides."""
    a, b = "CAST(doc_id % 12 AS STRING)", "CAST((doc_id * 7) % 12 AS STRING)"
    d = _sql(spark, sf, "documents", "doc_id", f"array('wcag20:1.4.' || {a}, 'aria:x', 'wcag21:1.4.' || {b}, 'wcag-technique:G1') AS keys", f"\"['1.4.\" || {a} || \" Contrast', '2.1.1 Keyboard']\" AS listed", "CASE doc_id % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' ELSE 'cannot_tell' END AS choice")
    return d.select("doc_id", F.concat_ws(" ", T.primary_criteria(F.col("keys"))).alias("criteria"), T.first_listed(F.col("listed")).alias("listed"), T.coded_side(F.col("choice"), F.lit("m1")).alias("side"))


_SIZES = "CAST(p_size * 97 + 120 AS DOUBLE) AS w, CAST(p_partkey % 61 * 55 + 90 AS DOUBLE) AS h"


@register(f"""WITH s AS (SELECT p_partkey, {_SIZES} FROM part), f AS (SELECT *, least(1.0::DOUBLE, 2048.0::DOUBLE / greatest(w, h)) AS k FROM s), g AS (SELECT *, least(1.0::DOUBLE, 768.0::DOUBLE / least(w * k, h * k)) AS q FROM f)
  SELECT p_partkey, (85 + 170 * ceil(w * k * q / 512) * ceil(h * k * q / 512))::BIGINT AS tiles, CASE WHEN w <= 384 AND h <= 384 THEN 258 ELSE 258 * ceil(w / floor(least(w, h) / 1.5::DOUBLE)) * ceil(h / floor(least(w, h) / 1.5::DOUBLE)) END::BIGINT AS crops,
    least(ceil(w / 28) * ceil(h / 28), 1568)::BIGINT AS patches, (ceil(w / 32) * ceil(h / 32))::BIGINT AS wide_patches FROM g""")
def token_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Image tokens by the four formulas, for sizes beyond every limit in them."""
    from ..operators.derive import tile_tokens

    s = B.read(spark, sf, "part").selectExpr("p_partkey", *_SIZES.split(", "))
    w, h = F.col("w"), F.col("h")
    return s.select("p_partkey", tile_tokens(w, h).alias("tiles"), T.tiles_by_crop(w, h).alias("crops"), T.patch_tokens(w, h, 28, 1568).alias("patches"), T.patch_tokens(w, h, 32).alias("wide_patches"))


@register("""SELECT doc_id, doc_id % 6 NOT IN (0, 1, 2, 3) AS usable FROM documents""")
def usable_boxes(spark: SparkSession, sf: str) -> DataFrame:
    odd = "CASE doc_id % 6 WHEN 0 THEN array(1D, 2D, 3D) WHEN 1 THEN array(1D, 2D, double('NaN'), 4D) WHEN 2 THEN array(1D, 2D, 0D, 4D) WHEN 3 THEN array(double('Infinity'), 1D, 2D, 3D) ELSE array(0D, 0D, 1D, 2D) END AS box"
    return _sql(spark, sf, "documents", "doc_id", odd).select("doc_id", R.usable_box(F.col("box")).alias("usable"))


@register(f"""WITH r AS (SELECT {_RUNS} FROM events) SELECT judge, count(*) AS runs, CASE WHEN NOT coalesce(bool_or(prompt IS NULL OR prompt <= 0) FILTER (error IS NULL), false) THEN sum(prompt) FILTER (error IS NULL) END AS tokens FROM r GROUP BY 1""")
def batch_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt tokens of a batch, null as soon as one run without an error has none."""
    from ..operators.derive import usage_or_null

    return usage_or_null(_runs(spark, sf).withColumn("tokens", F.col("prompt")), "judge", "error")
