"""Queries over captures and what they can show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import canonical
from ..operators import coverage as C
from ..operators import decisions as D
from ..operators import instrument as I
from . import bridge as B

_CODES = ["1.4.3", "2.4.11", "1.2.1", "3.2.3", "1.1.1", "2.5.8"]
_LIST = ", ".join(f"'{c}'" for c in _CODES)
_ROWS = "CASE doc_id % 5 WHEN 0 THEN 'L1' WHEN 1 THEN 'L3' WHEN 2 THEN 'L4' WHEN 3 THEN 'L2' ELSE 'design_pair' END AS level, CASE n_chars % 4 WHEN 0 THEN 'a11y' WHEN 1 THEN 'layout' WHEN 2 THEN 'a11y' ELSE 'design' END AS track"
_MOD = "CASE code WHEN '1.4.3' THEN 'static-visual' WHEN '2.5.8' THEN 'static-visual' WHEN '2.4.11' THEN 'single-page-interaction' WHEN '1.2.1' THEN 'timed-media-or-temporal' WHEN '3.2.3' THEN 'multi-page-or-process' ELSE 'static-semantic-or-structural' END"


@register(
    f"""WITH r AS (SELECT doc_id, {_ROWS}, ([{_LIST}])[CAST(doc_id % 6 + 1 AS INTEGER)] AS code, doc_id % 7 = 0 AS gds, CASE WHEN doc_id % 5 IN (1, 2) THEN doc_id % 8 <> 0 ELSE doc_id % 9 <> 0 END AS boxed FROM documents), m AS (SELECT *, {_MOD} AS kind FROM r)
    SELECT doc_id, CASE WHEN level = 'design_pair' THEN 'design pair' WHEN track = 'a11y' AND gds THEN 'no modality' WHEN track = 'a11y' AND kind NOT IN ('static-visual', 'single-page-interaction') THEN 'modality ' || kind
      WHEN track NOT IN ('a11y', 'layout', 'referring') THEN 'track ' || track WHEN NOT boxed THEN 'no box' END AS reason, CASE WHEN boxed THEN doc_id % 5 IN (1, 2) END AS from_anchor FROM m"""
)
def eligibility_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Why a judge of still images can't answer an item, and which box binds it to the page."""
    c = F.col
    d = B.read(spark, sf, "documents").selectExpr(
        "doc_id", *_ROWS.split(", C")[:1], "C" + _ROWS.split(", C")[1], f"CASE WHEN doc_id % 7 = 0 THEN 'gds:' ELSE 'wcag:' END || element_at(array({_LIST}), CAST(doc_id % 6 + 1 AS INT)) AS code",
        "CASE WHEN doc_id % 8 <> 0 THEN array(1D, 1D, 5D, 5D) ELSE array(1D, 1D, 0D, 5D) END AS anchor", "CASE WHEN doc_id % 9 <> 0 AND doc_id % 2 = 0 THEN array(2D, 1D, 5D, 5D) END AS receipt", "CASE WHEN doc_id % 9 <> 0 THEN array(2D, 1D, 5D, 5D) END AS measured",
    )
    box = I.grounding_box(c("level"), c("anchor"), c("receipt"), c("measured"))
    return d.select("doc_id", I.ineligible(c("level"), c("track"), c("code"), box).alias("reason"), (box[0] == 1).alias("from_anchor"))


@register(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'tablet' WHEN doc_id % 6 = 1 THEN 'wide' WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN 'mobile' ELSE 'desktop' END AS viewport FROM documents"""
)
def item_viewports(spark: SparkSession, sf: str) -> DataFrame:
    d = B.read(spark, sf, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 4 = 0 THEN 'tablet' WHEN doc_id % 4 = 1 THEN '' END AS m", "CASE WHEN doc_id % 6 = 1 THEN 'wide' END AS r", "CASE WHEN doc_id % 3 = 0 THEN 'redecheck:small-range' ELSE 'layout:x' END AS code",
        "CASE WHEN doc_id % 2 = 1 THEN array('desktop', 'mobile') ELSE array('desktop') END AS v",
    )
    return d.select("doc_id", I.item_viewport(F.col("m"), F.col("r"), F.col("code"), F.col("v")).alias("viewport"))


_X = "CAST(doc_id % 40 * 5 - 20 AS DOUBLE)"
#: Whether a compared field of a capture differs, in both engines alike.
_OFF = {f: f"(doc_id * 7 + {13 * i}) % 29 = {i}" for i, f in enumerate(I.COMPARED)}
_EARLY = {"has_screenshot": "doc_id % 37 <> 0", "has_metadata": "doc_id % 31 <> 1", "readable": "doc_id % 41 <> 2", "is_object": "doc_id % 43 <> 3"}
_OFF_SQL = ", ".join(f"CASE WHEN {off} THEN '{I.COMPARED[f]}' END" for f, off in _OFF.items())
_EARLY_SQL = " ".join(f"WHEN NOT ({ok}) THEN ['{I.UNREADABLE[f]}']" for f, ok in _EARLY.items())
_AUDIT = f"""c AS (SELECT doc_id, doc_id % 3 = 0 AS l3, {_X} AS x, doc_id % 11 AS src, doc_id % 13 = 0 AS no_scale, doc_id % 19 <> 4 AS sized, CASE WHEN doc_id % 17 = 0 THEN 170 ELSE 180 END AS iw,
      CASE doc_id % 3 WHEN 1 THEN 2.5::DOUBLE ELSE 2.0::DOUBLE END AS sy, CASE doc_id % 3 WHEN 1 THEN 152 ELSE 122 END AS ih FROM documents),
    r AS (SELECT doc_id, CASE {_EARLY_SQL} ELSE list_sort(list_filter([{_OFF_SQL}, CASE WHEN src = 0 THEN 'missing_or_ambiguous_source_html' WHEN src = 1 THEN 'source_html_hash_mismatch' END,
      CASE WHEN no_scale THEN 'invalid_coordinate_transform' END, CASE WHEN NOT no_scale AND sized AND (x + 20 <= 0 OR x >= 150) THEN 'evidence_bbox_outside_rendered_document' END, CASE WHEN NOT no_scale AND NOT (x < 100 AND x + 20 > 10) THEN 'evidence_bbox_not_visible' END,
      CASE WHEN NOT no_scale AND l3 AND NOT (x >= 10 AND x + 20 <= 100) THEN 'localization_gold_not_contained_in_source_crop' END, CASE WHEN NOT no_scale AND l3 AND sized AND (x < 0 OR x + 20 > 150) THEN 'localization_gold_exceeds_rendered_document' END,
      CASE WHEN NOT no_scale AND (iw <> 180 OR round_even(61 * sy, 0) <> ih) THEN 'coordinate_transform_dimensions_mismatch' END], lambda v: v IS NOT NULL)) END AS reasons FROM c)"""


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    box = lambda *v: "named_struct(" + ", ".join(f"'{k}', {x}" for k, x in zip("xywh", v)) + ")"
    evidence = box(_X, "30D", "20D", "10D")
    fields = [f"CASE WHEN {off} THEN 'other' ELSE 'same' END AS {f}" for f, off in _OFF.items() if f != "evidence"] + [f"'same' AS want_{f}" for f in _OFF if f != "evidence"]
    d = B.read(spark, sf, "documents").selectExpr(
        "doc_id", *fields, f"CASE WHEN NOT ({_OFF['evidence']}) THEN {evidence} END AS evidence", f"{evidence} AS want_evidence", *(f"{ok} AS {f}" for f, ok in _EARLY.items()),
        "CASE WHEN doc_id % 3 = 0 THEN 'L3' ELSE 'L1' END AS level", "CASE WHEN doc_id % 11 <> 0 THEN 'h' END AS source_sha256", "CASE WHEN doc_id % 11 = 1 THEN 'g' ELSE 'h' END AS want_source_sha256", f"{box('10D', '0D', '90D', '61D')} AS clip",
        "named_struct('x', CASE WHEN doc_id % 13 = 0 THEN 0D ELSE 2D END, 'y', CASE doc_id % 3 WHEN 1 THEN 2.5D ELSE 2D END) AS scale", "CASE WHEN doc_id % 19 <> 4 THEN named_struct('w', 150D, 'h', 400D) END AS document",
        "named_struct('w', CASE WHEN doc_id % 17 = 0 THEN 170D ELSE 180D END, 'h', CASE doc_id % 3 WHEN 1 THEN 152D ELSE 122D END) AS image",
    )
    return d.select("doc_id", I.audit_reasons().alias("reasons"))


@register(f"WITH {_AUDIT} SELECT doc_id, array_to_string(reasons, ' ') AS reasons FROM r")
def capture_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every reason why a capture is no valid evidence for its item, over all fields, files and geometry."""
    return _audited(spark, sf).select("doc_id", F.concat_ws(" ", "reasons").alias("reasons"))


@register(f"WITH {_AUDIT} SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['valid'] ELSE reasons END) AS reason, count(*) AS captures FROM r GROUP BY 1")
def capture_audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many captures have each reason; the valid ones have passed the gate that fails a run on any reason."""
    rows = _audited(spark, sf)
    valid = I.all_valid(rows.where(F.size("reasons") == 0)).select(F.lit("valid").alias("reason"))
    return rows.select(F.explode("reasons").alias("reason")).union(valid).groupBy("reason").agg(F.count("*").alias("captures"))


@register(
    """SELECT doc_id, substr(sha256('{"bbox":[' || CAST(doc_id % 40 * 2.5::DOUBLE AS VARCHAR) || ',' || CAST((n_chars % 1000) / 8.0::DOUBLE AS VARCHAR) || ',20.0,' || CAST(0.1::DOUBLE AS VARCHAR) || '],"contract":"v2","page_id":' || '"p' || CAST(doc_id AS VARCHAR) || '","render_state":'
      || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"men\\u00fc ' || CAST(doc_id % 5 AS VARCHAR) || '"' END || ',"viewport":"' || CASE WHEN doc_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END || '"}'), 1, 20) AS capture_key FROM documents"""
)
def capture_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The content key of each item's crop, from its canonical JSON."""
    d = B.read(spark, sf, "documents").selectExpr(
        "doc_id", "concat('p', doc_id) AS page_id", "CASE WHEN doc_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS viewport", "CASE WHEN doc_id % 3 <> 0 THEN concat('menü ', doc_id % 5) END AS state",
        "array(doc_id % 40 * 2.5D, (n_chars % 1000) / 8D, 20D, 0.1D) AS box",
    )
    return d.select("doc_id", canonical.capture_key(F.col("page_id"), F.col("viewport"), F.col("state"), F.col("box")).alias("capture_key"))


@register(
    f"""WITH {B.FACT}, c AS (SELECT criterion, judge, count(*) FILTER (truth = predicted) AS ok, count(*) FILTER (answered) AS n FROM fact GROUP BY 1, 2)
    SELECT criterion, judge, sha256('{{"agreement": ' || CASE WHEN n > 0 THEN CAST(CAST(round_even(ok::DECIMAL(38, 18) / n, 4) AS DOUBLE) AS VARCHAR) ELSE 'null' END || ', "criterion": "' || criterion || '", "judge": ' || CAST(judge AS VARCHAR) || ', "n": ' || CAST(n AS VARCHAR) || '}}' || chr(10)) AS digest FROM c"""
)
def prediction_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each row of a report as its file holds it: rates rounded as Python rounds them, keys in order."""
    fact = B.fact(spark, sf).groupBy("criterion", "judge").agg(F.count_if(F.col("truth") == F.col("predicted")).alias("ok"), F.count_if("answered").alias("n"))
    rate = canonical.rounded(F.try_divide(F.col("ok").cast("double"), F.col("n").cast("double")))
    line = canonical.prediction_line({"criterion": (F.col("criterion"), "string"), "judge": (F.col("judge"), "int"), "agreement": (rate, "float"), "n": (F.col("n"), "int")})
    return fact.select("criterion", "judge", F.sha2(F.concat(line, F.lit("\n")), 256).alias("digest"))


@register(
    f"""WITH reg AS (SELECT unnest([{_LIST}]) AS code), e AS (SELECT ([{_LIST}])[CAST(doc_id % 5 + 1 AS INTEGER)] AS code, count(*) AS items FROM documents GROUP BY 1)
    SELECT reg.code AS criterion, {_MOD.replace('CASE code', 'CASE reg.code')} AS modality, CASE WHEN reg.code IN ('1.2.1', '3.2.3') THEN 'not-representable' WHEN reg.code = '1.4.3' AND coalesce(items, 0) > 0 THEN 'covered' WHEN coalesce(items, 0) > 0 THEN 'partially-covered' ELSE 'not-yet-covered' END AS status
    FROM reg LEFT JOIN e ON e.code = reg.code"""
)
def criterion_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered criterion's modality and how far it is covered."""
    registry = spark.createDataFrame([(c,) for c in _CODES], "criterion string")
    e = B.read(spark, sf, "documents").groupBy(F.expr(f"element_at(array({_LIST}), CAST(doc_id % 5 + 1 AS INT))").alias("criterion")).agg(F.count("*").alias("items"))
    rows = registry.join(e, "criterion", "left").withColumns({"items": F.coalesce("items", F.lit(0))})
    first = F.col("criterion") == "1.4.3"
    return I.coverage_status(rows.withColumns({"covered_families": F.when(first & (F.col("items") > 0), 1).otherwise(0), "behavioral": F.lit(True), "limited": ~first}))


@register("SELECT DISTINCT user_id % 50 AS page_id, event_type AS key, CASE WHEN user_id % 50 % 4 = 0 THEN 'b' ELSE 'a' END AS digest FROM events WHERE user_id % 50 % 4 = 0 OR user_id % 50 % 7 = 3")
def stale_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures to be made again: absent, or from other files."""
    e = B.read(spark, sf, "events").selectExpr("user_id % 50 AS page_id", "event_type AS key").distinct()
    wanted = e.withColumn("digest", F.expr("CASE WHEN page_id % 4 = 0 THEN 'b' ELSE 'a' END"))
    return I.stale_captures(wanted, e.where("page_id % 7 <> 3").withColumn("digest", F.lit("a")), ["digest"])


_ALL = C.success_criteria()
_ALL_LIST = ", ".join(f"'{c}'" for c in _ALL)
_FAMILIES = list(D.CRITERION)
_FAMILY_LIST = ", ".join(f"'{c}'" for c in _FAMILIES)
#: An item of each document, in both engines alike; {code} and {family} pick from the lists.
_COVERED = (
    "doc_id % 200 AS page_id", "{code} AS criterion", "CASE doc_id % 7 WHEN 0 THEN 'L2' WHEN 1 THEN 'L3' ELSE 'L1' END AS level", "CASE doc_id % 5 WHEN 0 THEN 'rules' WHEN 1 THEN 'ingested' ELSE 'mutation' END AS door",
    "CASE WHEN doc_id % 2 = 0 THEN 'no' ELSE 'yes' END AS truth", "CASE WHEN doc_id % 5 < 2 THEN NULL WHEN doc_id % 2 = 0 THEN {family} ELSE {family} || ':clean-control' END AS defect_class", "doc_id % 11 <> 0 AS verified",
    "doc_id % 2 = 1 AS control", "doc_id % 13 = 0 AS fires", "n_chars % 3 AS test", "doc_id % 6 <> 1 AS focus_shown",
)


def _picked(code: str, family: str) -> list[str]:
    return [c.format(code=code, family=family) for c in _COVERED]


def _status_sql() -> str:
    kinds = " ".join(f"WHEN criterion IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in I.MODALITIES.items())
    return f"CASE {kinds} ELSE '{I.REST}' END"


@register(
    f"""WITH reg AS (SELECT unnest([{_ALL_LIST}]) AS criterion), i AS (SELECT {", ".join(_picked(f"([{_ALL_LIST}])[CAST(doc_id % 86 % 29 * 3 % 86 + 1 AS INTEGER)]", f"([{_FAMILY_LIST}])[CAST(doc_id % 3 + 1 AS INTEGER)]"))} FROM documents),
    f AS (SELECT criterion, replace(defect_class, ':clean-control', '') AS family, bool_or(level = 'L1' AND truth = 'no' AND verified AND door = 'mutation') AS fails, bool_or(level = 'L1' AND truth = 'yes' AND control AND NOT fires AND door = 'mutation') AS passes,
      bool_or(test = 0) AND bool_or(test = 1) AND bool_or(test = 2) AS tested, bool_or(focus_shown) AS focus FROM i WHERE defect_class IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT criterion, string_agg(family, ' ' ORDER BY family) FILTER (fails AND passes) AS paired, string_agg(family, ' ' ORDER BY family) FILTER (fails AND passes AND tested AND family <> 'alt:garble' AND (criterion <> '2.4.11' OR focus)) AS covered FROM f GROUP BY 1),
    d AS (SELECT criterion, string_agg(door || ':' || CAST(n AS VARCHAR), ' ' ORDER BY door) AS doors FROM (SELECT criterion, door, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT criterion, string_agg(level || ':' || CAST(n AS VARCHAR), ' ' ORDER BY level) AS levels FROM (SELECT criterion, level, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT criterion, count(*) AS items, count(DISTINCT page_id) FILTER (level = 'L1' AND truth = 'no') AS failing_pages, count(DISTINCT page_id) FILTER (level = 'L1' AND truth = 'yes') AS conforming_pages FROM i GROUP BY 1),
    k AS (SELECT reg.criterion, coalesce(items, 0) AS items, coalesce(failing_pages, 0) AS failing_pages, coalesce(conforming_pages, 0) AS conforming_pages, coalesce(doors, '') AS doors, coalesce(levels, '') AS levels, coalesce(paired, '') AS paired_families, coalesce(covered, '') AS families
      FROM reg LEFT JOIN c USING (criterion) LEFT JOIN d USING (criterion) LEFT JOIN l USING (criterion) LEFT JOIN p USING (criterion)), m AS (SELECT *, {_status_sql()} AS modality FROM k)
    SELECT *, CASE WHEN modality IN ('timed-media-or-temporal', 'multi-page-or-process') THEN 'not-representable' WHEN families <> '' AND criterion NOT IN ('1.4.3', '2.5.8') THEN 'covered' WHEN items > 0 THEN 'partially-covered' ELSE 'not-yet-covered' END AS status FROM m"""
)
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    """All 86 success criteria with their evidence, families and status."""
    picked = _picked(f"element_at(array({_ALL_LIST}), CAST(doc_id % 86 % 29 * 3 % 86 + 1 AS INT))", f"element_at(array({_FAMILY_LIST}), CAST(doc_id % 3 + 1 AS INT))")
    items = B.read(spark, sf, "documents").selectExpr(*picked).withColumn("tests", F.array(F.element_at(F.array(*map(F.lit, C.TESTS)), F.col("test").cast("int") + 1)))
    registry = spark.createDataFrame([(c,) for c in _ALL], "criterion string")
    cases = items.where("defect_class is not null").select("criterion", F.regexp_replace("defect_class", C.CONTROL + "$", "").alias("family")).distinct().where("family <> 'alt:garble'")
    cases = cases.withColumn("test", F.explode(F.array(*map(F.lit, C.TESTS))))
    limits = registry.where("criterion in ('1.4.3', '2.5.8')")
    rows = C.coverage_report(registry, items, cases, limits)
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["items"].cast("string"))), " ")
    names = [F.array_join(c, " ").alias(c) for c in ("paired_families", "families")]
    return rows.select("criterion", "items", "failing_pages", "conforming_pages", told("doors").alias("doors"), told("levels").alias("levels"), *names, "modality", "status")
