"""Reading model answers: JSON in free text, labels, boxes, verdicts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import is_refusal, normal_answer, scan_yes_no

FENCED, BRACED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```", r"(?s)\{.*\}"


def _kind(value: Column) -> Column:
    return F.split(F.schema_of_variant(value), "<")[0]


def json_object(text: Column) -> Column:
    """The first JSON object in a text: of the fenced blocks, or else of the widest braces; null if none parses."""
    found = F.concat(F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), F.regexp_extract_all(text, F.lit(BRACED), F.lit(0)))
    return F.try_element_at(F.filter(found, lambda c: F.coalesce(_kind(F.try_parse_json(c)) == "OBJECT", F.lit(False))), F.lit(1))


def scan_ab(text: Column) -> Column:
    """The first A or B that stands as a word."""
    found = F.regexp_extract(text, r"\b(A|B)\b", 1)
    return F.when(found != "", found)


def coerced(answer: Column, level: Column) -> Column:
    """A variant answer as JSON text in the shape that its level wants; null where it has another."""
    text = F.when(_kind(answer) == "STRING", F.regexp_replace(F.try_variant_get(answer, "$", "string"), r"^\s+|\s+$", ""))
    yes_no, side = F.lower(text), F.upper(text)
    items = F.transform(F.try_variant_get(answer, "$", "array<string>"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return (
        F.when(level.isin("L1", "L4"), F.when(yes_no.isin("yes", "no"), yes_no))
        .when(level == "design_pair", F.when(side.isin("A", "B"), side))
        .when(level == "L2", F.when(_kind(answer) == "ARRAY", F.to_json(items)))
        .when(level == "L3", F.when(_kind(answer) == "OBJECT", F.to_json(answer)))
    )


def parse_response(text: Column, level: Column) -> Column:
    """(answer, confidence, refused): the JSON's own answer, a scan of the text at 0.3, or unknown at 0.0.

    Null is an empty text.  A JSON answer without a number as confidence has 0.5.
    """
    text = F.coalesce(text, F.lit(""))
    body = F.try_parse_json(json_object(text))
    answer = coerced(F.try_variant_get(body, "$.answer", "variant"), level)
    number = _kind(F.try_variant_get(body, "$.confidence", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    given = F.when(number, F.try_variant_get(body, "$.confidence", "double"))
    scanned = F.when(level.isin("L1", "L4"), scan_yes_no(text)).when(level == "design_pair", scan_ab(text))
    return F.struct(
        F.coalesce(answer, scanned, F.lit("unknown")).alias("answer"),
        F.when(answer.isNotNull(), F.coalesce(given, F.lit(0.5))).when(scanned.isNotNull(), 0.3).otherwise(0.0).alias("confidence"),
        is_refusal(text).alias("refused"),
    )


def abstains(answer: Column) -> Column:
    return F.coalesce(normal_answer(answer) == "unknown", F.lit(True))


def labels_of(answer: Column) -> Column:
    """The labels of an answer as text: a JSON array's trimmed entries, or the tokens with a colon of free text; sorted, once each."""
    listed = F.from_json(F.when(answer.startswith("["), answer), "array<string>")
    listed = F.filter(F.transform(listed, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    free = F.filter(F.split(F.translate(answer, ",", " "), r"\s+"), lambda x: x.contains(":"))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.coalesce(listed, F.when(~abstains(answer), free), none)))


def labels_ambiguous(answer: Column) -> Column:
    """No list and no label in the text."""
    return ~F.coalesce(answer.startswith("["), F.lit(False)) & (F.size(labels_of(answer)) == 0)


def box_of(answer: Column) -> Column:
    """The four numbers of ``bbox`` in a JSON answer; null where it has none or not four."""
    body = F.try_parse_json(F.when(answer.startswith("{"), answer))
    box = F.try_variant_get(body, "$.bbox", "array<double>")
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()), F.struct(*(box[i].alias(n) for i, n in enumerate("xywh"))))


def selector_of(answer: Column) -> Column:
    """The selector in a JSON answer; null where it is absent or blank."""
    found = F.try_variant_get(F.try_parse_json(F.when(answer.startswith("{"), answer)), "$.selector", "string")
    return F.when(F.trim(found) != "", found)


def same_selector(a: Column, b: Column) -> Column:
    """Selectors alike but for the amount of white space, and for spaces around a combinator."""

    def plain(s: Column) -> Column:
        s = F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))
        return F.regexp_replace(s, " ([>+~]) ", "$1")

    return plain(a) == plain(b)
