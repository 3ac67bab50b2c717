"""Which items a screenshot can show, and whether a capture is what it says it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import rounded
from .relations import inside, overlaps, usable_box

#: What evidence a success criterion needs; any other is static-semantic-or-structural.
MODALITIES = {
    "timed-media-or-temporal": ["1.2.1", "1.2.2", "1.2.3", "1.2.4", "1.2.5", "1.2.6", "1.2.7", "1.2.8", "1.2.9", "1.4.2", "1.4.7", "2.2.1", "2.2.2", "2.2.3", "2.2.4", "2.2.5", "2.2.6", "2.3.1", "2.3.2", "2.3.3"],
    "multi-page-or-process": ["2.4.5", "3.2.3", "3.2.4", "3.2.6", "3.3.7"],
    "single-page-interaction": ["2.4.11", "2.4.12", "2.4.13", "2.5.1", "2.5.2", "2.5.7", "3.3.8", "3.3.9"],
    "static-visual": ["1.4.1", "1.4.3", "1.4.4", "1.4.6", "1.4.10", "1.4.11", "1.4.12", "1.4.13", "2.4.7", "2.5.5", "2.5.8"],
}
REST = "static-semantic-or-structural"


def modality(code: Column) -> Column:
    """The kind of evidence that a success criterion, as a dotted number, needs."""
    out = F
    for name, codes in MODALITIES.items():
        out = out.when(code.isin(*codes), name)
    return out.otherwise(REST)


def ineligible(level: Column, track: Column, criterion: Column, box: Column) -> Column:
    """Why a judge of still images can't answer an item; null if it can.  The first reason counts."""
    kind = modality(F.split_part(criterion, F.lit(":"), F.lit(2)))
    return (
        F.when(level == "design_pair", "design pair")
        .when((track == "a11y") & ~criterion.startswith("wcag:"), "no modality")
        .when((track == "a11y") & ~kind.isin("static-visual", "single-page-interaction"), F.concat(F.lit("modality "), kind))
        .when(~track.isin("a11y", "layout", "referring"), F.concat(F.lit("track "), track))
        .when(~usable_box(box), "no box")
    )


def grounding_box(level: Column, anchor_box: Column, receipt_box: Column, measured_box: Column) -> Column:
    """The measured box of an item: its anchor's at levels that have one, else its receipt's; null if not usable."""
    box = F.when(level.isin("L3", "L4"), anchor_box).otherwise(F.coalesce(receipt_box, measured_box))
    return F.when(usable_box(box), box)


def item_viewport(metadata: Column, receipt: Column, criterion: Column, viewports: Column) -> Column:
    """The viewport that an item is shown in: as it says, or mobile for small ranges measured there, or desktop."""
    said = F.coalesce(F.when(metadata != "", metadata), F.when(receipt != "", receipt))
    small = (criterion == "redecheck:small-range") & F.coalesce(F.array_contains(viewports, "mobile"), F.lit(False))
    return F.coalesce(said, F.when(small, "mobile"), F.lit("desktop"))


def same_as(field: str) -> Column:
    """Whether a capture's field is what its item wants (column want_<field>), null being a value."""
    return F.col(field).eqNullSafe(F.col(f"want_{field}"))


#: The fields that a capture's description has to match, and the reason where one doesn't.
COMPARED = {
    "schema_version": "capture_schema_mismatch",
    "contract": "screenshot_contract_mismatch",
    "capture_key": "capture_key_mismatch",
    "page_id": "page_id_mismatch",
    "viewport": "viewport_name_mismatch",
    "viewport_size": "viewport_dimensions_mismatch",
    "mode": "capture_mode_mismatch",
    "scale_kind": "screenshot_scale_not_css",
    "render_state": "render_state_mismatch",
    "evidence": "evidence_bbox_mismatch",
    "image_size": "screenshot_dimensions_mismatch",
    "image_sha256": "screenshot_hash_mismatch",
}


#: Why a capture can't be read at all, in the order in which it is tried.
UNREADABLE = {"has_screenshot": "missing_screenshot", "has_metadata": "missing_capture_metadata", "readable": "invalid_capture_bundle", "is_object": "invalid_capture_metadata"}


def audit_reasons(fields: list[str] | None = None) -> Column:
    """Sorted reasons why a capture is no valid evidence: of what is there, of the compared ``fields``, and of its geometry.

    The columns of UNREADABLE tell whether the files are there and hold what they
    should; the first that is false is the only reason.  Each compared field (all
    by default) has a column of its own and one that begins with want_.  Boxes
    are structs want_evidence, clip (x, y, w, h), document (w, h) and scale (x, y);
    ``image`` (w, h) is the size of the file itself.  source_sha256 is null where
    the page's source is not there or not the only one.  Sizes are rounded by
    their exact value, halves to even.
    """
    c = F.col
    bad = [F.when(~same_as(f), COMPARED[f]) for f in (list(COMPARED) if fields is None else fields)]
    bad.append(F.when(c("source_sha256").isNull(), "missing_or_ambiguous_source_html").when(~same_as("source_sha256"), "source_html_hash_mismatch"))
    there = [c(f"clip.{f}").isNotNull() for f in "xywh"] + [c("scale.x") > 0, c("scale.y") > 0]
    known = F.coalesce(reduce(Column.__and__, there), F.lit(False))
    bad.append(F.when(~known, "invalid_coordinate_transform"))
    e, d = "want_evidence", "document"
    right, bottom = c(f"{e}.x") + c(f"{e}.w"), c(f"{e}.y") + c(f"{e}.h")
    outside = (right <= 0) | (bottom <= 0) | (c(f"{e}.x") >= c(f"{d}.w")) | (c(f"{e}.y") >= c(f"{d}.h"))
    beyond = (c(f"{e}.x") < 0) | (c(f"{e}.y") < 0) | (right > c(f"{d}.w")) | (bottom > c(f"{d}.h"))
    sized = c(f"{d}.w").isNotNull() & c(f"{d}.h").isNotNull()
    size = (rounded(c("clip.w") * c("scale.x"), 0) != c("image.w")) | (rounded(c("clip.h") * c("scale.y"), 0) != c("image.h"))
    local = c("level") == "L3"
    bad += [
        F.when(known & sized & outside, "evidence_bbox_outside_rendered_document"),
        F.when(known & ~overlaps(e, "clip"), "evidence_bbox_not_visible"),
        F.when(known & local & ~inside(e, "clip"), "localization_gold_not_contained_in_source_crop"),
        F.when(known & local & sized & beyond, "localization_gold_exceeds_rendered_document"),
        F.when(known & size, "coordinate_transform_dimensions_mismatch"),
    ]
    reasons = F
    for column, reason in UNREADABLE.items():
        reasons = reasons.when(~F.coalesce(c(column), F.lit(False)), F.array(F.lit(reason)))
    return reasons.otherwise(F.array_sort(F.array_distinct(F.array_compact(F.array(*bad)))))


def all_valid(audited: DataFrame) -> DataFrame:
    """``audited``, or an error when the query runs if a row has a reason."""
    ok = F.when(F.size("reasons") == 0, True).otherwise(F.raise_error(F.concat(F.lit("invalid instrument: "), F.concat_ws(", ", "reasons"))).cast("boolean"))
    return audited.where(ok)


def stale_captures(wanted: DataFrame, captures: DataFrame, digests: list[str]) -> DataFrame:
    """Wanted captures (page_id, key, digests) that are not there or were made from other files."""
    return wanted.join(captures.select("page_id", "key", *digests), ["page_id", "key", *digests], "left_anti")


def coverage_status(rows: DataFrame) -> DataFrame:
    """(criterion, status) of every registered criterion from its evidence.

    ``rows`` has criterion (a dotted number), items, covered_families, behavioral
    (whether all behaviour tests are there) and limited (whether a known limit stands).
    """
    kind = modality(F.col("criterion"))
    full = (F.col("covered_families") > 0) & F.col("behavioral") & ~F.col("limited")
    status = F.when(kind.isin("timed-media-or-temporal", "multi-page-or-process"), "not-representable").when(full, "covered").when(F.col("items") > 0, "partially-covered").otherwise("not-yet-covered")
    return rows.select("criterion", kind.alias("modality"), F.coalesce(status, F.lit("not-yet-covered")).alias("status"))
