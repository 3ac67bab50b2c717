"""Whether a planted defect shows in what was measured on the page, for all classes.

A measurement is one row for each (page, defect class), with the desktop's fields
as columns (those of the mobile viewport begin with m_, parameters of the plant
with p_) and ``measured``, false where nothing could be measured.  Fields that a
class doesn't use are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import contrast, css_color, relative_luminance

#: The defect classes with their criterion.
CRITERION = {
    "contrast:degrade": "wcag:1.4.3",
    "alt:strip": "wcag:1.1.1",
    "alt:garble": "wcag:1.1.1",
    "label:orphan": "wcag:4.1.2",
    "heading:skip": "wcag:1.3.1",
    "target:shrink": "wcag:2.5.8",
    "focus:obscure": "wcag:2.4.11",
    "chart:label-occlude": "layout:occlusion",
    "overlap:shift": "redecheck:element-collision",
    "clip:overflow": "redecheck:element-protrusion",
    "overflow:page": "layout:page-overflow",
    "truncate:ellipsis": "layout:truncation",
    "protrude:viewport": "redecheck:viewport-protrusion",
    "z:occlude": "layout:occlusion",
    "align:break": "layout:alignment",
    "responsive:fixed-width": "redecheck:small-range",
    "align:flip": "style:text-align",
    "weight:strip": "style:font-weight",
    "size:jitter": "style:font-size",
}
#: Fixed thresholds, in CSS pixels, square pixels, and contrast.
TARGET_PX, OVERLAP_PX2, LABEL_PX2, DELTA_PX, CLIP_PX, EDGE_PX, COVERED, CONTRAST, CONTRAST_LARGE = 24, 200, 1, 8, 2, 1, 0.6, 4.5, 3.0


def large_text(size: Column, weight: Column) -> Column:
    """From 24 px, or from 18.66 px where the weight is bold, bolder or 700 and more."""
    bold = F.coalesce(weight.try_cast("int") >= 700, weight.isin("bold", "bolder"))
    return (size >= 24) | ((size >= 18.66) & bold)


def _past(right: Column, width: Column) -> Column:
    return right > width + EDGE_PX


def rules() -> dict[str, Column]:
    """The condition of each class over the columns of a measurement and its ``_contrast``."""
    c = F.col
    threshold = lambda default: F.coalesce(c("p_threshold"), F.lit(float(default)))
    small = (c("width") < threshold(TARGET_PX)) | (c("height") < threshold(TARGET_PX))
    excepted = reduce(Column.__or__, (F.coalesce(c(f"p_{e}"), F.lit(False)) for e in ("inline", "equivalent", "user_agent", "essential")))
    attested = c("p_author") & ~c("p_opened") & ~c("p_configurable") & ~c("p_reveal")
    alt = F.coalesce("alt", F.lit(""))
    file_like = F.lower(alt).rlike(r"\.(jpg|png|jpeg|gif)$") | alt.contains("_")
    hidden = c("overflow_x").isin("hidden", "clip") | (c("overflow") == "hidden")
    same = c("value") == c("p_expected")
    return {
        "contrast:degrade": c("_contrast") < F.when(large_text(c("font_size"), c("font_weight")), CONTRAST_LARGE).otherwise(CONTRAST),
        "alt:strip": ~c("has_alt"),
        "alt:garble": (alt != "") & file_like,
        "label:orphan": c("present") & ~c("labelled"),
        "heading:skip": c("skips") > 0,
        "target:shrink": small & c("circle_hits") & ~excepted & c("p_rectangular"),
        "focus:obscure": c("active") & c("obscurer") & c("entirely_hidden") & attested,
        "chart:label-occlude": c("covered") & (c("intersection") > threshold(LABEL_PX2)),
        "overlap:shift": c("intersection") > threshold(OVERLAP_PX2),
        "clip:overflow": c("scroll_height") > c("client_height") + CLIP_PX,
        "overflow:page": _past(c("scroll_width"), c("device_width")),
        "truncate:ellipsis": (c("text_overflow") == "ellipsis") & hidden & (c("scroll_width") > c("client_width") + CLIP_PX),
        "protrude:viewport": _past(c("right"), c("device_width")) | (c("left") < -EDGE_PX),
        "z:occlude": c("covered") & (c("intersection") >= COVERED * F.greatest(c("target_area"), F.lit(1.0))),
        "align:break": c("delta") > threshold(DELTA_PX),
        "responsive:fixed-width": _past(c("m_right"), c("m_device_width")) & ~_past(c("right"), c("device_width")),
        "align:flip": same,
        "weight:strip": same,
        "size:jitter": same,
    }


def with_contrast(rows: DataFrame, asked: Column) -> DataFrame:
    """Adds ``_contrast`` of ``fg`` and ``bg`` where ``asked``; null where a colour can't be read.

    Each step is a generator of one row, past which Spark moves no filter: what
    reads the contrast reads a column, and not a copy of the expression.
    """
    colors = F.when(asked, F.struct(css_color(F.col("fg")).alias("fg"), css_color(F.col("bg")).alias("bg")))
    rows = rows.withColumn("_rgb", F.explode(F.array(colors)))
    light = {g: relative_luminance(*(F.col(f"_rgb.{g}.{c}") for c in "rgb")) for g in ("fg", "bg")}
    rows = rows.withColumn("_light", F.explode(F.array(F.struct(*(v.alias(g) for g, v in light.items())))))
    both = F.col("_light.fg").isNotNull() & F.col("_light.bg").isNotNull()
    return rows.withColumn("_contrast", F.when(both, contrast(F.col("_light.fg"), F.col("_light.bg")))).drop("_rgb", "_light")


def judged(measurements: DataFrame) -> DataFrame:
    """Adds ``fires``, whether the row's class shows: never without a measurement, and an error for a class without a rule.

    """
    rows = with_contrast(measurements.withColumn("_asked", F.col("defect_class") == "contrast:degrade"), F.col("_asked"))
    out = F
    for name, rule in rules().items():
        out = out.when(F.col("defect_class") == name, rule)
    known = out.otherwise(F.raise_error(F.concat(F.lit("no rule for defect class "), F.col("defect_class"))).cast("boolean"))
    return rows.withColumn("fires", F.col("measured") & F.coalesce(known, F.lit(False))).drop("_asked", "_contrast")


def criterion_of(defect_class: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in CRITERION.items() for x in pair)), defect_class)


def verified(measurements: DataFrame) -> DataFrame:
    """The planted defects that show."""
    return judged(measurements).where("fires").drop("fires")


def verified_controls(measurements: DataFrame) -> DataFrame:
    """The clean twins on which the class was measured and does not show."""
    return judged(measurements).where(F.col("measured") & ~F.col("fires")).drop("fires")


def criteria_shown() -> Column:
    """The class's own criterion first, then the wider ones that the same measurement supports, once each."""
    c, is_ = F.col, lambda name: F.col("defect_class") == name
    target_out = F.coalesce(_past(c("target_right"), c("device_width")) | (c("target_left") < -EDGE_PX), F.lit(False))
    more = [
        F.when(is_("label:orphan"), "wcag:1.3.1"),
        F.when(is_("overlap:shift"), "layout:occlusion"),
        F.when(c("defect_class").isin("z:occlude", "chart:label-occlude"), "redecheck:element-collision"),
        F.when(is_("truncate:ellipsis"), "redecheck:element-protrusion"),
        F.when(is_("overflow:page") & target_out, "redecheck:viewport-protrusion"),
        F.when(is_("protrude:viewport") & _past(c("scroll_width"), c("device_width")), "layout:page-overflow"),
        F.when(is_("responsive:fixed-width") & _past(c("m_right"), c("m_device_width")), "redecheck:viewport-protrusion"),
        F.when(is_("responsive:fixed-width") & _past(c("m_scroll_width"), c("m_device_width")), "layout:page-overflow"),
    ]
    return F.array_distinct(F.array_compact(F.array(criterion_of(c("defect_class")), *more)))


def edge_out() -> Column:
    """Which edge a target leaves the viewport by; the right one goes first."""
    return F.when(_past(F.col("right"), F.col("device_width")), "right").when(F.col("left") < -EDGE_PX, "left").otherwise("none")


def items_of(shown: DataFrame) -> DataFrame:
    """The items of each planted defect that shows: a page question, the label set where the page is ``controlled``, and the box where there is one."""
    rows = shown.withColumn("criteria", criteria_shown())
    kinds = F.array_compact(F.array(F.lit("L1"), F.when(F.col("controlled"), F.lit("L2")), F.when(F.col("box").isNotNull(), F.lit("L3"))))
    rows = rows.select("page_id", "defect_class", "criteria", "box", F.explode(kinds).alias("level"))
    truth = F.when(F.col("level") == "L1", "no").when(F.col("level") == "L2", F.to_json("criteria")).otherwise(F.to_json("box"))
    number = F.concat_ws(":", "page_id", "defect_class", F.lower("level"))
    return rows.select(number.alias("item_id"), "page_id", "defect_class", "level", F.col("criteria")[0].alias("criterion"), truth.alias("truth"))


def clean_items(controls: DataFrame) -> DataFrame:
    """One page question with the answer yes for each (clean page, criterion); the first class in the order of names gives it."""
    rows = controls.withColumn("criterion", criterion_of(F.col("defect_class")))
    one = rows.groupBy("page_id", "criterion").agg(F.min("defect_class").alias("defect_class"))
    return one.select(F.concat_ws(":", "page_id", "criterion", F.lit("clean")).alias("item_id"), "page_id", "criterion", F.concat("defect_class", F.lit(":clean-control")).alias("defect_class"), F.lit("yes").alias("truth"))
