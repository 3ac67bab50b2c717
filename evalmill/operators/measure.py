"""What the source of a page tells about its elements, as measurements for the decision rules.

Only what the source itself states is measured: attributes, structure, and the
declarations of ``style`` attributes with their inheritance.  Style sheets and
layout need a browser; what depends on them is not measured, apart from two
lower bounds that are named where they are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.elements import attribute, declared

# Elements that carry text, containers that may protrude, headings, and controls that need a label.
TEXT_TAGS = ("p", "li", "a", "span", "strong", "em", "td", "th", "dd", "dt", "label", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = ("div", "section", "ul", "ol", "table")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
UNLABELLED_TYPES = ("hidden", "submit", "button", "reset", "image")
#: Initial values, and what browsers give headings: size in px at a root of 16 px, bold.
INITIAL = {"color": "rgb(0, 0, 0)", "background": "rgb(255, 255, 255)", "font_size": "16", "font_weight": "400", "text_align": "start"}
HEADING_PX = {"h1": "32", "h2": "24", "h3": "18.72", "h4": "16", "h5": "13.28", "h6": "10.72"}
PAGE_PX, LINE = 1280, 1.2


def _px(value: Column) -> Column:
    """The number of a length in px; null for any other unit."""
    return F.regexp_extract(value, r"^([0-9.]+)px$", 1).try_cast("double")


def own_style() -> dict[str, Column]:
    """What an element sets of each inherited property, by its style attribute or by being a heading or bold; null where it doesn't."""
    tag = F.col("tag")
    size = F.coalesce(_px(declared("font-size")).cast("string"), F.create_map(*(F.lit(x) for p in HEADING_PX.items() for x in p))[tag])
    weight = F.coalesce(declared("font-weight"), F.when(tag.isin(*HEADINGS, "b", "strong", "th"), "700"))
    ground = F.coalesce(declared("background-color"), F.regexp_extract(declared("background"), r"(#[0-9a-f]{3,6}\b|rgba?\([^)]*\))", 1))
    return {
        "color": declared("color"),
        "background": F.when((ground != "transparent") & ~ground.rlike(r"^rgba\(.*,\s*0(\.0*)?\s*\)$") & (ground != ""), ground),
        "font_size": size,
        "font_weight": F.when(weight == "normal", "400").when(weight == "bold", "700").otherwise(weight),
        "text_align": declared("text-align"),
    }


def styled(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` elements (row, node) with the value of each property: of the innermost element around or at them that sets it.

    Setters are joined by their interval; all properties in one join.  One
    aggregate then takes the setter with the largest number for each property.
    """
    own = own_style()
    # One row for each (setter, property): a setter of one property is no candidate for the others.
    pairs = F.array_compact(F.array(*(F.when(value.isNotNull(), F.struct(F.lit(name).alias("property"), value.alias("value"))) for name, value in own.items())))
    setters = elements.select("row", F.col("node").alias("_from"), F.col("last").alias("_to"), F.explode(pairs).alias("p")).select("row", "_from", "_to", "p.*")
    met = asked.select("row", "node").join(setters, "row").where(F.col("node").between(F.col("_from"), F.col("_to")))
    found = met.groupBy("row", "node").agg(*(F.max_by(F.when(F.col("property") == n, F.col("value")), F.when(F.col("property") == n, F.col("_from"))).alias(n) for n in own))
    return asked.join(found, ["row", "node"], "left").fillna(INITIAL)


def labelled_controls(elements: DataFrame) -> DataFrame:
    """(row, node, labelled) of each control that needs a label: one that names its id, one around it, or an aria attribute."""
    kind = F.lower(F.coalesce(attribute("type"), F.lit("")))
    controls = elements.where(F.col("tag").isin("select", "textarea") | ((F.col("tag") == "input") & ~kind.isin(*UNLABELLED_TYPES)))
    controls = controls.select("row", "node", attribute("id").alias("id"), (attribute("aria-label").isNotNull() | attribute("aria-labelledby").isNotNull()).alias("aria"))
    labels = elements.where("tag = 'label'")
    named = labels.select("row", attribute("for").alias("id")).where("id <> ''").distinct().withColumn("named", F.lit(True))
    around = labels.select("row", F.col("node").alias("_from"), F.col("last").alias("_to"))
    inside = controls.join(around, "row").where((F.col("node") > F.col("_from")) & (F.col("node") <= F.col("_to"))).select("row", "node").distinct().withColumn("inside", F.lit(True))
    rows = controls.join(named, ["row", "id"], "left").join(inside, ["row", "node"], "left")
    return rows.select("row", "node", (F.coalesce("named", F.lit(False)) | F.coalesce("inside", F.lit(False)) | F.col("aria")).alias("labelled"))


def heading_skips(elements: DataFrame) -> DataFrame:
    """(row, node, level, skipped) of each heading: whether it is more than one level below the heading before it."""
    order = Window.partitionBy("row").orderBy("node")
    level = F.substring("tag", 2, 1).cast("int")
    rows = elements.where(F.col("tag").isin(*HEADINGS)).select("row", "node", level.alias("level"))
    return rows.withColumn("skipped", F.coalesce(F.col("level") > F.lag("level").over(order) + 1, F.lit(False)))


def candidates(elements: DataFrame) -> DataFrame:
    """(row, node, tag, defect_class): the elements of each page on which a defect of a class can be planted.

    As far as the source tells: an area is taken from declared sizes alone, so
    text elements without one are candidates for clipping and protrusion.
    """
    tag, text = F.col("tag"), F.col("n_text") > 0
    alt, kind = F.trim(F.coalesce(attribute("alt"), F.lit(""))), F.lower(F.coalesce(attribute("type"), F.lit("")))
    wide = F.coalesce(_px(declared("width")), F.lit(80.0)) >= 80
    tall = F.coalesce(_px(declared("width")) * _px(declared("height")), F.lit(24.0 * 60)) >= 24 * 60
    on = {
        "contrast:degrade": tag.isin(*TEXT_TAGS) & text,
        "alt:strip": (tag == "img") & (alt != ""),
        "alt:garble": (tag == "img") & (alt != ""),
        "label:orphan": (tag == "label") & (F.coalesce(attribute("for"), F.lit("")) != ""),
        "heading:skip": tag.isin("h1", "h2", "h3", "h4"),
        "target:shrink": tag.isin("a", "button") | ((tag == "input") & kind.isin("submit", "button", "reset")),
        "clip:overflow": tag.isin(*TEXT_TAGS) & text & tall,
        "protrude:viewport": tag.isin(*TEXT_TAGS, *BLOCK_TAGS) & wide,
        "align:flip": tag.isin("p", "li", "td", "dd", "blockquote") & text,
        "weight:strip": tag.isin(*HEADINGS) & text,
        "size:jitter": tag.isin(*HEADINGS) & text,
    }
    classes = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in on.items())))
    rows = elements.select("row", "node", "tag", F.explode(classes).alias("defect_class"))
    # Detaching a label shows only on a control that is there; planting a heading skip needs a heading before the new level.
    ids = elements.where(F.col("tag").isin("input", "select", "textarea")).select("row", attribute("id").alias("for")).where("`for` is not null").distinct()
    bound = elements.where("tag = 'label'").select("row", "node", attribute("for").alias("for")).join(ids, ["row", "for"], "left_semi").select("row", "node")
    labels = rows.where("defect_class = 'label:orphan'").join(bound, ["row", "node"], "left_semi")
    return rows.where("defect_class <> 'label:orphan'").unionByName(labels)


def _facts(elements: DataFrame) -> DataFrame:
    """Elements with what their own tag states, for the classes that need no other element."""
    return elements.select("row", "node", "tag", "parent", "n_text", attribute("alt").alias("alt"), attribute("alt").isNotNull().alias("has_alt"), _px(declared("width")).alias("width"), _px(declared("height")).alias("height"), declared("overflow").alias("overflow"), _px(declared("margin-left")).alias("margin_left"))


def read_tags(defect_class: Column) -> Column:
    """The tags of the elements that :func:`measurements` reads for a class besides the one in question and those it is in."""
    read = {"heading:skip": HEADINGS, "label:orphan": ("label", "input", "select", "textarea"), "target:shrink": ("a", "button", "input")}
    out = F
    for name, tags in read.items():
        out = out.when(defect_class == name, F.array(*map(F.lit, tags)))
    return out.otherwise(F.array().cast("array<string>"))


def measurements(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """One measurement for each ``asked`` (row, node, defect_class), in the columns that the decision rules read.

    ``node`` is the element in question (for label:orphan the control).  Further
    columns of ``asked`` are kept; those that begin with p_ are parameters of the
    plant, and only ``p_expected`` of the style classes is needed.  An element
    that is not there, or a class that the source can't answer, is not measured.
    Lower bounds: text needs at least the lines that its characters at half a
    font size fill at full page width; the next target is at least its declared
    left margin away.
    """
    own = [c for c in asked.columns if c not in ("row", "node", "defect_class")]
    rows = asked.join(_facts(elements), ["row", "node"], "left")
    rows = styled(elements, rows.withColumn("_there", F.col("tag").isNotNull()))
    skips = heading_skips(elements).groupBy("row").agg(F.count_if("skipped").alias("skips"))
    rows = rows.join(skips, "row", "left").join(labelled_controls(elements), ["row", "node"], "left")
    targets = elements.where(F.col("tag").isin("a", "button", "input")).select("row", "node", _px(declared("margin-left")).alias("gap"))
    gap = targets.select("row", "node", F.coalesce(F.lead("gap").over(Window.partitionBy("row").orderBy("node")), F.lit(0.0)).alias("gap"), F.lead("node").over(Window.partitionBy("row").orderBy("node")).alias("neighbour"))
    rows = rows.join(gap, ["row", "node"], "left")
    is_, size = (lambda *names: F.col("defect_class").isin(*names)), F.col("font_size").cast("double")
    lines = F.ceil(F.col("n_text") * size * 0.5 / PAGE_PX)
    measured = (
        F.when(is_("heading:skip"), F.col("skips").isNotNull())
        .when(is_("label:orphan"), F.col("labelled").isNotNull())
        .when(is_("clip:overflow"), F.col("height").isNotNull() & F.col("overflow").isin("hidden", "clip"))
        .when(is_("target:shrink"), F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("neighbour").isNotNull())
        .when(is_("protrude:viewport"), F.col("width").isNotNull())
        .when(is_("contrast:degrade", "alt:strip", "alt:garble", "align:flip", "weight:strip", "size:jitter"), True)
        .otherwise(False)
    )
    value = F.when(is_("align:flip"), F.col("text_align")).when(is_("weight:strip"), F.col("font_weight")).when(is_("size:jitter"), F.concat(F.regexp_replace("font_size", r"\.0$", ""), F.lit("px")))
    none = lambda kind: F.lit(None).cast(kind)
    columns = {
        "measured": F.col("_there") & measured, "fg": F.col("color"), "bg": F.col("background"), "font_size": size, "font_weight": F.col("font_weight"), "has_alt": F.col("has_alt"), "alt": F.col("alt"),
        "present": F.col("_there"), "labelled": F.col("labelled"), "skips": F.col("skips"), "width": F.col("width"), "height": F.col("height"), "circle_hits": F.col("width") / 2 + F.col("gap") < 12,
        "scroll_height": F.round(lines * size * LINE, 2), "client_height": F.col("height"), "device_width": F.lit(float(PAGE_PX)), "left": F.lit(0.0), "right": F.col("width"), "scroll_width": F.greatest(F.col("width"), F.lit(float(PAGE_PX))),
        "client_width": F.col("width"), "overflow": F.col("overflow"), "value": value,
    }
    absent = {"double": ("intersection", "target_area", "m_right", "m_device_width", "m_scroll_width", "target_right", "target_left", "delta", "p_threshold"), "boolean": ("active", "obscurer", "entirely_hidden", "covered", "p_inline", "p_equivalent", "p_user_agent", "p_essential", "p_author", "p_opened", "p_configurable", "p_reveal"), "string": ("text_overflow", "overflow_x", "p_expected")}
    columns |= {c: none(kind) for kind, names in absent.items() for c in names if c not in own}
    if "p_rectangular" not in own:
        columns["p_rectangular"] = is_("target:shrink")
    return rows.select("row", "node", "defect_class", *own, *(v.alias(k) for k, v in columns.items()))
