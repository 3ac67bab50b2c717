"""The region of a page that a target's picture shows, and the size of that picture."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import rounded

# Fixed values, in CSS pixels: the space around a target, the least and largest region by axis, and the largest picture by viewport.
MARGIN = 48.0
LEAST, MOST = {"w": 320.0, "h": 240.0}, {"w": 1024.0, "h": 768.0}
LARGEST = {"desktop": (1024, 768), "mobile": (375, 667)}


def _axis(start: Column, size: Column, local: Column, screen: Column, page: Column, axis: str) -> tuple[Column, Column]:
    """(start, length) of the region along one axis: the target in its middle, within the page."""
    roomy = size + 2 * MARGIN
    wanted = F.when(local, roomy).otherwise(F.least(screen, F.greatest(F.lit(LEAST[axis]), F.least(roomy, F.lit(MOST[axis])))))
    length = F.least(F.greatest(wanted, F.lit(1.0)), page)
    middle = start + size / 2 - length / 2
    at = F.least(F.greatest(middle, F.lit(0.0)), F.greatest(page - length, F.lit(0.0)))
    whole_at = F.least(at, start)  # a box that has to be found is in the picture to its last pixel
    whole = F.least(F.greatest(length, start + size - whole_at), page - whole_at)
    return F.when(local, whole_at).otherwise(at), F.when(local, whole).otherwise(length)


def source_clip(box: Column, local: Column, screen: Column, page: Column) -> Column:
    """The region (x, y, w, h) that shows a target: with a margin, within ``screen`` and ``page`` (w, h); all of it and no less where it is to be located."""
    of = {a: _axis(box[p].cast("double"), box[a].cast("double"), local, screen[a].cast("double"), page[a].cast("double"), a) for p, a in (("x", "w"), ("y", "h"))}
    return F.struct(of["w"][0].alias("x"), of["h"][0].alias("y"), of["w"][1].alias("w"), of["h"][1].alias("h"))


def picture_size(viewport: Column, clip: Column) -> Column:
    """Width and height of the picture of a region: as it is, or made smaller to fit its viewport's largest; null for an unknown viewport."""
    most = F.create_map(*(x for name, (w, h) in LARGEST.items() for x in (F.lit(name), F.struct(F.lit(float(w)).alias("w"), F.lit(float(h)).alias("h")))))
    limit = F.try_element_at(most, viewport)
    scale = F.least(limit["w"] / clip["w"], limit["h"] / clip["h"], F.lit(1.0))
    side = lambda a: F.when(limit.isNotNull(), F.greatest(F.lit(1), rounded(clip[a] * scale, 0).cast("int")))
    return F.struct(side("w").alias("w"), side("h").alias("h"))
