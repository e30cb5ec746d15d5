"""Column functions over boxes: structs or columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a["x1"] - a["x0"]) * F.greatest(F.lit(0.0), a["y1"] - a["y0"])


def intersection(a: Column, b: Column) -> Column:
    return _overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * _overlap(a["y0"], a["y1"], b["y0"], b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that don't meet or have no area."""
    shared = intersection(a, b)
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The part of the smaller box that the other covers."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(F.lit(0.0))


def axis_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The overlap of two spans as a part of the shorter one."""
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, _overlap(a0, a1, b0, b1) / short).otherwise(F.lit(0.0))


def relation(line: Column, box: Column, overlap: float = 0.25) -> Column:
    """struct(distance, side): where a line stands to a box it is aligned with, or null.

    The side is overlapping, above, below, left or right; the distance is between the edges.
    """
    dx = F.greatest(F.lit(0.0), box["x0"] - line["x1"], line["x0"] - box["x1"])
    dy = F.greatest(F.lit(0.0), box["y0"] - line["y1"], line["y0"] - box["y1"])
    across = axis_overlap(line["x0"], line["x1"], box["x0"], box["x1"])
    along = axis_overlap(line["y0"], line["y1"], box["y0"], box["y1"])
    side = (
        F.when((dx == 0) & (dy == 0), "overlapping")
        .when((across >= overlap) & (line["y1"] <= box["y0"]), "above")
        .when((across >= overlap) & (line["y0"] >= box["y1"]), "below")
        .when((along >= overlap) & (line["x1"] <= box["x0"]), "left")
        .when((along >= overlap) & (line["x0"] >= box["x1"]), "right")
    )
    return F.when(side.isNotNull(), F.struct(F.hypot(dx, dy).alias("distance"), side.alias("side")))


def visible_ratio(box: Column, width: Column, height: Column) -> Column:
    """The part of a box that lies inside an image."""
    shown = _overlap(box["x0"], box["x1"], F.lit(0.0), width) * _overlap(box["y0"], box["y1"], F.lit(0.0), height)
    return F.when(area(box) > 0, shown / area(box)).otherwise(F.lit(0.0))


def geometry_score(box: Column, image_area: Column) -> Column:
    """How large and how square a box is, from 0 to 1."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    square = F.least(w, h) / F.nullif(F.greatest(w, h), F.lit(0.0))
    return F.coalesce(F.least(area(box) / F.nullif(image_area, F.lit(0.0)) / 0.12, F.lit(1.0)) * F.pow(square, 2.4), F.lit(0.0))
