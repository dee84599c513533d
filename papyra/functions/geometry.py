"""Boxes (x0, y0, x1, y1) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its corners in order."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def clamped(b: Column, width: float, height: float) -> Column:
    """The part of a box that lies on a page."""
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v))
    return F.struct(inside(b["x0"], width).alias("x0"), inside(b["y0"], height).alias("y0"), inside(b["x1"], width).alias("x1"), inside(b["y1"], height).alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0)) * F.greatest(b["y1"] - b["y0"], F.lit(0))


def common(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def share(a: Column, b: Column) -> Column:
    """What share of a lies in b; 0 for an empty a."""
    return F.when(area(a) > 0, common(a, b) / area(a)).otherwise(0.0)
