"""Whether two arrays are equal within a tolerance, and where they are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Cells
from .reduce import allclose

EPSILON = 2.220446049250313e-16


def aligned(a: Cells, b: Cells) -> DataFrame:
    """(axes, x, y, in_x, in_y): both arrays, cell by cell."""
    left = a.df.select(*a.axes, a.v.alias("x"), F.lit(True).alias("in_x"))
    right = b.df.select(*(F.col(q).alias(p) for p, q in zip(a.axes, b.axes)), b.v.alias("y"), F.lit(True).alias("in_y"))
    return left.join(right, list(a.axes), "full_outer")


def summary(a: Cells, b: Cells, rtol: float = EPSILON, atol: float = EPSILON) -> DataFrame:
    """One row: cells, masks_equal, close; one shuffle of both sides and partial sums after."""
    both = aligned(a, b)
    return both.agg(
        F.count("*").alias("cells"),
        F.coalesce(F.bool_and(F.col("x").isNull() == F.col("y").isNull()), F.lit(True)).alias("masks_equal"),
        allclose(both, "x", "y", rtol, atol).alias("close"),
    )


def equal(a: Cells, b: Cells, rtol: float = EPSILON, atol: float = EPSILON, ignore_type: bool = False, ignore_fill: bool = True) -> bool:
    """Shape, fill value, type and units first, which need no job; then all values."""
    kind = lambda c: c.df.schema[c.value].dataType.simpleString()
    if a.shape != b.shape or a.units != b.units or a.calendar != b.calendar or not ignore_fill and a.fill != b.fill or not ignore_type and kind(a) != kind(b):
        return False
    r = summary(a, b, rtol, atol).first()
    return bool(r["masks_equal"] and r["close"])


def differing(a: Cells, b: Cells, rtol: float = EPSILON, atol: float = EPSILON) -> DataFrame:
    """(axes, x, y) of the cells that are not equal."""
    both = aligned(a, b)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    same = x.isNull() & y.isNull() | F.coalesce(F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y), F.lit(False)) & ~F.isnan(x) & ~F.isnan(y)
    return both.where(~same).select(*a.axes, "x", "y")
