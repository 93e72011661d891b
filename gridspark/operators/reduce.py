"""Reductions over axes. Missing cells are left out; if all are missing, so is the result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Cells


def smallest(x: Column) -> Column:
    """NaN if there is one, as in arrays; Spark's own min would pass it over."""
    nan = F.max(F.isnan(x.cast("double")) & x.isNotNull())
    return F.when(F.coalesce(nan, F.lit(False)), F.lit(float("nan"))).otherwise(F.min(x))


def expression(how: str, x: Column, kind: str) -> Column:
    real = kind in ("float", "double")
    if how == "max":
        return F.max(x)
    if how == "min":
        return smallest(x).cast(kind) if real else F.min(x)
    if how == "sum":
        return F.sum(x).cast(kind) if real else F.sum(x.cast("long"))
    if how == "any":
        return F.bool_or(x.cast("boolean"))
    if how == "all":
        return F.bool_and(x.cast("boolean"))
    raise ValueError(how)


def collapse(cells: Cells, how: str, axes: tuple[str, ...] | None = None, squeeze: bool = False) -> Cells:
    """max, min, sum, any or all over `axes` (all of them, if none are named). Reduced axes keep size 1 unless squeezed. Partial results are made in each task before the shuffle."""
    gone = cells.axes if axes is None else axes
    kept = [a for a in cells.axes if a not in gone]
    out = expression(how, cells.v, cells.df.schema[cells.value].dataType.simpleString()).alias(cells.value)
    df = cells.df.groupBy(*kept).agg(out) if kept else cells.df.agg(out)
    names = tuple(a for a in cells.axes if not squeeze or a not in gone)
    df = df.select(*(F.lit(0).cast("long").alias(a) if a in gone else F.col(a) for a in names), cells.value)
    return replace(cells, df=df, axes=names, shape=tuple(1 if a in gone else cells.sizes[a] for a in names), units=None if how in ("any", "all") else cells.units)


def unique(cells: Cells) -> DataFrame:
    """The distinct values in order, one missing value last if there is any."""
    return cells.df.select(cells.value).distinct().orderBy(F.asc_nulls_last(cells.value))


def allclose(df: DataFrame, x: str, y: str, rtol: float, atol: float, masked_equal: bool = True) -> Column:
    """Whether all pairs are close: |x - y| <= atol + rtol * |y|; missing beside a number is not, NaN beside NaN is not."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    close = F.when(a.isNull() & b.isNull(), F.lit(masked_equal)).when(a.isNull() | b.isNull(), F.lit(False)).otherwise((a == b) & ~F.isnan(a) | both & ~F.isnan(a) & ~F.isnan(b))
    return F.coalesce(F.bool_and(close), F.lit(True))


def trailing_count(cells: Cells, axis: str) -> DataFrame:
    """How many elements of each row count, up to the last that is not missing: the count variable of a ragged array."""
    kept = [a for a in cells.axes if a != axis]
    return cells.df.groupBy(*kept).agg(F.coalesce(F.max(F.when(cells.v.isNotNull(), F.col(axis) + 1)), F.lit(0).cast("long")).alias("count"))
