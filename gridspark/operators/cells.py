"""Making cells: from arrays, from tables, constant; and back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cells


def from_packed(df: DataFrame, keys: dict[str, str], array: str, axis: str, sizes: tuple[int, ...], value: str = "value") -> Cells:
    """Cells of a table with an array in each row; `keys` names axes after their index columns."""
    out = df.select(*(F.col(c).cast("long").alias(a) for a, c in keys.items()), F.posexplode(array).alias(axis, value)).withColumn(axis, F.col(axis).cast("long"))
    return Cells(out, (*keys, axis), sizes, value)


def to_packed(cells: Cells, axis: str, name: str = "array") -> DataFrame:
    """One row per index of the other axes, the values along `axis` in order; missing cells stay NULL."""
    rest = [a for a in cells.axes if a != axis]
    pairs = F.array_sort(F.collect_list(F.struct(F.col(axis).alias("k"), cells.v.alias("v"))))
    return cells.df.groupBy(*rest).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def linear_index(cells: Cells, axes: tuple[str, ...] | None = None) -> Column:
    """The row-major number of a cell among `axes` (all, if none are named)."""
    out = F.lit(0).cast("long")
    for a in axes if axes is not None else cells.axes:
        out = out * cells.sizes[a] + F.col(a)
    return out


def _div(x: Column, step: int) -> Column:
    """x div step in whole numbers, for x from 0 on."""
    return F.call_function("div", x, F.lit(step)) if step > 1 else x


def unravelled(index: Column, axes: tuple[str, ...], shape: tuple[int, ...]) -> list[Column]:
    """Axis columns of a row-major number."""
    out, step = [], 1
    for a, n in zip(reversed(axes), reversed(shape)):
        out.append((_div(index, step) % n).alias(a))
        step *= n
    return out[::-1]


def full(spark: SparkSession, axes: tuple[str, ...], shape: tuple[int, ...], value: object, dtype: str = "double", units: str | None = None) -> Cells:
    """Constant cells; Spark makes the rows where they are used. empty() is full() of NULL, ones() and zeros() of 1 and 0."""
    n = 1
    for x in shape:
        n *= x
    df = spark.range(n).select(*unravelled(F.col("id"), axes, shape), F.lit(value).cast(dtype).alias("value"))
    return Cells(df, axes, shape, units=units)


def empty(spark: SparkSession, axes: tuple[str, ...], shape: tuple[int, ...], dtype: str = "double") -> Cells:
    return full(spark, axes, shape, None, dtype)


def ones(spark: SparkSession, axes: tuple[str, ...], shape: tuple[int, ...], dtype: str = "double") -> Cells:
    return full(spark, axes, shape, 1, dtype)


def zeros(spark: SparkSession, axes: tuple[str, ...], shape: tuple[int, ...], dtype: str = "double") -> Cells:
    return full(spark, axes, shape, 0, dtype)


def densified(cells: Cells, absent: object = None) -> Cells:
    """A sparse table with a row for every cell; absent ones hold `absent`."""
    spark = cells.df.sparkSession
    grid = full(spark, cells.axes, cells.shape, None).df.drop("value")
    here = cells.df.withColumn("_here", F.lit(True))
    value = F.when(F.col("_here"), cells.v).otherwise(F.lit(absent))
    return replace(cells, df=grid.join(here, list(cells.axes), "left").select(*cells.axes, value.alias(cells.value)))


def ends(cells: Cells) -> DataFrame:
    """first_element, second_element and last_element in row-major order, in one pass. The first and second are the cells there, missing if the table has none; the last is that of the last row."""
    k = linear_index(cells)
    return cells.df.agg(F.max(F.when(k == 0, cells.v)).alias("first_element"), F.max(F.when(k == 1, cells.v)).alias("second_element"), F.max_by(cells.v, k).alias("last_element"))
