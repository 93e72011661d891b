"""Shape algebra: index arithmetic on the axis columns, with sizes kept outside the data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..model import Cells
from .cells import full, linear_index, unravelled


def insert_dimension(cells: Cells, axis: str, position: int = 0) -> Cells:
    axes, shape = list(cells.axes), list(cells.shape)
    axes.insert(position, axis)
    shape.insert(position, 1)
    return replace(cells, df=cells.df.withColumn(axis, F.lit(0).cast("long")), axes=tuple(axes), shape=tuple(shape))


def squeeze(cells: Cells, axes: tuple[str, ...] | None = None) -> Cells:
    gone = tuple(a for a, n in cells.sizes.items() if n == 1) if axes is None else axes
    if any(cells.sizes[a] != 1 for a in gone):
        raise ValueError("only axes of size 1 can go")
    kept = tuple(a for a in cells.axes if a not in gone)
    return replace(cells, df=cells.df.drop(*gone), axes=kept, shape=tuple(cells.sizes[a] for a in kept))


def transpose(cells: Cells, axes: tuple[str, ...] | None = None) -> Cells:
    order = tuple(reversed(cells.axes)) if axes is None else axes
    if sorted(order) != sorted(cells.axes):
        raise ValueError("the new order must name each axis once")
    return replace(cells, df=cells.df.select(*order, cells.value), axes=order, shape=tuple(cells.sizes[a] for a in order))


def flatten(cells: Cells, axes: tuple[str, ...] | None = None, name: str = "flat") -> Cells:
    """Axes run together in row-major order, at the place of the first of them."""
    gone = tuple(a for a in cells.axes if axes is None or a in axes)
    if not gone:
        return cells
    size = 1
    for a in gone:
        size *= cells.sizes[a]
    out, shape = [], []
    for a in cells.axes:
        if a == gone[0]:
            out.append(name)
            shape.append(size)
        elif a not in gone:
            out.append(a)
            shape.append(cells.sizes[a])
    df = cells.df.withColumn("_flat", linear_index(cells, gone)).drop(*gone).withColumnRenamed("_flat", name)
    return replace(cells, df=df.select(*out, cells.value), axes=tuple(out), shape=tuple(shape))


def reshape(cells: Cells, axes: tuple[str, ...], shape: tuple[int, ...]) -> Cells:
    """Row-major relabelling."""
    size = 1
    for n in shape:
        size *= n
    if size != cells.size:
        raise ValueError(f"{cells.shape} has {cells.size} cells, {shape} has {size}")
    return replace(cells, df=cells.df.select(linear_index(cells).alias("_k"), cells.v.alias(cells.value)).select(*unravelled(F.col("_k"), axes, shape), cells.value), axes=axes, shape=shape)


def pad_missing(cells: Cells, axis: str, before: int = 0, after: int = 0, to_size: int | None = None) -> Cells:
    """Missing cells added along an axis; rows are made for the new cells only."""
    n = cells.sizes[axis]
    after = max(0, to_size - n) if to_size is not None else after
    moved = cells.df.withColumn(axis, F.col(axis) + before)
    shape = tuple(m + before + after if a == axis else m for a, m in cells.sizes.items())
    new = full(cells.df.sparkSession, cells.axes, tuple(before + after if a == axis else m for a, m in cells.sizes.items()), None, cells.df.schema[cells.value].dataType.simpleString())
    extra = new.df.withColumn(axis, F.when(F.col(axis) < before, F.col(axis)).otherwise(F.col(axis) + n)).withColumnRenamed("value", cells.value)
    return replace(cells, df=moved.select(*cells.axes, cells.value).unionByName(extra), shape=shape)


def rechunk(cells: Cells, partitions: int, axis: str | None = None) -> Cells:
    """Another layout on the cluster, the same cells."""
    return replace(cells, df=cells.df.repartitionByRange(partitions, axis or cells.axes[0]))
