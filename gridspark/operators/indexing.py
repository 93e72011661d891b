"""Sub-spaces and assignment: an index for each axis, applied independently of the others."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Cells, Field
from .masking import where

Index = int | slice | list | tuple | type(Ellipsis)


def parsed(indices: object, shape: tuple[int, ...]) -> list[range | list[int]]:
    """One range or list of positions per axis. Whole numbers keep their axis, with size 1; an ellipsis stands for all axes left; lists may be of positions or of as many booleans as the axis is long."""
    given = list(indices) if isinstance(indices, tuple) else [indices]
    if any(x is Ellipsis for x in given):
        k = next(k for k, x in enumerate(given) if x is Ellipsis)
        given[k : k + 1] = [slice(None)] * (len(shape) - len(given) + 1)
    given += [slice(None)] * (len(shape) - len(given))
    if len(given) > len(shape):
        raise IndexError(f"{len(given)} indices for {len(shape)} axes")
    out: list[range | list[int]] = []
    for x, n in zip(given, shape):
        if isinstance(x, slice):
            out.append(range(*x.indices(n)))
            continue
        if isinstance(x, int) and not isinstance(x, bool):
            x = [x]
        x = list(x)
        if x and all(isinstance(k, bool) for k in x):
            if len(x) != n:
                raise IndexError(f"{len(x)} booleans for an axis of size {n}")
            x = [k for k, yes in enumerate(x) if yes]
        if any(not -n <= k < n for k in x):
            raise IndexError(f"{x} is outside an axis of size {n}")
        out.append([k % n for k in x])
    return out


def new_index(column: Column, chosen: range | list[int]) -> tuple[Column, Column]:
    """(whether a position is chosen, its new position). Ranges are arithmetic; lists of up to a thousand become a lookup in the plan."""
    if isinstance(chosen, range):
        if not len(chosen):
            return F.lit(False), column
        step, low, high = chosen.step, min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1])
        inside = (column >= low) & (column <= high)
        if abs(step) > 1:
            inside = inside & ((column - chosen[0]) % abs(step) == 0)
        return inside, F.call_function("div", column - chosen[0], F.lit(step)) if step != 1 else column - chosen[0]
    table = F.create_map(*(F.lit(x).cast("long") for k, old in enumerate(chosen) for x in (old, k))) if chosen else None
    return column.isin(chosen) if chosen else F.lit(False), F.element_at(table, column.cast("long")) if chosen else column


def subspace(cells: Cells, indices: object) -> Cells:
    """cells[indices]. Ranges and short lists without repeats are a filter on the axis columns, which reaches the scan; others join a table of (old, new) positions."""
    df, shape = cells.df, []
    for axis, chosen, n in zip(cells.axes, parsed(indices, cells.shape), cells.shape):
        shape.append(len(chosen))
        if chosen == range(n):
            continue
        if isinstance(chosen, list) and (len(chosen) > 1000 or len(set(chosen)) < len(chosen)):
            pairs = df.sparkSession.createDataFrame(list(zip(chosen, range(len(chosen)))), f"{axis} long, _new long")
            df = df.join(pairs, axis).drop(axis).withColumnRenamed("_new", axis)
        else:
            keep, place = new_index(F.col(axis), chosen)
            df = df.where(keep).withColumn(axis, place)
    return replace(cells, df=df.select(*cells.axes, cells.value), shape=tuple(shape))


def reverse_bounds(bounds: DataFrame, column: str = "bounds") -> DataFrame:
    """The corners of each cell in the other direction, as reversing an axis asks for."""
    return bounds.withColumn(column, F.reverse(column))


def assign(cells: Cells, indices: object, value: Column | Cells | float | None) -> Cells:
    """cells[indices] = value: one value, an expression of the row, or cells of the sub-space's shape (axes of size 1 are repeated). None masks. A hard mask keeps missing cells missing."""
    chosen = parsed(indices, cells.shape)
    inside, places = F.lit(True), {}
    for axis, x, n in zip(cells.axes, chosen, cells.shape):
        keep, place = (F.lit(True), F.col(axis)) if x == range(n) else new_index(F.col(axis), x)
        inside, places[axis] = inside & keep, place
    df = cells.df
    if isinstance(value, Cells):
        on = [a for a in value.axes if value.sizes[a] > 1]
        source = value.df.select(*(F.col(a).alias(f"_{a}") for a in on), value.v.alias("_new"))
        df = df.select("*", *(F.when(inside, places[a]).alias(f"_{a}") for a in on), inside.alias("_in"))
        df = df.join(source, [f"_{a}" for a in on], "left") if on else df.crossJoin(F.broadcast(source))  # without such axes there is one value
        inside, new = F.col("_in"), F.col("_new")
    else:
        new = value if isinstance(value, Column) else F.lit(value)
    out = F.when(inside, new).otherwise(cells.v)
    if cells.hardmask:
        out = F.when(cells.v.isNotNull(), out)
    return replace(cells, df=df.select(*cells.axes, out.alias(cells.value)))


def subspace_field(field: Field, indices: object) -> Field:
    """Data and every construct that spans a changed axis, cut alike. Bounds of reversed one-dimensional constructs are reversed."""
    chosen = dict(zip(field.data.axes, parsed(indices, field.data.shape)))
    constructs = []
    for c in field.constructs:
        if c.type == "domain_axis" and c.key in chosen:
            c = replace(c, size=len(chosen[c.key]))
        elif c.data is not None and c.axes:
            own = tuple(chosen.get(a, range(c.data.sizes[a])) for a in c.axes)
            bounds = c.bounds
            if bounds is not None and len(c.axes) == 1 and isinstance(own[0], range):
                keep, place = new_index(F.col(c.axes[0]), own[0])
                bounds = bounds.where(keep).withColumn(c.axes[0], place)
                bounds = reverse_bounds(bounds) if own[0].step < 0 else bounds
            c = replace(c, data=subspace(c.data, tuple(slice(x.start, x.stop if x.stop >= 0 else None, x.step) if isinstance(x, range) else x for x in own)), bounds=bounds)
        constructs.append(c)
    return replace(field, data=subspace(field.data, indices), constructs=tuple(constructs))


def indices(field: Field, **wanted: list) -> tuple[list[int] | slice, ...]:
    """Positions at which one-dimensional constructs have one of the values wanted; other axes stay whole. An axis can be asked for once, and something must match."""
    out: dict[str, list[int]] = {}
    for name, values in wanted.items():
        c = field.construct(name)
        if c.data is None or len(c.axes) != 1:
            raise ValueError(f"{name!r} is not one-dimensional")
        if c.axes[0] in out:
            raise ValueError(f"axis {c.axes[0]} is asked for twice")
        values = values if isinstance(values, (list, tuple)) else [values]
        hits = c.data.df.where(c.data.v.isin(list(values))).select(c.axes[0]).orderBy(c.axes[0]).collect()  # positions of one coordinate
        if not hits:
            raise IndexError(f"nothing matches {name}")
        out[c.axes[0]] = [r[0] for r in hits]
    return tuple(out.get(a, slice(None)) for a in field.data.axes)


def subspace_where(cells: Cells, axis: str, coordinate: Cells, values: list) -> DataFrame:
    """The same lazily, for large coordinates: a left-semi join on the axis. Old positions are kept."""
    return cells.df.join(coordinate.df.where(coordinate.v.isin(values)).select(F.col(coordinate.axes[0]).alias(axis)), axis, "left_semi")


__all__ = ["assign", "indices", "parsed", "reverse_bounds", "subspace", "subspace_field", "subspace_where", "where"]
