"""Concatenation and de-duplication."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import converted
from ..model import Cells, Construct, Field


def concatenate(arrays: list[Cells], axis: str, relaxed_units: bool = False) -> Cells:
    """Arrays end to end along an axis they all have. Equivalent units are converted to the first's; others fail, unless relaxed and absent."""
    first = arrays[0]
    out, at = None, 0
    for a in arrays:
        if [n for x, n in a.sizes.items() if x != axis] != [n for x, n in first.sizes.items() if x != axis] or a.axes != first.axes:
            raise ValueError(f"{a.sizes} does not fit {first.sizes} along {axis}")
        v = a.v
        if a.units != first.units:
            if not (relaxed_units and (a.units is None or first.units is None)):
                v = converted(v, a.units, first.units)
        part = a.df.select(*((F.col(x) + at).alias(x) if x == axis else F.col(x) for x in a.axes), v.alias(first.value))
        out = part if out is None else out.unionByName(part)
        at += a.sizes[axis]
    return replace(first, df=out, shape=tuple(at if x == axis else n for x, n in first.sizes.items()))


def concatenate_bounds(constructs: list[Construct], axis: str) -> DataFrame | None:
    """The bounds of constructs end to end along an axis; None if one has none.

    Corners, and interior rings or whatever other arrays a row has, are padded with missing values to the most that any of
    the constructs has, which one small job finds. Values follow the units of the first construct's data; an array that only
    some have is missing for the others."""
    if any(c.bounds is None for c in constructs):
        return None
    arrays = list(dict.fromkeys(n for c in constructs for n in c.bounds.columns if n not in c.axes))
    widths = None
    for c in constructs:
        one = c.bounds.agg(*(F.max(F.size(n) if n in c.bounds.columns else F.lit(None).cast("int")).alias(n) for n in arrays))
        widths = one if widths is None else widths.unionByName(one)
    most = widths.agg(*(F.max(n).alias(n) for n in arrays)).first().asDict()
    out, at = None, 0
    for c in constructs:
        columns = [(F.col(a) + at).alias(a) if a == axis else F.col(a) for a in c.axes]
        for n in arrays:
            if n not in c.bounds.columns:
                kind = next(x.bounds.schema[n].dataType for x in constructs if n in x.bounds.columns)
                columns.append(F.lit(None).cast(kind).alias(n))
                continue
            value = F.transform(n, _in_units(c.data.units, constructs[0].data.units)) if n == "bounds" else F.col(n)
            missing = F.array_repeat(F.lit(None).cast(c.bounds.schema[n].dataType.elementType), F.greatest(F.lit(most[n] or 0) - F.size(n), F.lit(0)))
            columns.append(F.concat(value, missing).alias(n))
        part = c.bounds.select(*columns)
        out = part if out is None else out.unionByName(part)
        at += c.data.sizes[axis]
    return out


def _in_units(a: str | None, b: str | None) -> Callable[[Column], Column]:
    return lambda x: converted(x, a, b)


def concatenate_fields(fields: list[Field], axis: str) -> Field:
    """Fields along an axis: constructs that span it are joined by key, with their bounds, and dropped where a field lacks them or units differ; others are the first field's."""
    first = fields[0]
    kept: list[Construct] = []
    for c in first.constructs:
        if c.type == "domain_axis" and c.key == axis:
            c = replace(c, size=sum(f.data.sizes[axis] for f in fields))
        elif axis in c.axes and c.data is not None:
            own = [next((x for x in f.constructs if x.key == c.key), None) for f in fields]
            try:
                c = replace(c, data=concatenate([x.data for x in own], axis), bounds=concatenate_bounds(own, axis))
            except (AttributeError, ValueError):
                continue
        kept.append(c)
    return replace(first, data=concatenate([f.data for f in fields], axis), constructs=tuple(kept))


def dropped_repeats(df: DataFrame, key: str, content: list[str]) -> DataFrame:
    """The first of rows with equal content, by key: components that are written once and shared. Also gives `shared`, the key that stands for each row."""
    hashed = df.withColumn("_h", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    first = hashed.groupBy("_h").agg(F.min(key).alias("shared"))
    return hashed.join(first, "_h").drop("_h")


def unique_constructs(constructs: list[Construct], ignore: tuple[str, ...] = ()) -> list[Construct]:
    """Constructs without repeats in their order; ignored properties that differ among equal ones are removed."""
    out: list[Construct] = []
    for c in constructs:
        same = lambda p: {k: v for k, v in p.items() if k not in ignore}
        for k, known in enumerate(out):
            if replace(known, key="", properties=same(known.properties)) == replace(c, key="", properties=same(c.properties)):
                shared = {n: v for n, v in known.properties.items() if n not in ignore or c.properties.get(n) == v}
                out[k] = replace(known, properties=shared)
                break
        else:
            out.append(c)
    return out


def newest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that of the largest order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
