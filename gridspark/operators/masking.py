"""Missing data: tests, fills, masks from valid ranges, and conditional values."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Cells, Construct, Field
from ..sources.types import DEFAULT_FILL


def mask(cells: Cells) -> Cells:
    return cells.select(cells.v.isNull())


def masked_where(cells: Cells, condition: Column) -> Cells:
    """Missing where the condition is true; where it is unknown, values stay."""
    return cells.select(F.when(F.coalesce(condition, F.lit(False)), None).otherwise(cells.v))


def masked_values(cells: Cells, value: float, rtol: float = 2.220446049250313e-16, atol: float = 2.220446049250313e-16) -> Cells:
    """Missing where |x - value| <= atol + rtol * |value|."""
    return masked_where(cells, F.abs(cells.v - F.lit(value)) <= F.lit(atol + rtol * abs(value)))


def filled(cells: Cells, fill_value: object = None) -> Cells:
    """A number in place of missing data: the one given, the field's own, or the default of its type."""
    kind = cells.df.schema[cells.value].dataType.simpleString()
    value = fill_value if fill_value is not None else cells.fill if cells.fill is not None else DEFAULT_FILL.get(kind)
    return cells.select(F.coalesce(cells.v, F.lit(value).cast(kind)))


def same_number(x: Column, value: float) -> Column:
    """Equality as numbers have it on disk: NaN sentinels match NaN."""
    return F.isnan(x.cast("double")) if value != value else x == F.lit(value)


def validity(x: Column, fill_values: tuple = (), valid_min: object = None, valid_max: object = None, valid_range: tuple | None = None) -> Column:
    """True where a value is one of the fill values or outside the valid range. NaN is outside no range."""
    if valid_range is not None and (valid_min is not None or valid_max is not None):
        raise ValueError("give valid_range, or valid_min and valid_max")
    low, high = valid_range if valid_range is not None else (valid_min, valid_max)
    out = F.lit(False)
    for value in fill_values:
        out = out | same_number(x, value)
    number = ~F.isnan(x.cast("double"))
    if low is not None:
        out = out | (number & (x < F.lit(low)))
    if high is not None:
        out = out | (number & (x > F.lit(high)))
    return out


def apply_masking(cells: Cells, fill_values: tuple = (), valid_min: object = None, valid_max: object = None, valid_range: tuple | None = None) -> Cells:
    return masked_where(cells, validity(cells.v, fill_values, valid_min, valid_max, valid_range))


def apply_masking_with_bounds(df: DataFrame, value: str, bounds: str, **limits: object) -> DataFrame:
    """A coordinate and the corners of its cells, masked by the same limits."""
    test = lambda x: F.when(~F.coalesce(validity(x, **limits), F.lit(False)), x)
    return df.withColumn(value, test(F.col(value))).withColumn(bounds, F.transform(bounds, test))


#: Properties that say which values are valid.
LIMITS = ("valid_min", "valid_max", "valid_range")


def apply_masking_field(f: Field) -> Field:
    """A field whose data, and those of its constructs with their bounds, are missing where their own properties say so: fill and missing values, valid minimum, maximum and range."""

    def said(p: dict, c: Cells) -> dict:
        fills = tuple(float(x) for x in (p.get("missing_value"), p.get("_FillValue"), c.fill) if x is not None)
        limits = {k: tuple(map(float, p[k])) if k == "valid_range" else float(p[k]) for k in LIMITS if p.get(k) is not None}
        return {"fill_values": fills, **limits}

    def masked(p: dict, c: Cells) -> Cells:
        numbers = c.df.schema[c.value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double")
        return apply_masking(c, **said(p, c)) if numbers else c

    def construct(c: Construct) -> Construct:
        if c.data is None:
            return c
        limits = said(c.properties, c.data)
        test = lambda x: F.when(~F.coalesce(validity(x, **limits), F.lit(False)), x)
        return replace(c, data=masked(c.properties, c.data), bounds=c.bounds.withColumn("bounds", F.transform("bounds", test)) if c.bounds is not None else None)

    return replace(f, data=masked(f.properties, f.data), constructs=tuple(map(construct, f.constructs)))


def where(condition: Column, original: Column, x: Column | None, y: Column | None, hardmask: bool = True) -> Column:
    """x where the condition holds, y where it does not; None leaves the original, and so does an unknown condition. A hard mask keeps missing cells missing."""
    out = F.when(condition, original if x is None else x).when(~condition, original if y is None else y).otherwise(original)
    return F.when(original.isNotNull(), out) if hardmask else out


def harden_mask(cells: Cells) -> Cells:
    return replace(cells, hardmask=True)


def soften_mask(cells: Cells) -> Cells:
    return replace(cells, hardmask=False)


def compressed(cells: Cells, axis: str = "i") -> Cells:
    """The values that are not missing, in row-major order, on one axis.

    Numbers are given in two steps: counts of ranges of the row-major number first, then places inside each,
    so no task orders all cells."""
    from .cells import linear_index
    from .ordering import dense_places

    k = cells.df.where(cells.v.isNotNull()).select(linear_index(cells).alias("_k"), cells.v.alias(cells.value))
    return replace(cells, df=dense_places(k, "_k", cells.size, axis).select(axis, cells.value), axes=(axis,), shape=(-1,))
