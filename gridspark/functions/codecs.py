"""How values stand in files: packing, unsigned numbers, characters, lossy rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(x: Column, kind: str) -> Column:
    """The bits of a signed column read as an unsigned number of the same width."""
    if kind == "bigint":
        return F.when(x < 0, x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)"))
    width = {"tinyint": 0xFF, "smallint": 0xFFFF, "int": 0xFFFFFFFF}[kind]
    return x.cast("long").bitwiseAND(F.lit(width)).cast({"tinyint": "smallint", "smallint": "int", "int": "bigint"}[kind])


def unpacked(x: Column, scale_factor: float | None = None, add_offset: float | None = None, kind: str = "double") -> Column:
    """x * scale_factor + add_offset; identity factors only change the type. Missing values are found before."""
    out = x.cast(kind)
    if scale_factor not in (None, 1):
        out = out * F.lit(scale_factor)
    if add_offset not in (None, 0):
        out = out + F.lit(add_offset)
    return out.cast(kind)


def packed(x: Column, scale_factor: float | None = None, add_offset: float | None = None, kind: str = "smallint") -> Column:
    """(x - add_offset) / scale_factor; whole numbers are rounded half to even."""
    out = x.cast("double")
    if add_offset not in (None, 0):
        out = out - F.lit(add_offset)
    if scale_factor not in (None, 1):
        out = out / F.lit(scale_factor)
    return F.rint(out).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint") else out.cast(kind)


def characters(text: Column, width: int) -> Column:
    """A string as an array of single characters, padded with empty ones."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.substring(text, k, F.lit(1)))


def joined(chars: Column) -> Column:
    """The string of an array of characters, without trailing blanks and padding."""
    return F.rtrim(F.array_join(F.transform(chars, lambda c: F.coalesce(c, F.lit(""))), ""))


def _size(x: Column) -> Column:
    """|x|, but 1 for what has no exponent: zero, infinite and no number."""
    return F.when((x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(1.0)).otherwise(F.abs(x))


def significant(x: Column, digits: int) -> Column:
    """x with `digits` significant decimal digits kept, rounded to a power of two below half a unit of the last digit ("digit round"): the relative error stays under half a unit."""
    size = _size(x)
    decimal = F.floor(F.log10(size)) + 1
    # The largest power of two whose half is no more than half a unit of the last digit.
    step = F.pow(F.lit(2.0), F.floor(F.lit(math.log2(10)) * (decimal - digits)))
    return _kept(x, F.signum(x) * (F.floor(size / step) + 0.5) * step)


def _exponent(size: Column) -> Column:
    """The whole number e with 2^e <= size < 2^(e + 1)."""
    power = F.floor(F.log2(size))
    return F.when(F.pow(F.lit(2.0), power) > size, power - 1).when(F.pow(F.lit(2.0), power + 1) <= size, power + 1).otherwise(power)


def _kept(x: Column, y: Column) -> Column:
    """y, but x where nothing is to round."""
    return F.when(x.isNull() | (x == 0) | F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(y)


def bit_rounded(x: Column, bits: int) -> Column:
    """x with `bits` explicit bits of its significand, rounded half to even ("bit round")."""
    step = F.pow(F.lit(2.0), _exponent(_size(x)) - bits)
    return _kept(x, F.rint(x / step) * step)


def groomed(x: Column, digits: int, position: Column, most: int = 52) -> Column:
    """x with the bits beyond those that `digits` significant digits need cleared at even positions and set at odd ones ("bit groom"), so that errors cancel in sums; `most` are the explicit bits of its type."""
    bits = min(math.ceil(digits * math.log2(10)) + 1, most)
    size = _size(x)
    e = _exponent(size)
    step = F.pow(F.lit(2.0), e - bits)
    shaved = F.floor(size / step) * step
    return _kept(x, F.signum(x) * F.when(position % 2 == 0, shaved).otherwise(shaved + (step - F.pow(F.lit(2.0), e - most))))


def granular(x: Column, digits: int) -> Column:
    """x with as many bits as it needs for `digits` significant digits, by its own decimal exponent, rounded half up ("granular bit round")."""
    size = _size(x)
    e = _exponent(size) + 1  # size is a fraction from 1/2 on, times 2^e
    per = F.lit(math.log2(10))
    part = F.log10(size / F.pow(F.lit(2.0), e))
    decimal = F.floor(e * F.lit(math.log10(2)) + part) + 1
    power = F.floor(per * (decimal - digits))
    bits = F.abs(F.floor(e - per * part) - power) - 1
    step = F.pow(F.lit(2.0), e - 1 - bits)
    return _kept(x, F.signum(x) * F.floor(size / step + 0.5) * step)


#: The largest number of significant decimal digits and bits of each type.
LIMITS = {"float": (7, 23), "double": (15, 52)}


def quantised(x: Column, algorithm: str, keep: int, kind: str = "double", position: Column | None = None) -> Column:
    """x rounded by a named algorithm: `bitround` to bits; `digitround`, `granular_bitround` and `bitgroom`, which needs positions, to significant digits."""
    if algorithm not in ("digitround", "bitround", "granular_bitround", "bitgroom"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    most = LIMITS[kind][algorithm == "bitround"]
    if not 1 <= keep <= most:
        raise ValueError(f"{algorithm} of {kind} keeps 1 to {most}")
    x = x.cast("double")
    if algorithm == "bitgroom":
        if position is None:
            raise ValueError("bitgroom needs the position of each value")
        return groomed(x, keep, position, LIMITS[kind][1]).cast(kind)
    return {"digitround": significant, "bitround": bit_rounded, "granular_bitround": granular}[algorithm](x, keep).cast(kind)
