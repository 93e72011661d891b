"""Operators on each cell: comparisons, bits, signs; two arrays are aligned by their axes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Cells


def _number(x: Column) -> Column:
    return ~F.isnan(x.cast("double"))


def compare(op: str, a: Column, b: Column) -> Column:
    """Comparisons in which NaN equals nothing and is in no order; missing on either side gives missing."""
    both = _number(a) & _number(b)
    if op == "!=":
        return ~(both & (a == b))
    return both & {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def bits(op: str, a: Column, b: Column) -> Column:
    """Bitwise operators on whole numbers, in 64 bits; shifts take the number of bits from the row."""
    a, b = a.cast("long"), b.cast("long")
    if op in ("<<", ">>"):
        return F.call_function("shiftleft" if op == "<<" else "shiftright", a, b.cast("int"))
    return {"&": a.bitwiseAND(b), "|": a.bitwiseOR(b), "^": a.bitwiseXOR(b)}[op]


def unary(op: str, a: Column) -> Column:
    return {"abs": F.abs(a), "-": -a, "~": F.bitwise_not(a), "+": a}[op]


def binary(op: str, a: Cells, b: Cells | float | int) -> Cells:
    """a op b. Arrays are joined on the axes they share, axes of size 1 are repeated, axes of one alone are kept. Units are those of the left side; the right side is not converted."""
    f = compare if op in ("==", "!=", "<", "<=", ">", ">=") else bits
    if not isinstance(b, Cells):
        return a.select(f(op, a.v, F.lit(b)))
    on = [x for x in a.axes if x in b.axes and a.sizes[x] > 1 and b.sizes[x] > 1]
    if any(a.sizes[x] != b.sizes[x] for x in on):
        raise ValueError(f"sizes {a.sizes} and {b.sizes} do not go together")
    left = a.df.select(*a.axes, a.v.alias("_a"))
    own = [x for x in b.axes if x not in on and b.sizes[x] > 1]
    left = left.drop(*own)  # of size 1 there
    right = b.df.select(*on, *own, b.v.alias("_b"))
    if on:
        both = left.join(right, on)
    elif not own:
        both = left.crossJoin(F.broadcast(right))  # the right side is one cell
    else:
        raise ValueError("arrays without a common axis are not combined; put one on the other's axes first")
    axes = tuple(dict.fromkeys((*a.axes, *own)))
    sizes = {x: b.sizes[x] if x in own else a.sizes[x] for x in axes}
    return replace(a, df=both.select(*axes, f(op, F.col("_a"), F.col("_b")).alias(a.value)), axes=axes, shape=tuple(sizes.values()))
