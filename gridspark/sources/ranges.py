"""Comparisons of axis columns that reach a source as ranges of positions, so that it opens only what it needs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual


class Pieces(InputPartition):
    """What one task reads: several pieces, each a place and its first and one past its last position on every axis."""

    def __init__(self, pieces: list[tuple]) -> None:
        super().__init__(None)
        self.pieces = pieces


class AxisRanges:
    """Mixed into a reader: `low` and `high` are the wanted positions of each axis, narrowed by filters. Positions are never NULL."""

    def __init__(self, axes: list[str], shape: tuple[int, ...]) -> None:
        self.axes = list(axes)
        self.low, self.high = [0] * len(shape), list(shape)

    def _narrowed(self, f: Filter) -> bool:
        """Takes over a filter; False where Spark has to apply it too."""
        name = ".".join(getattr(f, "attribute", ()))
        if name not in self.axes:
            return False
        d = self.axes.index(name)
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, In):
            known = [v for v in f.value if v is not None]
            self.low[d], self.high[d] = max(self.low[d], min(known, default=0)), min(self.high[d], max(known, default=-1) + 1)
            return False
        low, high = {
            EqualTo: lambda v: (v, v + 1),
            GreaterThan: lambda v: (v + 1, None),
            GreaterThanOrEqual: lambda v: (v, None),
            LessThan: lambda v: (None, v),
            LessThanOrEqual: lambda v: (None, v + 1),
        }.get(type(f), lambda v: (None, None))(getattr(f, "value", 0))
        self.low[d] = self.low[d] if low is None else max(self.low[d], low)
        self.high[d] = self.high[d] if high is None else min(self.high[d], high)
        return low is not None or high is not None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self._narrowed(f)]

    def wanted(self, start: tuple[int, ...], stop: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """The wanted part of a box; None if there is none."""
        a = tuple(max(x, y) for x, y in zip(start, self.low))
        b = tuple(min(x, y) for x, y in zip(stop, self.high))
        return (a, b) if all(x < y for x, y in zip(a, b)) else None


def volume(start: tuple[int, ...], stop: tuple[int, ...]) -> int:
    n = 1
    for a, b in zip(start, stop):
        n *= b - a
    return n


def dealt(pieces: list[tuple], cells: int) -> list[Pieces]:
    """Pieces (place, start, stop) in their order, in partitions of about `cells` cells; larger ones are cut along the first axis."""
    out: list[list[tuple]] = [[]]
    held = 0
    for place, start, stop in pieces:
        if not start:
            parts = [(start, stop)]
        else:
            step = max(1, cells // max(volume(start[1:], stop[1:]), 1))
            parts = [((a, *start[1:]), (min(a + step, stop[0]), *stop[1:])) for a in range(start[0], stop[0], step)]
        for a, b in parts:
            n = volume(a, b)
            if held and held + n > cells:
                out.append([])
                held = 0
            out[-1].append((place, a, b))
            held += n
    return [Pieces(x) for x in out]


def known(spark: SparkSession, source: type[DataSource]) -> None:
    """Registers a source, with filters reaching it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
