"""Compression by gathering: some axes are stored as one list of row-major places."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Cells
from .cells import linear_index, unravelled


def scatter(gathered: DataFrame, places: DataFrame, item: str, place: str, axes: tuple[str, ...], shape: tuple[int, ...], keep: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Cells of a gathered array: list items back at their places. Cells that no item names are absent; densified() fills them."""
    joined = gathered.join(places.select(item, place), item)
    return joined.select(*keep, *unravelled(F.col(place), axes, shape), value)


def gather(cells: Cells, axes: tuple[str, ...], item: str = "item", place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(cells on the list axis, places): the list holds the row-major numbers of places at which any cell is present."""
    from .ordering import dense_places

    keep = [a for a in cells.axes if a not in axes]
    size = 1
    for a in axes:
        size *= cells.sizes[a]
    rows = cells.df.withColumn(place, linear_index(cells, axes))
    places = dense_places(rows.where(cells.v.isNotNull()).select(place).distinct(), place, size, item)
    return rows.join(places, place).select(*keep, item, cells.value), places.select(item, place)


def sparse(cells: Cells, absent: float = 0) -> Cells:
    """Only the cells that differ from `absent`; a missing cell differs."""
    return replace(cells, df=cells.df.where(~cells.v.eqNullSafe(F.lit(absent))))
