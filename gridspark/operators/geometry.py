"""Geometry cells: parts and rings as nested arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_start


def nested(nodes: DataFrame, parts: DataFrame, cells: DataFrame, node: str, part: str, cell: str, part_count: str, node_count: str, columns: tuple[str, ...] = ("x", "y"), ring: str | None = None) -> DataFrame:
    """(cell, parts array<array<struct>>, rings): nodes belong to parts by node count, parts to cells by the nodes the cell counts.

    A part's first node lies in exactly one cell's stretch of nodes, so both levels are prefix sums; parts are
    then matched to cells through the start of the node that opens them."""
    starts = running_start(parts, part, part_count, "_start")
    places = starts.select(part, *([ring] if ring else []), "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col(part_count).cast("long") - 1)).alias("_e")).withColumn(node, F.col("_start") + F.col("_e"))
    owner = running_start(cells, cell, node_count, "_first").select(cell, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col(node_count).cast("long") - 1)).alias(node))
    rows = places.join(nodes, node).join(owner, node)
    ordered = F.array_sort(F.collect_list(F.struct("_e", *columns)))
    by_part = rows.groupBy(cell, part, *([ring] if ring else [])).agg(F.transform(ordered, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("_p"))
    inner = F.array_sort(F.collect_list(F.struct(part, *([ring] if ring else []), "_p")))
    out = by_part.groupBy(cell).agg(inner.alias("_x"))
    return out.select(cell, F.transform("_x", lambda x: x["_p"]).alias("parts"), *([F.transform("_x", lambda x: x[ring]).alias("rings")] if ring else []))


def bounding_box(df: DataFrame, cell: str, parts: str = "parts") -> DataFrame:
    """(cell, min and max of x and y, nodes) of nested parts."""
    flat = F.flatten(parts)
    x, y = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return df.select(cell, F.array_min(x).alias("min_x"), F.array_max(x).alias("max_x"), F.array_min(y).alias("min_y"), F.array_max(y).alias("max_y"), F.size(flat).cast("long").alias("nodes"))
