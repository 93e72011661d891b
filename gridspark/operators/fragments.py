"""Aggregation datasets: an array in fragments, each in a file of its own or one constant."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(sizes: list[list[int]], uris: list[str] | None = None, identifiers: list[str] | None = None, unique_values: list | None = None, base: str = "") -> list[dict]:
    """One entry per fragment in row-major order: its place (start and stop on each axis), and its file or its constant. Relative paths are taken from `base`."""
    spans = []
    for row in sizes:
        at, own = 0, []
        for n in row:
            own.append((at, at + n))
            at += n
        spans.append(own)
    out: list[dict] = [{"start": [], "stop": []}]
    for own in spans:
        out = [{"start": [*x["start"], a], "stop": [*x["stop"], b]} for x in out for a, b in own]
    for k, x in enumerate(out):
        if unique_values is not None:
            x["value"] = unique_values[k]
        else:
            x["uri"] = uris[k] if "://" in uris[k] or uris[k].startswith("/") else posixpath.normpath(posixpath.join(base, uris[k]))
            x["identifier"] = identifiers[k if len(identifiers) > 1 else 0] if identifiers else None
    return out


def relocated(entries: DataFrame, old: str, new: str, column: str = "uri") -> DataFrame:
    """Another directory in the paths of a manifest."""
    c = F.col(column)
    return entries.withColumn(column, F.when(c.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substr(c, F.lit(len(old.rstrip("/")) + 1)))).otherwise(c))


def constants(df: DataFrame, fragment: str, value: str) -> dict[int, object]:
    """The constants by fragment number: those of fragments that hold one value only, for manifest(unique_values=...). One row a fragment comes to the driver."""
    return {r[fragment]: r["value"] for r in unique_value(df, fragment, value).where("constant").collect()}


def unique_value(df: DataFrame, fragment: str, value: str) -> DataFrame:
    """(fragment, value) where a fragment holds one value only, missing counting as one; else NULL and `constant` false."""
    g = df.groupBy(fragment).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count(value).alias("_n"), F.count("*").alias("_m"))
    same = (F.col("_n") == 0) | (F.col("_a") == F.col("_b")) & (F.col("_n") == F.col("_m"))
    return g.select(fragment, same.alias("constant"), F.when(same, F.col("_a")).alias("value"))
