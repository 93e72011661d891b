"""Aggregation datasets as one Spark source: an array in fragments, each in a file of its own or one constant."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.attrs import parse_key_values
from ..functions.units import rescaled
from ..model import Cells
from ..operators.fragments import manifest
from . import netcdf3, zarr3
from .netcdf3 import ARROW, as_cells
from .ranges import AxisRanges, Pieces, dealt, known
from .scratch import local


class Aggregation(DataSource):
    """spark.read.format("aggregation").options(entries=..., axes=..., shape=..., type=..., units=...).load(): a row per cell of the whole array.

    `entries` is JSON, or the path of a file of it: for every fragment its place (start and stop on each axis) and its
    `value`, or its `uri`, with `identifier` (a variable of a classic netCDF file; a Zarr array has none) and `units` where
    the file does not say them. Fragments may lack axes of size 1, have units of their own and other number types.
    Comparisons of axis columns choose fragments before any is opened, and the part of each that is read. A partition is as
    many neighbouring fragments, or as large a part of one, as have about `cells` cells."""

    @classmethod
    def name(cls) -> str:
        return "aggregation"

    def schema(self) -> str:
        return ", ".join([*(f"`{a}` bigint" for a in json.loads(self.options["axes"])), f"value {self.options.get('type', 'double')}"])

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(dict(self.options))


class Reader(AxisRanges, DataSourceReader):
    def __init__(self, options: dict) -> None:
        super().__init__(json.loads(options["axes"]), json.loads(options["shape"]))
        self.options = {k: v for k, v in options.items() if k != "entries"}
        text = options["entries"]
        if text.lstrip()[:1] != "[":
            with open(local(text)) as f:
                text = f.read()
        self.entries = json.loads(text)

    def partitions(self) -> list[InputPartition]:
        boxes = [(x, self.wanted(x["start"], x["stop"])) for x in self.entries]
        out = dealt([(x, *box) for x, box in boxes if box], int(self.options.get("cells", 1 << 20)))
        self.entries = []  # each task is told its own
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        kind, units = ARROW[self.options.get("type", "double")], self.options.get("units")
        for x, start, stop in partition.pieces:
            low, high = ([p - q for p, q in zip(side, x["start"])] for side in (start, stop))
            if "uri" in x:
                data, gone, own = _fragment(x, low, high, [q - p for p, q in zip(x["start"], x["stop"])])
                data = rescaled(data, x.get("units") or own, units)
            else:
                shape = [b - a for a, b in zip(low, high)]
                data, gone = np.full(shape, 0 if x["value"] is None else x["value"]), np.full(shape, x["value"] is None)
            yield as_cells(data, gone, start, self.axes, kind)


def _fragment(x: dict, low: list[int], high: list[int], shape: list[int]) -> tuple[np.ndarray, np.ndarray, str | None]:
    """The wanted part of a fragment, what is missing in it, and its units; axes of size 1 that its file lacks are put in."""
    path = local(x["uri"])
    if x.get("identifier"):
        h = netcdf3.read_header(path)
        v = h.variables[x["identifier"]]
        own, read = h.shape(v), None
        units = v.attributes.get("units")
    else:
        read = zarr3.Stored(path)
        own, units = read.shape, read.attributes.get("units")
    axes = list(range(len(shape))) if len(own) == len(shape) else [d for d, n in enumerate(shape) if n > 1]
    if tuple(own) != tuple(shape[d] for d in axes):
        raise ValueError(f"{path} has the shape {tuple(own)}, its fragment {tuple(shape)}")
    a, b = [low[d] for d in axes], [high[d] for d in axes]
    if read:
        data, gone = read.box(a, b)
    else:
        with open(path, "rb") as f:
            data, gone = netcdf3.values(f, h, v, *((a[0], b[0]) if a else (0, 1)))
        inner = (slice(None), *(slice(p, q) for p, q in zip(a[1:], b[1:])))
        data, gone = data[inner], gone[inner]
    whole = [q - p for p, q in zip(low, high)]
    return data.reshape(whole), gone.reshape(whole), units


def read(spark: SparkSession, entries: list[dict] | str, axes: tuple[str, ...], shape: tuple[int, ...], units: str | None = None, dtype: str = "double", cells: int = 1 << 20) -> Cells:
    """The whole array, lazily; `entries` as of fragments.manifest(), or the path of a JSON file with them."""
    known(spark, Aggregation)
    text = entries if isinstance(entries, str) else json.dumps(entries)
    options = {"entries": text, "axes": json.dumps(list(axes)), "shape": json.dumps(list(shape)), "type": dtype, "cells": str(cells)} | ({"units": units} if units else {})
    return Cells(spark.read.format("aggregation").options(**options).load(), tuple(axes), tuple(shape), units=units)


def stored(spark: SparkSession, path: str, variable: str) -> Cells:
    """The array of an aggregation variable in a classic file: aggregated_data names a map of fragment sizes, and either unique values, or files and what the array is called in them. Relative files are taken from the folder of this one; a fragment without file is missing."""
    file = local(path)
    h = netcdf3.read_header(file)
    a = h.variables[variable].attributes
    terms = {k: v[0] for k, v in parse_key_values(a["aggregated_data"]).items()}
    named = dict(h.dimensions)
    axes = tuple(a["aggregated_dimensions"].split())
    array = lambda term: netcdf3.array_of(file, h, terms[term])
    sizes = [row.compressed().astype(int).tolist() for row in array("map").reshape(len(axes), -1)] if axes else []
    if "unique_values" in terms:
        values = array("unique_values").ravel()
        entries = manifest(sizes, unique_values=[None if m else v.item() for v, m in zip(values.data, np.ma.getmaskarray(values))])
    else:
        uris = array("uris").ravel().tolist()
        names = array("identifiers").ravel().tolist()
        entries = manifest(sizes, uris, names, base=os.path.dirname(file))
        entries = [{k: x[k] for k in ("start", "stop")} | {"value": None} if not u else x for x, u in zip(entries, uris)]
    kind = netcdf3.TYPES[h.variables[variable].type][1]
    return replace(read(spark, entries, axes, tuple(named[d] for d in axes), a.get("units"), kind), calendar=a.get("calendar"), fill=a.get("_FillValue"))


def planned(cells: Cells, folder: str, name: str, rows: int, base: str) -> tuple[dict, dict[str, int], dict[str, tuple]]:
    """(attributes of the aggregation variable, dimensions, small variables with their arrays) of cells whose fragments, of `rows` indices of the first axis each, are written to `folder`; files are named from `base`."""
    entries = netcdf3.write_fragments(cells, folder, name, rows)
    there = {x["start"][0]: os.path.relpath(x["uri"], base) for x in entries}
    n = -(-cells.shape[0] // rows)
    uris = [there.get(k * rows, "").encode() for k in range(n)]
    width = max(1, *map(len, uris), len(name.encode()))
    sizes = np.full((cells.ndim, max(n, 1)), -1, "i4")
    sizes[0, :n] = [min(rows, cells.shape[0] - k * rows) for k in range(n)]
    sizes[1:, 0] = cells.shape[1:]
    shape = [n, *[1] * (cells.ndim - 1)]
    dims = {f"{name}_axes": cells.ndim, f"{name}_fragments": max(n, 1), f"{name}_text": width} | {f"{name}_f{d}": k for d, k in enumerate(shape)}
    on = tuple(f"{name}_f{d}" for d in range(cells.ndim))
    text = lambda x: np.array(x, f"S{width}").view("S1")
    variables = {
        f"{name}_map": ((f"{name}_axes", f"{name}_fragments"), "i4", {"_FillValue": np.int32(-1)}, sizes),
        f"{name}_uris": ((*on, f"{name}_text"), "S1", {}, text(uris).reshape(*shape, width)),
        f"{name}_identifiers": ((f"{name}_text",), "S1", {}, text([name.encode()])),
    }
    said = f"map: {name}_map uris: {name}_uris identifiers: {name}_identifiers"
    return {"aggregated_data": said}, dims, variables
