"""The classic netCDF format: its header, a Spark source for one variable, and fragments written in parallel."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Cells
from ..operators.fragments import manifest
from .ranges import AxisRanges, Pieces, dealt, known
from .scratch import local
from .types import DEFAULT_FILL

#: Type codes of the format, numpy types and Spark types. Those from 7 on are of version 5 only.
TYPES = {
    1: (">i1", "tinyint"), 2: ("S1", "string"), 3: (">i2", "smallint"), 4: (">i4", "int"), 5: (">f4", "float"), 6: (">f8", "double"),
    7: (">u1", "smallint"), 8: (">u2", "int"), 9: (">u4", "bigint"), 10: (">i8", "bigint"), 11: (">u8", "decimal(20,0)"),
}
CODES = {v[0][1:] if k != 2 else "S1": k for k, v in TYPES.items()}
#: The type in a file of each Spark type; bigint makes the file one of version 5.
OF_SPARK = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}
#: Tags of the header's lists.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


@dataclass
class Variable:
    name: str
    dimensions: list[int]
    attributes: dict
    type: int
    size: int
    begin: int


@dataclass
class Header:
    version: int = 1
    records: int = 0
    dimensions: list[tuple[str, int]] = field(default_factory=list)
    attributes: dict = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dimensions[d][1] or self.records for d in v.dimensions)

    def is_record(self, v: Variable) -> bool:
        return bool(v.dimensions) and self.dimensions[v.dimensions[0]][1] == 0

    @property
    def record_size(self) -> int:
        own = [v for v in self.variables.values() if self.is_record(v)]
        if len(own) == 1:  # alone, records are not padded
            return int(np.prod(self.shape(own[0])[1:], dtype=object)) * np.dtype(TYPES[own[0].type][0]).itemsize
        return sum(v.size for v in own)


def read_header(path: str) -> Header:
    """The header alone is read, whatever the size of the data."""
    with open(path, "rb") as f:
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is not a classic netCDF file")
        h = Header(version=magic[3])

        def number(wide: bool = h.version == 5) -> int:
            return struct.unpack(">q", f.read(8))[0] if wide else struct.unpack(">i", f.read(4))[0]

        def name() -> str:
            n = number()
            out = f.read(n).decode()
            f.read(-n % 4)
            return out

        def attributes() -> dict:
            tag, n = number(False), number()
            out = {}
            for _ in range(n if tag == ATTRIBUTE else 0):
                key, kind, count = name(), number(False), number()
                dtype = np.dtype(TYPES[kind][0])
                raw = f.read(count * dtype.itemsize)
                f.read(-len(raw) % 4)
                out[key] = raw.decode() if kind == 2 else (x := np.frombuffer(raw, dtype).tolist())[0] if count == 1 else x
            return out

        h.records = number()
        tag, n = number(False), number()
        h.dimensions = [(name(), number()) for _ in range(n if tag == DIMENSION else 0)]
        h.attributes = attributes()
        tag, n = number(False), number()
        for _ in range(n if tag == VARIABLE else 0):
            key, count = name(), number()
            dims = [number() for _ in range(count)]
            own = attributes()
            kind, size, begin = number(False), number(), number(h.version != 1)
            h.variables[key] = Variable(key, dims, own, kind, size, begin)
        return h


def _layout(dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], str, dict]], attributes: dict | None, unlimited: str | None = None) -> tuple[bytes, Header, int]:
    """The header of a file of variables (dimensions, type such as i4, attributes), the same as a description, and the size of the whole file. Variables that begin with the unlimited dimension go by records.

    Version 2, or 5 where a variable or an attribute has a type that only that has."""
    attributes = attributes or {}
    wide = any(t not in ("i1", "S1", "i2", "i4", "f4", "f8") for _, t, _ in variables.values())
    count = lambda n: struct.pack(">q" if wide else ">i", n)
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    name = lambda text: count(len(text.encode())) + padded(text.encode())
    listed = lambda tag, n: struct.pack(">i", tag if n else 0) + count(n)

    def attribute(value: object) -> bytes:
        if isinstance(value, str):
            kind, n, raw = 2, len(value.encode()), value.encode()
        else:
            x = np.atleast_1d(value)
            own = x.dtype.str[1:] if isinstance(value, (np.generic, np.ndarray)) else "i4" if x.dtype.kind in "iu" and (np.abs(x) < 2**31).all() else "i8" if wide and x.dtype.kind in "iu" else "f8"
            own = own if CODES[own] <= 6 or wide else "f8"
            kind, n, raw = CODES[own], len(x), x.astype(TYPES[CODES[own]][0]).tobytes()
        return struct.pack(">i", kind) + count(n) + padded(raw)

    noted = lambda a: listed(ATTRIBUTE, len(a)) + b"".join(name(k) + attribute(v) for k, v in a.items())
    names = list(dimensions)
    records = dimensions.get(unlimited, 0) if unlimited else 0
    head = b"CDF" + (b"\x05" if wide else b"\x02") + count(records)
    stated = {k: 0 if k == unlimited else n for k, n in dimensions.items()}
    head += listed(DIMENSION, len(names)) + b"".join(name(k) + count(n) for k, n in stated.items()) + noted(attributes)
    head += listed(VARIABLE, len(variables))
    h = Header(5 if wide else 2, records, list(stated.items()), dict(attributes))
    blocks = []
    for key, (dims, kind, own) in variables.items():
        if unlimited in dims[1:]:
            raise ValueError(f"{key} has the unlimited dimension {unlimited} behind another")
        size = int(np.prod([dimensions[d] for d in dims if d != unlimited], dtype=object)) * np.dtype(TYPES[CODES[kind]][0]).itemsize
        size += -size % 4
        places = [names.index(d) for d in dims]
        # A size beyond what version 2 can say is written as its largest number; readers take it from the dimensions.
        said = size if wide or size < 2**31 - 3 else -1
        blocks.append(name(key) + count(len(dims)) + b"".join(map(count, places)) + noted(own) + struct.pack(">i", CODES[kind]) + count(said))
        h.variables[key] = Variable(key, places, dict(own), CODES[kind], size, 0)
    at = len(head) + sum(len(x) + 8 for x in blocks)
    for v in [*(v for v in h.variables.values() if not h.is_record(v)), *(v for v in h.variables.values() if h.is_record(v))]:
        v.begin = at
        at += v.size
    fixed = at - sum(v.size for v in h.variables.values() if h.is_record(v))
    head += b"".join(x + struct.pack(">q", v.begin) for x, v in zip(blocks, h.variables.values()))
    return head, h, fixed + records * h.record_size


def write_file(path: str, dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> None:
    """One file of fixed-size variables, with 64-bit offsets."""
    head, h, size = _layout(dimensions, {k: (dims, x.dtype.str[1:], own) for k, (dims, x, own) in variables.items()}, attributes)
    with open(path, "wb") as f:
        f.write(head)
        for key, (_, data, _) in variables.items():
            v = h.variables[key]
            f.seek(v.begin)
            f.write(np.ascontiguousarray(data, TYPES[v.type][0]).tobytes())
        f.truncate(size)


def create(path: str, dimensions: dict[str, int], variables: dict[str, tuple[tuple[str, ...], str, dict]], attributes: dict | None = None, unlimited: str | None = None) -> Header:
    """A file with its header and room for all variables, which put() fills."""
    head, h, size = _layout(dimensions, variables, attributes, unlimited)
    with open(local(path), "wb") as f:
        f.write(head)
        f.truncate(size)
    return h


def extend(path: str, records: int) -> Header:
    """Room for so many records more; the header with their number."""
    file = local(path)
    h = read_header(file)
    own = [v for v in h.variables.values() if h.is_record(v)]
    if not own:
        raise ValueError(f"{path} has no unlimited dimension")
    h.records += records
    with open(file, "r+b") as f:
        f.seek(4)
        f.write(struct.pack(">q" if h.version == 5 else ">i", h.records))
        f.truncate(min(v.begin for v in own) + h.records * h.record_size)
    return h


def put(cells: Cells, path: str, h: Header, variable: str, rows: int | None = None, limits: tuple[float, float] | None = None, first: int = 0) -> int:
    """Writes cells into their variable of a file made by create(): each task writes stretches of the first axis at their places. Gives the number of values that `limits`, the valid range, do not hold, seen by the job that writes.

    Cells are shuffled once, by stretch; missing cells get the fill value. A task that runs twice writes the same bytes.
    Strings, and arrays, go along a last dimension of the variable that the cells lack. Of a variable by records the cells
    are those from number `first` on."""
    v = h.variables[variable]
    record = h.record_size if h.is_record(v) else 0
    shape = (cells.shape[0], *h.shape(v)[1:]) if record else h.shape(v) if cells.axes else (1, *h.shape(v))
    trailing = len(v.dimensions) > len(cells.axes)
    target, dtype, axes, value = local(path), np.dtype(TYPES[v.type][0]), cells.axes, cells.value
    step = rows or max(1, (1 << 20) // max(1, int(np.prod(shape[1:], dtype=object))))
    fill = v.attributes.get("_FillValue", v.attributes.get("missing_value", b"" if v.type == 2 else DEFAULT_FILL[TYPES[v.type][1]]))
    spark = cells.df.sparkSession
    whole = shape

    def save(t: pa.Table) -> pa.Table:
        at = t.column("_stretch")[0].as_py() * step
        x = np.full((min(step, whole[0] - at), *whole[1:]), fill, dtype)
        t = t.filter(pa.compute.is_valid(t.column(value)))
        place = tuple(t.column(a).to_numpy() - (at if d == 0 else 0) for d, a in enumerate(axes)) if axes else (np.zeros(t.num_rows, np.int64),)
        x[place] = _trailing(t.column(value).combine_chunks(), shape[-1], fill) if trailing else t.column(value).to_numpy()
        with open(target, "r+b") as f:
            for k in range(len(x) if record else 1):
                f.seek(v.begin + ((first + at + k) * record if record else at * int(np.prod(whole[1:], dtype=object)) * dtype.itemsize))
                f.write(x[k : k + 1].tobytes() if record else x.tobytes())
        return pa.table({"_stretch": pa.array([at], pa.int64())})

    seen = Observation()
    own = cells.df.select(*axes, value)
    if limits:
        own = own.observe(seen, F.count_if((cells.v < limits[0]) | (cells.v > limits[1])).alias("n"))
    # Each stretch has a row, also if no cell is there.
    keyed = own.withColumn("_stretch", F.expr(f"`{axes[0]}` div {step}") if axes else F.lit(0).cast("long"))
    keyed = keyed.unionByName(spark.range(-(-whole[0] // step)).withColumnRenamed("id", "_stretch"), allowMissingColumns=True)
    keyed.groupBy("_stretch").applyInArrow(save, "_stretch long").count()
    return seen.get["n"] if limits else 0


def put_array(path: str, h: Header, variable: str, x: np.ndarray) -> None:
    """A small array into its variable of a file made by create()."""
    v = h.variables[variable]
    with open(local(path), "r+b") as f:
        f.seek(v.begin)
        f.write(np.ascontiguousarray(x, TYPES[v.type][0]).tobytes())


def array_of(path: str, h: Header, variable: str) -> np.ma.MaskedArray:
    """A small variable as a whole; the bytes of strings are joined along the last dimension."""
    v = h.variables[variable]
    shape = h.shape(v)
    with open(path, "rb") as f:
        x, gone = values(f, h, v, 0, shape[0] if shape else 1)
    x, gone = x.reshape(shape), gone.reshape(shape)
    if v.type == 2:
        return np.ma.array(np.char.decode(np.ascontiguousarray(x).view(f"S{shape[-1]}")[..., 0])) if shape else np.ma.array(x.astype("U1"))
    return np.ma.array(x, mask=gone)


def _trailing(col: pa.Array, width: int, fill: object) -> np.ndarray:
    """Strings as their bytes and arrays as they are, padded to `width`."""
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        return np.array([s.encode() for s in col.to_pylist()], f"S{width}").view("S1").reshape(len(col), width)
    sizes = col.value_lengths().to_numpy()
    x = np.full((len(col), width), fill, float)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x[np.repeat(np.arange(len(col)), sizes), at] = pa.compute.fill_null(col.flatten().cast(pa.float64()), float(fill)).to_numpy()
    return x


class NetCDF3(DataSource):
    """spark.read.format("netcdf3").option("variable", name).load(path): a row per cell, axes as bigint columns.

    The path is that of a file all executors see. A partition is a stretch of the first axis of about
    `cells` cells; its bytes alone are read, and comparisons of axis columns narrow what is read. With mask (default
    true) fill and missing values and values outside the valid range are NULL, found before unpack (default true) applies
    scale_factor and add_offset. last=text makes strings of the last dimension of a character variable, last=array
    arrays of that of any other, with missing values NULL at their places."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _found(self) -> tuple[Header, Variable]:
        h = read_header(local(self.options["path"]))
        return h, h.variables[self.options["variable"]]

    def schema(self) -> str:
        h, v = self._found()
        unpacked = self.options.get("unpack", "true") == "true" and ("scale_factor" in v.attributes or "add_offset" in v.attributes)
        kind, last = "double" if unpacked else TYPES[v.type][1], self.options.get("last")
        return ", ".join([*(f"`{h.dimensions[d][0]}` bigint" for d in (v.dimensions[:-1] if last else v.dimensions)), f"value {f'array<{kind}>' if last == 'array' else kind}"])

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(*self._found(), dict(self.options))


def values(f: BinaryIO, h: Header, v: Variable, start: int, stop: int, mask: bool = True, unpack: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Positions start..stop of the first axis, and which of their values are missing."""
    shape, dtype = h.shape(v) or (1,), np.dtype(TYPES[v.type][0])
    row = int(np.prod(shape[1:], dtype=object)) * dtype.itemsize
    if h.is_record(v):
        parts = []
        for r in range(start, stop):
            f.seek(v.begin + r * h.record_size)
            parts.append(f.read(row))
        raw = b"".join(parts)
    else:
        f.seek(v.begin + start * row)
        raw = f.read((stop - start) * row)
    x = np.frombuffer(raw, dtype).reshape(stop - start, *shape[1:])
    gone = np.zeros(x.shape, bool)
    a = v.attributes
    if mask and x.dtype.kind != "S":
        for key in ("missing_value", "_FillValue"):
            for value in np.atleast_1d(a.get(key, [])):
                gone |= np.isnan(x) if value != value else x == value
        if "_FillValue" not in a and v.type in (3, 4, 5, 6, 10):  # bytes and unsigned types have no default
            gone |= x == dtype.type(DEFAULT_FILL[TYPES[v.type][1]])
        low, high = a.get("valid_range", (a.get("valid_min"), a.get("valid_max")))
        gone |= (x < low) if low is not None else False
        gone |= (x > high) if high is not None else False
    x = x.astype(x.dtype.newbyteorder("=")) if x.dtype.kind != "S" else x
    if unpack and ("scale_factor" in a or "add_offset" in a):
        x = x.astype(float) * a.get("scale_factor", 1) + a.get("add_offset", 0)
    return x, gone


class Reader(AxisRanges, DataSourceReader):
    def __init__(self, header: Header, variable: Variable, options: dict) -> None:
        self.last = options.get("last")
        own = slice(-1) if self.last else slice(None)
        super().__init__([header.dimensions[d][0] for d in variable.dimensions[own]], header.shape(variable)[own])
        self.header, self.variable, self.options = header, variable, options

    def partitions(self) -> list[InputPartition]:
        shape = self.header.shape(self.variable)[: len(self.axes)]
        box = self.wanted((0,) * len(shape), shape)
        held = int(self.options.get("cells", 1 << 20))
        if self.last == "array":  # a row holds as many values as the last dimension
            held = max(1, held // max(1, self.header.shape(self.variable)[-1]))
        return dealt([(None, *box)] if box else [], held)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        h, v = self.header, self.variable
        on = lambda key: self.options.get(key, "true") == "true"
        kind = pa.float64() if on("unpack") and ("scale_factor" in v.attributes or "add_offset" in v.attributes) else ARROW[TYPES[v.type][1]]
        with open(local(self.options["path"]), "rb") as f:
            for _, start, stop in partition.pieces:
                first, last = (start[0], stop[0]) if start else (0, h.shape(v)[0] if v.dimensions else 1)
                x, gone = values(f, h, v, first, last, on("mask"), on("unpack"))
                inner = (slice(None), *(slice(a, b) for a, b in zip(start[1:], stop[1:])))
                x, gone = x[inner], gone[inner]
                if not v.dimensions:
                    x, gone = x[0], gone[0]
                if self.last and not start:  # one string or array alone
                    x, gone = x.reshape(1, -1), gone.reshape(1, -1)
                if self.last == "text":
                    x = np.ascontiguousarray(x).view(f"S{x.shape[-1]}")[..., 0]
                    gone = x == b""
                yield as_cells(x, gone, start, self.axes, kind, self.last == "array")


#: Arrow types of the Spark types that sources give.
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "decimal(20,0)": pa.decimal128(20, 0)}


def as_cells(x: np.ndarray, gone: np.ndarray, start: tuple[int, ...], axes: list[str], kind: pa.DataType, packed: bool = False) -> pa.RecordBatch:
    """A row for each value of a box that begins at `start`, or for each array along the last axis if packed."""
    shape = x.shape[:-1] if packed else x.shape
    n = int(np.prod(shape, dtype=object))
    places = np.unravel_index(np.arange(n), shape) if shape else ()
    columns = [pa.array((k + a).astype(np.int64)) for k, a in zip(places, start)]
    x, gone = x.ravel(), gone.ravel()
    if x.dtype.kind == "S":
        value = pa.array([c.decode(errors="replace") for c in x], kind, mask=gone)
    elif pa.types.is_decimal(kind):
        value = pa.array([None if m else int(c) for c, m in zip(x, gone)], kind)
    else:
        value = pa.array(x, mask=gone).cast(kind)
    if packed:
        value = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (len(x) // max(n, 1)), value)
    return pa.RecordBatch.from_arrays([*columns, value], [*axes, "value"])


def read(spark: SparkSession, path: str, variable: str, **options: str) -> Cells:
    """One variable as lazily read cells."""
    h = read_header(local(path))
    v = h.variables[variable]
    known(spark, NetCDF3)
    df = spark.read.format("netcdf3").option("variable", variable).options(**options).load(path)
    own = slice(-1) if "last" in options else slice(None)
    return Cells(df, tuple(h.dimensions[d][0] for d in v.dimensions[own]), h.shape(v)[own], units=v.attributes.get("units"), calendar=v.attributes.get("calendar"), fill=v.attributes.get("_FillValue"))


def write_fragments(cells: Cells, path: str, name: str = "value", rows: int = 1024, fill: float | None = None) -> list[dict]:
    """The array as files of `rows` indices of the first axis each, written by the tasks that hold them, in the type of its values; gives the manifest of the aggregation dataset.

    Cells are shuffled once, by fragment. A task holds one fragment at a time."""
    first, shape = cells.axes[0], cells.shape
    folder = local(path)
    os.makedirs(folder, exist_ok=True)
    axes, value, units = cells.axes, cells.value, cells.units
    spark_type = cells.df.schema[value].dataType.simpleString()
    kind = OF_SPARK.get(spark_type, "f8")
    fill = DEFAULT_FILL.get(spark_type, DEFAULT_FILL["double"]) if fill is None else fill
    parts = [(a, min(a + rows, shape[0])) for a in range(0, shape[0], rows)]

    def write(t: pa.Table) -> pa.Table:
        k = t.column("_fragment")[0].as_py()
        a, b = k * rows, min(k * rows + rows, shape[0])
        data = np.full((b - a, *shape[1:]), fill, kind)
        own = t.filter(pa.compute.is_valid(t.column(value)))
        data[tuple(own.column(x).to_numpy() - (a if d == 0 else 0) for d, x in enumerate(axes))] = own.column(value).to_numpy()
        target = f"{folder}/{name}-{k:06d}.nc"
        write_file(f"{target}.{os.getpid()}", dict(zip(axes, data.shape)), {name: (axes, data, {"_FillValue": np.dtype(kind).type(fill), **({"units": units} if units else {})})})
        os.replace(f"{target}.{os.getpid()}", target)  # whole or not at all, however often a task runs
        return pa.table({"_fragment": pa.array([k], pa.int64())})

    done = cells.df.select(*axes, value).withColumn("_fragment", F.expr(f"`{first}` div {rows}")).groupBy("_fragment").applyInArrow(write, "_fragment long")
    have = {r[0] for r in done.collect()}  # one number for each file
    return [x for k, x in enumerate(manifest([[b - a for a, b in parts], *([n] for n in shape[1:])], [f"{name}-{k:06d}.nc" for k in range(len(parts))], [name], base=folder)) if k in have]
