"""Zarr arrays in a folder, versions 2 and 3: one file per chunk or per shard of chunks, read and written in parallel."""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import json
import lzma
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Cells
from .netcdf3 import ARROW, as_cells
from .ranges import AxisRanges, Pieces, dealt, known
from .scratch import local

#: Data types of the format and of Spark.
TYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "bool": "boolean"}
#: Fixed value: offset and size of a chunk that a shard does not hold.
ABSENT = 2**64 - 1
#: Fixed value: the reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


@cache
def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ CASTAGNOLI if x & 1 else x >> 1
        out.append(x)
    return out


def crc32c(data: bytes) -> int:
    """The checksum of a shard's index."""
    table, x = _crc_table(), 0xFFFFFFFF
    for b in data:
        x = table[(x ^ b) & 255] ^ x >> 8
    return x ^ 0xFFFFFFFF


def references(path: str) -> dict | None:
    """The references of a file that says where the chunks of arrays lie in other files; None for a folder."""
    path = local(path)
    if os.path.isdir(path):
        return None
    with open(path) as f:
        found = json.load(f)
    return found.get("refs", found)


def _text(path: str, name: str, refs: dict | None) -> dict | None:
    """A small JSON file of an array or group, from its folder or from references."""
    if refs is not None:
        found = refs.get(name)
        return json.loads(found) if isinstance(found, str) else found
    file = f"{local(path)}/{name}"
    if not os.path.exists(file):
        return None
    with open(file) as f:
        return json.load(f)


def arrays(path: str) -> tuple[dict[str, dict], dict]:
    """(the descriptions of the arrays of a group by name, its attributes); of references too. An array alone is a group of one, named after its folder."""
    refs, folder = references(path), local(path)
    if refs is not None:
        names = sorted(k.rpartition("/")[0] for k in refs if k.endswith("/.zarray"))
    else:
        names = sorted(x for x in os.listdir(folder) if any(os.path.exists(f"{folder}/{x}/{y}") for y in ("zarr.json", ".zarray")))
        if not names and (own := _text(path, "zarr.json", None) or _text(path, ".zarray", None)) and own.get("node_type") != "group":
            return {os.path.basename(folder.rstrip("/")): metadata(path)}, {}
    attributes = (_text(path, "zarr.json", refs) or {}).get("attributes") or _text(path, ".zattrs", refs) or {}
    return {x: metadata(path, x, refs) for x in names}, attributes


def metadata(path: str, name: str = "", refs: dict | None = None) -> dict:
    """The description of an array as version 3 has it, that of version 2 put in its terms."""
    at = f"{name}/" if name else ""
    new = _text(path, f"{at}zarr.json", refs)
    if new is not None:
        if new.get("node_type") != "array" or new.get("zarr_format") != 3:
            raise ValueError(f"{path} is no array of version 3")
        return new
    old, attributes = _text(path, f"{at}.zarray", refs), _text(path, f"{at}.zattrs", refs) or {}
    if old is None:
        raise FileNotFoundError(f"no array {name} in {path}")
    if old.get("filters"):
        raise ValueError(f"filters {old['filters']} are not supported")
    dtype, packer = np.dtype(old["dtype"]), old.get("compressor")
    codecs = [{"name": "transpose", "configuration": {"order": list(range(len(old["shape"])))[::-1]}}] if old.get("order") == "F" else []
    codecs += [{"name": "bytes", "configuration": {"endian": "big" if old["dtype"][0] == ">" else "little"}}, *([{"name": packer["id"]}] if packer else [])]
    return {
        "zarr_format": 2, "node_type": "array", "shape": old["shape"], "data_type": dtype.name, "fill_value": old["fill_value"], "codecs": codecs,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": old["chunks"]}}, "chunk_key_encoding": {"name": "v2", "configuration": {"separator": old.get("dimension_separator", ".")}},
        "dimension_names": attributes.pop("_ARRAY_DIMENSIONS", None), "attributes": attributes,
    }


UNPACK = {"gzip": gzip.decompress, "zlib": zlib.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "zstd": lambda raw: zstandard.ZstdDecompressor().decompressobj().decompress(raw)}


def axes_of(m: dict) -> list[str]:
    return [n or f"dim{k}" for k, n in enumerate(m.get("dimension_names") or [None] * len(m["shape"]))]


class Stored:
    """An array as it lies there. Chunks of a shard are found by its index and read by byte ranges; absent chunks hold the fill value."""

    def __init__(self, path: str, meta: dict | None = None, mask: bool = True, name: str = "", refs: dict | None = None) -> None:
        self.path, self.mask, self.refs = local(path), mask, refs
        self.name = f"{name}/" if name else ""
        self.meta = m = meta or metadata(path, name, refs)
        self.shape, self.attributes = tuple(m["shape"]), m.get("attributes", {})
        self.size = self.outer = tuple(m["chunk_grid"]["configuration"]["chunk_shape"])
        self.codecs, self.shard = m["codecs"], None
        if self.codecs and self.codecs[0]["name"] == "sharding_indexed":
            self.shard = self.codecs[0]["configuration"]
            self.size, self.codecs = tuple(self.shard["chunk_shape"]), self.shard["codecs"]
        order = next((c.get("configuration", {}).get("endian", "little") for c in self.codecs if c["name"] == "bytes"), "little")
        self.dtype = np.dtype(m["data_type"]).newbyteorder("<" if order == "little" else ">")
        fill = m["fill_value"]
        self.fill = None if fill is None else np.array({"Infinity": np.inf, "-Infinity": -np.inf}.get(fill, np.nan) if isinstance(fill, str) else fill).astype(self.dtype)

    def file(self, at: tuple[int, ...]) -> str:
        coding = self.meta.get("chunk_key_encoding", {"name": "default"})
        apart = coding.get("configuration", {}).get("separator", "." if coding["name"] == "v2" else "/")
        return f"{self.name}{apart.join(map(str, at)) or '0' if coding['name'] == 'v2' else apart.join(['c', *map(str, at)])}"

    def open(self, at: tuple[int, ...]) -> BinaryIO | None:
        """The bytes of a chunk or shard; None if there are none."""
        key = self.file(at)
        if self.refs is None:
            return open(f"{self.path}/{key}", "rb") if os.path.exists(f"{self.path}/{key}") else None
        found = self.refs.get(key)
        if found is None:
            return None
        if isinstance(found, str):
            return io.BytesIO(base64.b64decode(found[7:]) if found.startswith("base64:") else found.encode())
        target = found[0] if "://" in found[0] or found[0].startswith("/") else os.path.join(os.path.dirname(self.path), found[0])
        with open(local(target), "rb") as f:
            if len(found) == 3:
                f.seek(found[1])
                return io.BytesIO(f.read(found[2]))
            return io.BytesIO(f.read())

    def _decoded(self, raw: bytes) -> np.ndarray:
        turned = None
        for c in reversed(self.codecs):
            if c["name"] in UNPACK:
                raw = UNPACK[c["name"]](raw)
            elif c["name"] == "crc32c":
                raw = _checked(raw)
            elif c["name"] == "transpose":
                turned = c["configuration"]["order"]
            elif c["name"] != "bytes":
                raise ValueError(f"codec {c['name']} is not supported")
        if turned is None:
            return np.frombuffer(raw, self.dtype).reshape(self.size)
        return np.frombuffer(raw, self.dtype).reshape([self.size[d] for d in turned]).transpose(np.argsort(turned))

    def _index(self, f: object, counts: tuple[int, ...]) -> np.ndarray:
        """(offset, size) of every chunk in a shard."""
        checked = any(c["name"] == "crc32c" for c in self.shard.get("index_codecs", []))
        size = 16 * int(np.prod(counts)) + 4 * checked
        if self.shard.get("index_location", "end") == "end":
            f.seek(-size, os.SEEK_END)
        raw = f.read(size)
        return np.frombuffer(_checked(raw) if checked else raw, "<u8").reshape(*counts, 2)

    def box(self, low: list[int], high: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Values between two corners, and which are missing."""
        x = np.full([b - a for a, b in zip(low, high)], 0 if self.fill is None else self.fill, self.dtype)
        counts = tuple(o // c for o, c in zip(self.outer, self.size))
        for at in product(*(range(a // o, -(-b // o)) for a, b, o in zip(low, high, self.outer))):
            there = self.open(at)
            if there is None:
                continue
            with there as f:
                index = self._index(f, counts) if self.shard else None
                begin = [k * o for k, o in zip(at, self.outer)]
                for inner in product(*(range(max(a - s, 0) // c, -(-min(b - s, o) // c)) for a, b, s, o, c in zip(low, high, begin, self.outer, self.size))):
                    if index is not None:
                        offset, size = (int(n) for n in index[inner])
                        if offset == ABSENT:
                            continue
                        f.seek(offset)
                        data = self._decoded(f.read(size))
                    else:
                        data = self._decoded(f.read())
                    corner = [s + k * c for s, k, c in zip(begin, inner, self.size)]
                    a = [max(p, q) for p, q in zip(low, corner)]
                    b = [min(p, q + c) for p, q, c in zip(high, corner, self.size)]
                    x[tuple(slice(p - q, r - q) for p, r, q in zip(a, b, low))] = data[tuple(slice(p - q, r - q) for p, r, q in zip(a, b, corner))]
        if not self.mask or self.fill is None:
            gone = np.zeros(x.shape, bool)
        else:
            gone = np.isnan(x) if self.fill != self.fill else x == self.fill
        return x.astype(x.dtype.newbyteorder("=")), gone


def _checked(raw: bytes) -> bytes:
    if crc32c(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("the checksum does not fit")
    return raw[:-4]


class Zarr3(DataSource):
    """spark.read.format("zarr3").load(folder): a row per cell; a partition is a chunk or a shard, or a few small ones. Absent chunks hold the fill value, and fill values are NULL unless mask is false. Comparisons of axis columns choose chunks. With the option `variable` the path is that of a group, or of a file of references. last=array makes arrays of the last dimension."""

    @classmethod
    def name(cls) -> str:
        return "zarr3"

    def _found(self) -> tuple[dict, dict | None]:
        name, path = self.options.get("variable", ""), self.options["path"]
        refs = references(path)
        # Of references only those of this array go to the tasks.
        refs = {k: v for k, v in refs.items() if k.startswith(f"{name}/")} if refs is not None else None
        return metadata(path, name, refs), refs

    def schema(self) -> str:
        m, _ = self._found()
        kind, packed = TYPES[m["data_type"]], self.options.get("last") == "array"
        return ", ".join([*(f"`{a}` bigint" for a in axes_of(m)[: -1 if packed else None]), f"value {f'array<{kind}>' if packed else kind}"])

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(*self._found(), dict(self.options))


class Reader(AxisRanges, DataSourceReader):
    def __init__(self, meta: dict, refs: dict | None, options: dict) -> None:
        super().__init__(axes_of(meta), meta["shape"])
        self.meta, self.refs, self.options = meta, refs, options
        self.packed = options.get("last") == "array"

    def partitions(self) -> list[InputPartition]:
        m = self.meta
        size, shape = m["chunk_grid"]["configuration"]["chunk_shape"], m["shape"]
        # Only chunks that hold wanted positions are listed.
        places = product(*(range(max(a, 0) // c, -(-min(b, n) // c)) for a, b, c, n in zip(self.low, self.high, size, shape)))
        if self.packed:  # arrays are whole
            places = sorted({at[:-1] for at in places})
            places, size = [(*at, 0) for at in places], [*size[:-1], shape[-1]]
        boxes = [(at, self.wanted([k * c for k, c in zip(at, size)], [min(k * c + c, n) for k, c, n in zip(at, size, shape)])) for at in places]
        pieces = [(at, *box) for at, box in boxes if box]
        step = int(self.options.get("cells", 1 << 20))
        return dealt(pieces, max(step, max((int(np.prod([q - p for p, q in zip(a, b)])) for _, a, b in pieces), default=1)))

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        array = Stored(self.options["path"], self.meta, self.options.get("mask", "true") == "true", self.options.get("variable", ""), self.refs)
        axes = self.axes[:-1] if self.packed else self.axes
        for _, start, stop in partition.pieces:
            yield as_cells(*array.box(list(start), list(stop)), start[: len(axes)], axes, ARROW[TYPES[self.meta["data_type"]]], self.packed)


def read(spark: SparkSession, path: str, variable: str = "", **options: str) -> Cells:
    """An array alone, or one of a group or of a file of references."""
    m = metadata(path, variable, references(path))
    known(spark, Zarr3)
    df = spark.read.format("zarr3").options(**options, **({"variable": variable} if variable else {})).load(path)
    own = slice(-1) if options.get("last") == "array" else slice(None)
    noted = m.get("attributes", {})
    return Cells(df, tuple(axes_of(m)[own]), tuple(m["shape"][own]), units=noted.get("units"), calendar=noted.get("calendar"), fill=m["fill_value"])


def write(cells: Cells, path: str, chunks: tuple[int, ...], data_type: str = "float64", fill: float | int | None = None, compress: int = 3, shards: tuple[int, ...] | None = None, version: int = 3) -> None:
    """Cells as an array of this format: shuffled once, by file; each file is written by the task that holds its cells.

    With `shards`, multiples of `chunks`, a file holds all chunks of a shard and an index of them (version 3 only); a chunk
    without values is left out. Without a fill value, it is NaN for floating point numbers and else the least of the type."""
    folder = local(path)
    os.makedirs(folder, exist_ok=True)
    dtype = np.dtype(data_type).newbyteorder("<")
    if fill is None:
        fill = float("nan") if dtype.kind == "f" else False if dtype.kind == "b" else int(np.iinfo(dtype).min)
    outer = shards or chunks
    if any(o % c for o, c in zip(outer, chunks)) or shards and version == 2:
        raise ValueError(f"shards {shards} are no multiples of chunks {chunks}, or of version 2")
    said = ("NaN" if fill != fill else "Infinity" if fill > 0 else "-Infinity") if isinstance(fill, float) and not np.isfinite(fill) else fill
    packed = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": compress, "checksum": False}}]
    noted = {"units": cells.units} if cells.units else {}
    meta: dict = {
        "zarr_format": 3, "node_type": "array", "shape": list(cells.shape), "data_type": data_type, "fill_value": said,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(outer)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunks), "codecs": packed, "index_codecs": [packed[0], {"name": "crc32c"}], "index_location": "end"}}] if shards else packed,
        "dimension_names": list(cells.axes), "attributes": noted,
    }
    files = [("zarr.json", meta)]
    if version == 2:
        old = {"zarr_format": 2, "shape": list(cells.shape), "chunks": list(chunks), "dtype": dtype.str, "fill_value": said, "order": "C", "filters": None, "compressor": {"id": "zstd", "level": compress}}
        files = [(".zarray", old), (".zattrs", {"_ARRAY_DIMENSIONS": list(cells.axes), **noted})]
        meta["chunk_key_encoding"] = {"name": "v2", "configuration": {"separator": "."}}
    array = Stored(path, meta)
    axes, value = cells.axes, cells.value
    counts = tuple(o // c for o, c in zip(outer, chunks))

    def save(t: pa.Table) -> pa.Table:
        at = [t.column(f"_{a}")[0].as_py() for a in axes]
        own = t.filter(pa.compute.is_valid(t.column(value)))
        x, here = np.full(outer, fill, dtype), np.zeros(outer, bool)
        place = tuple(own.column(a).to_numpy() - k * o for a, k, o in zip(axes, at, outer))
        x[place], here[place] = own.column(value).to_numpy(), True
        pack = zstandard.ZstdCompressor(level=compress).compress
        if shards:
            index, body = np.full((*counts, 2), ABSENT, "<u8"), []
            end = 0
            for inner in product(*map(range, counts)):
                box = tuple(slice(k * c, k * c + c) for k, c in zip(inner, chunks))
                if here[box].any():
                    body.append(pack(np.ascontiguousarray(x[box]).tobytes()))
                    index[inner] = end, len(body[-1])
                    end += len(body[-1])
            raw = b"".join(body) + index.tobytes() + crc32c(index.tobytes()).to_bytes(4, "little")
        else:
            raw = pack(x.tobytes())
        target = f"{folder}/{array.file(tuple(at))}"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(f"{target}.{os.getpid()}", "wb") as f:
            f.write(raw)
        os.replace(f"{target}.{os.getpid()}", target)
        return pa.table({"n": pa.array([own.num_rows], pa.int64())})

    keyed = cells.df.select(*axes, value, *(F.expr(f"`{a}` div {o}").alias(f"_{a}") for a, o in zip(axes, outer)))
    keyed.groupBy(*(f"_{a}" for a in axes)).applyInArrow(save, "n long").count()
    for name, content in files:
        with open(f"{folder}/{name}", "w") as f:
            json.dump(content, f)
