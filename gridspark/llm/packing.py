"""Packing of token ids into fixed windows: concatenate and cut."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def library(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file of byte-level BPE. Its merges are in the order of the ids, so ids serve as ranks; special strings in texts are ids, as that library has it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    of = _byte_of_char()
    ranks = {bytes(of[c] for c in token): id for token, id in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def tokenised(docs: DataFrame, path: str, pattern: str, end: int = 1) -> DataFrame:
    """Pass one: (doc_id, ids binary, n, part, at): ids (unsigned 32-bit, `end` appended), and where they begin among those of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library(path, pattern)
        part, at, tail = TaskContext.get().partitionId(), 0, np.array([end], "<u4").tobytes()
        for b in slices(batches):
            ids = [enc.encode_to_numpy(t.as_py() or "", allowed_special="all").astype("<u4", copy=False).tobytes() + tail for t in b.column("text")]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(start)], ["doc_id", "ids", "n", "part", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, n long, part long, at long")


def pack(docs: DataFrame, path: str, pattern: str, window: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Pass one writes every document's ids with their place among those of its task; totals of the tasks, one row
    each, are summed up in order to give each task its global offset. Pass two cuts the one long sequence at
    multiples of `window`; a document that crosses a cut gives a piece on each side. Only the last sequence is
    padded. Nothing but the task totals is shuffled; broadcast is one row per task of pass one.

    Null and empty texts are one `end` id. Rows without or with repeated doc_id are packed like others. Empty tables give no rows."""
    ids = stored(tokenised(docs, path, pattern, end), "ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    placed = ids.join(F.broadcast(before), "part").select("doc_id", "ids", (F.col("before") + F.col("at")).alias("place"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for id, x, place in zip(b.column("doc_id").to_pylist(), b.column("ids"), b.column("place").to_pylist()):
                x = memoryview(x.as_buffer())
                n, at = len(x) // 4, 0
                while at < n:
                    size = min(n - at, window - (place + at) % window)
                    piece = x[4 * at : 4 * (at + size)]
                    out.append((id, at, size, zlib.crc32(piece), n, (place + at) // window, (place + at) % window, *([bytes(piece)] * with_ids)))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))], names) if out else pa.RecordBatch.from_pylist([], pa.schema([(k, pa.binary() if k == "ids" else pa.int64()) for k in names]))

    return placed.mapInArrow(run, ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k in names))
