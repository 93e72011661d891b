"""Byte-level BPE: encoding in overlapping chunks, decoding, and ids for packing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Words(dict):
    """Ids (little-endian unsigned 32-bit) of stretches of text that begin at sure pre-token boundaries; forgets all when full."""

    def __init__(self, encode, most: int = 150_000) -> None:
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = np.asarray(self.encode(word), "<u4").tobytes()
        if len(word) < 64:
            self[word] = out
        return out


class Codec:
    """One vocabulary of ranks with its pattern; lives once in each Python worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.words, self.spaced = Words(self.library.encode_ordinary), Words(lambda w: self.library.encode_ordinary(" " + w))
        self.blank = regex.compile(r"\s\s")

    def starts(self, text: str) -> list[int]:
        """Where pre-tokens begin. From a boundary on, matching depends on what follows only."""
        return [m.start() for m in self.pattern.finditer(text)]

    def pieces(self, text: str, stop: int | None) -> bytes:
        """Ids of the pre-tokens that begin before `stop`; what follows only decides where they end."""
        at = self.starts(text)
        return b"".join(self.words[text[a:b]] for a, b in zip(at, [*at[1:], len(text)]) if stop is None or a < stop)

    def encode(self, text: str) -> bytes:
        """Between a character that is no white space and a space there is always a boundary, and so around a lone
        newline; the stretches between them are looked up. Texts with other white space in a row are encoded as they are."""
        if self.blank.search(text):
            return np.asarray(self.library.encode_ordinary(text), "<u4").tobytes()
        out, words, spaced = [], self.words, self.spaced
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(words["\n"])
            first, *rest = line.split(" ")
            if first:
                out.append(words[first])
            elif not rest:
                continue
            out.extend(map(spaced.__getitem__, rest))
        return b"".join(out)


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 1 << 15, overlap: int = 512) -> DataFrame:
    """(doc_id, ids binary) of every row of docs (doc_id, text), ids as little-endian unsigned 32-bit numbers.

    A text of at most `chunk` characters is encoded where it is read. Longer ones are cut into chunks that overlap
    by `overlap` on both sides; the chunks are dealt out and pre-tokenised apart. Two neighbours are stitched at the
    first pre-token boundary both see in their overlap, as from a common boundary on they agree. Each chunk then
    encodes the pieces it owns, and the ids of a text are joined in order. A text of which some overlap shows no
    common boundary (a pre-token longer than the overlap) is encoded as a whole. Only long texts are shuffled.

    Null and empty text give no ids. Rows without or with repeated doc_id are encoded like others. Empty tables give no rows."""
    docs = docs.select("doc_id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.encode(t.as_py() or "") for t in b.column("text")], pa.binary())], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for id, t in zip(b.column("doc_id"), b.column("text")):
                t, row = t.as_py(), row + 1
                n = -(-len(t) // chunk)
                base = [max(0, k * chunk - overlap) for k in range(n)]
                text = [t[base[k] : (k + 1) * chunk + overlap] for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([id.as_py()] * n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([row] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(base, pa.int64()), pa.array(text, pa.string())],
                    ["doc_id", "part", "row", "k", "base", "text"],
                )

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            head, tail = [], []
            for k, base, t in zip(b.column("k").to_pylist(), b.column("base").to_pylist(), b.column("text")):
                t = t.as_py()
                edge = (k + 1) * chunk  # of this chunk and the next
                at = [base + x for x in c.starts(t) if x < len(t) - 4]  # what follows the end can move the last ones
                head.append([x for x in at if k * chunk - overlap < x < k * chunk + overlap] if k else [])
                tail.append([x for x in at if edge - overlap < x < edge + overlap])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], [*b.schema.names, "head", "tail"])

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids, core = [], []
            for k, base, t, start, stop, ok in zip(*(b.column(x).to_pylist() for x in ("k", "base", "text", "start", "stop", "ok"))):
                ids.append(c.pieces(t[start - base :], None if stop is None else stop - start) if ok else None)
                core.append(None if ok else t[k * chunk - base : (k + 1) * chunk - base])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "part", "row", "k")), pa.array(ids, pa.binary()), pa.array(core, pa.string())], ["doc_id", "part", "row", "k", "ids", "core"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for id, pieces in zip(b.column("doc_id").to_pylist(), b.column("pieces")):
                pieces = pieces.as_py()
                ids = b"".join(p["ids"] for p in pieces) if pieces[0]["core"] is None else c.encode("".join(p["core"] for p in pieces))
                yield pa.RecordBatch.from_arrays([pa.array([id], pa.int64()), pa.array([ids], pa.binary())], ["doc_id", "ids"])

    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(whole, "doc_id long, ids binary")
    pieces = docs.where(F.length("text") > chunk).mapInArrow(cut, "doc_id long, part int, row int, k int, base long, text string").repartition("part", "row", "k")
    seen = pieces.mapInArrow(boundaries, "doc_id long, part int, row int, k int, base long, text string, head array<long>, tail array<long>")
    text = Window.partitionBy("part", "row")
    order = text.orderBy("k")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    stitched = (
        seen.withColumn("last", F.lead("k").over(order).isNull())
        .withColumn("stop", F.when(~F.col("last"), meet))
        .withColumn("start", F.coalesce(F.lag("stop").over(order), F.lit(0).cast("long")))
        .withColumn("ok", F.min(F.col("last") | F.col("stop").isNotNull()).over(text))
    )
    long = stitched.select("doc_id", "part", "row", "k", "base", "text", "start", "stop", "ok").mapInArrow(owned, "doc_id long, part int, row int, k int, ids binary, core string")
    long = long.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids", "core"))).alias("pieces"))
    return short.unionByName(long.select("doc_id", "pieces").mapInArrow(joined, "doc_id long, ids binary"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes of the ids, joined. Bytes need not be valid UTF-8 when ids were cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path).__getitem__
        for b in slices(batches, 4 << 20, "ids"):
            out = [b"".join(map(table, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): decoded as decode() does, with only digests leaving the task (each chained Python step is a process of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        table, decimal = tokens.__getitem__, [b"%d" % i for i in range(len(tokens))].__getitem__
        for b in slices(batches, 4 << 20, "ids"):
            n, ids, text = [], [], []
            for x in b.column("ids"):
                a = np.frombuffer(x.as_py() or b"", "<u4").tolist()
                n.append(len(a))
                ids.append(hashlib.sha256(b" ".join(map(decimal, a))).hexdigest())
                text.append(hashlib.sha256(b"".join(map(table, a))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
