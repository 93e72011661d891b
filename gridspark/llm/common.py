"""What several operators share: shared storage, text as bytes in numpy, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that the contracts name: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
TO_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


_own: dict[str, str] = {}
_CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one of this application, on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="gridspark-")
    return _own[app]


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes a job's shuffle files when it ends, not when the driver's garbage is collected."""
    was = spark.conf.get(_CLEAR)
    spark.conf.set(_CLEAR, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAR, was)


def stored(df: DataFrame, what: str = "step") -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts lineage and survives lost executors.

    What follows reads the table, so the shuffles that made it are cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with shuffles_cleared(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame, path: str | None = None, spark: SparkSession | None = None) -> None:
    """Deletes what stored() has written for these frames, or what lies at the path, once nothing reads it any more."""
    for where, session in [(getattr(df, "stored_at", None), df.sparkSession) for df in frames] + [(path, spark)]:
        if where:
            p = session._jvm.org.apache.hadoop.fs.Path(where)
            p.getFileSystem(session._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it where df has a column of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece hold about `most` bytes (a longer text stands alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    o = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
    return d, o - o[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), BASE if which == "up" else UNBASE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 20:  # those of very long texts are not kept
            _powers[which] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; span_hash() takes spans from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * _power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    """Hashes of the bytes start..stop: equal bytes have equal hashes wherever they stand."""
    return mix((prefix[stop] - prefix[start]) * _power("down", len(prefix))[start])


def row_tag(text: str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def xx128(*columns: Column | str) -> list[Column]:
    """Two independent 64-bit hashes: equality of 128 bits stands for equality of the columns."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps until neither changes an edge. A step makes one edge of each, so it never
    grows; nothing goes to the driver but a count. Minima are aggregated before they are shuffled, and the joins have
    one row a node on one side, so Spark can split hot nodes. Nodes without edges are absent. Repeated edges, loops and
    no edges are fine."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = now.join(least.hint("merge"), "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = F.col("b") == F.col("m")
        small = large.join(low.hint("merge"), "a").select(F.when(kept, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"), (F.col("moved") | ~kept).alias("moved"))
        counted = Observation()
        new = stored(small.observe(counted, F.count_if("moved").alias("moved")).select("a", "b"), "edges")
        moved = counted.get["moved"]
        forget(now)
        now = new
        if not moved:
            break
    stars = new.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).distinct()
