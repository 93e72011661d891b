"""Line deduplication with levelled, sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, TO_LOWER, forget, free_name, shared_dir, shuffles_cleared, slices, stored

_STRIP, _LOWER = SPACE.encode(), TO_LOWER.tobytes()
KEY = ["h1", "h2"]


def digests(text: bytes, least: int) -> list[bytes | None]:
    """For each line of the text the 128-bit hash of its key, or None where the key has less than `least` code points.

    A key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Empty text is one empty line."""
    out: list[bytes | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        line = line.strip(_STRIP)
        long = len(line) >= least and (len(line) >= 4 * least or line.isascii() or len(line.decode()) >= least)
        out.append(xxhash.xxh3_128_digest(line) if long else None)
    return out


def line_keys(docs: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, keys array<struct<h1, h2>>): the keys of digests() that each row's text holds, each once. Null and empty texts hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [[h for h in dict.fromkeys(digests((t.as_py() or "").encode(), least)) if h] for t in b.column("text")]
            h = np.frombuffer(b"".join(x for k in own for x in k), "<i8").reshape(-1, 2)
            keys = pa.StructArray.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], KEY)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in own])], pa.int32()), keys)], ["doc_id", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, keys array<struct<h1:long,h2:long>>")


class LineRuns:
    """Line keys in levels of sorted runs, for batches that come in falling order of doc_id.

    A run is a table (h1, h2, docs, last) in the shared folder, bucketed and sorted by the key, so that runs are
    joined and merged as they lie, without a shuffle. add() splits a batch by a merge anti-join with the runs: keys
    that are new come with `last`, the largest doc_id that holds them, which is in the batch that brings a key first;
    of known keys only the number of documents is added, and their holders are never the last. When a level holds
    `fan` runs, they are merged into one of the next level, so a key is looked up in few runs."""

    def __init__(self, spark: SparkSession, fan: int = 2) -> None:
        self.spark, self.fan, self.levels = spark, fan, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as aggregated keys are dealt out anyway

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def add(self, own: DataFrame) -> None:
        """own: (h1, h2, docs, last), one row per key of the batch; last: the largest doc_id that holds it."""
        new = own
        for run in (old := [r.where("last is not null").select(*KEY).hint("merge") for r in self.runs()]):
            new = new.join(run, KEY, "left_anti")
        # Only one run has a key's `last`.
        for run in old:
            new = new.unionByName(own.join(run, KEY, "left_semi").withColumn("last", F.lit(None).cast("long")))
        self._put(0, new)

    def _put(self, level: int, run: DataFrame) -> None:
        name = f"lines_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        with shuffles_cleared(self.spark):
            run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        if level == len(self.levels):
            self.levels.append([])
        held = self.levels[level]
        held.append((name, path))
        if len(held) == self.fan:
            self.levels[level] = []
            self._put(level + 1, self._merged(held))
            self._drop(held)

    def _merged(self, held: list[tuple[str, str]]) -> DataFrame:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"docs": "more", "last": "other"})
            docs = (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs")
            return a.join(b.hint("merge"), KEY, "full_outer").select(*KEY, docs, F.coalesce("last", "other").alias("last"))

        return reduce(both, (self.spark.table(name) for name, _ in held))

    def merged(self) -> DataFrame:
        """(h1, h2, docs, last) of every key, from all levels."""
        return self._merged([x for level in self.levels for x in level])

    def _drop(self, held: list[tuple[str, str]]) -> None:
        for name, path in held:
            self.spark.sql(f"DROP TABLE {name}")
            forget(path=path, spark=self.spark)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def dropped_lines(docs: DataFrame, least: int = 20, holders: int = 3, batches: int = 4, fan: int = 2) -> DataFrame:
    """(doc_id, drop array<struct<h1, h2>>): the keys whose lines go, of documents that lose any.

    Keys held by at least `holders` documents lose all their lines but those of the largest doc_id. The documents
    come in `batches`, those of the largest ids first, that LineRuns takes one after another. Hot keys are
    pre-aggregated in each task; the join that finds their documents is one that Spark can split."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")  # null ids hold no line: they neither count nor lose any
    keys = stored(line_keys(docs, least), "lines")
    bounds = keys.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], F.lit(10000))).first()[0] or [] if batches > 1 else []
    batch = sum((F.col("doc_id") <= x).cast("int") for x in sorted(set(bounds))) + F.lit(0)
    again = not keys.groupBy("doc_id").count().where("count > 1").isEmpty()
    each = keys.select("doc_id", batch.alias("batch"), F.explode("keys").alias("key")).select("doc_id", "batch", "key.*")
    runs = LineRuns(spark, fan)
    for k in range(len(set(bounds)) + 1):
        own = each.where(F.col("batch") == k).select("doc_id", *KEY)
        own = own.distinct() if again else own  # rows of one doc_id are one holder
        runs.add(own.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
    common = stored(runs.merged().where(F.col("docs") >= holders).select(*KEY, "last"), "common")
    runs.close()
    gone = each.drop("batch").join(common, KEY).where("doc_id < last")
    return gone.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drop"))


def without_lines(docs: DataFrame, drops: DataFrame, least: int = 20, counts: bool = False) -> DataFrame:
    """docs with text cut to the lines that stay; with counts also n_lines, n_dropped long.

    Text without a dropped line is not changed, null stays null and counts as one line. Other columns stay as they are."""
    drop = free_name(docs, "drop")
    both = docs.join(drops.withColumnRenamed("drop", drop).hint("merge"), "doc_id", "left").select(*docs.columns, drop)
    own = docs.columns
    names = own + ["n_lines", "n_dropped"] * counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, n, less = [], [], []
            for value, gone in zip(b.column("text"), b.column(drop)):
                text = value.as_py()
                lines = (text or "").split("\n")
                n.append(len(lines))
                if gone.is_valid:
                    hashes = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in gone.as_py()}
                    lines = [x for x, h in zip(lines, digests(text.encode(), least)) if h not in hashes]
                    text = "\n".join(lines)
                less.append(n[-1] - len(lines))
                texts.append(text)
            columns = [pa.array(texts, b.column(c).type) if c == "text" else b.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int64()) for x in (n, less)] * counts, names)

    schema = docs.schema
    for name in ["n_lines", "n_dropped"] * counts:
        schema = schema.add(name, "long")
    return both.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, least: int = 20, holders: int = 3, batches: int = 4, fan: int = 2, counts: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of text; see dropped_lines() and without_lines().

    Null and empty texts are one empty line, which is too short to go. Rows without doc_id stay as they are. Rows
    that repeat a doc_id are one holder of their lines, and each loses its own. Other columns stay as they are."""
    return without_lines(docs, dropped_lines(docs, least, holders, batches, fan), least, counts)
