"""Queries that write and read again: files of array formats, containers, streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cells, Construct, Field
from ..operators import fragments
from ..sources import aggregation, container, netcdf3, zarr3
from ..sources.scratch import scratch
from ..sources.tables import labels, masked_cells, table, whole_cells
from ..streaming import reductions
from .arrays import M, Q
from .registry import query


@query(f"WITH {M} SELECT i, j, value::DOUBLE AS value FROM m")
def netcdf_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, in eight files, or in more where these would pass 4096 vectors."""
    c = masked_cells(spark, sf)
    c = c.select(c.v.cast("double"))
    entries = netcdf3.write_fragments(c, scratch(spark, "netcdf"), rows=max(1, min(4096, -(-c.shape[0] // 8))))
    return aggregation.read(spark, entries, c.axes, c.shape).frame()


def _eighth(c: Cells, most: int = 4096) -> int:
    """Rows of an eighth of an array, or fewer."""
    return max(1, min(most, -(-c.shape[0] // 8)))


def _parted(spark: SparkSession, sf: str) -> Cells:
    """All vectors as one aggregation dataset: classic files, every second one in kilometres, then Zarr arrays of narrower numbers, then a constant."""
    c = whole_cells(spark, sf)
    n, width = c.shape
    rows = _eighth(c)
    folder = scratch(spark, "parts")
    metres = netcdf3.write_fragments(replace(c.select(c.v.cast("double")), units="m"), f"{folder}/m", rows=rows)
    kilometres = netcdf3.write_fragments(replace(c.select(c.v / 1000.0), units="km"), f"{folder}/km", rows=rows)
    entries = [kilometres[k] if k % 2 else x for k, x in enumerate(metres)]
    at = n // 2 // rows * rows  # from here on Zarr
    tail = replace(c, df=c.df.where(F.col("i") >= at).withColumn("i", F.col("i") - at), shape=(n - at, width)).select(c.v.cast("int"))
    zarr3.write(tail, f"{folder}/tail", (max(1, rows // 3), width), "int32")
    entries = [x for x in entries if x["start"][0] < at] + [{"start": [at, 0], "stop": [n, width], "uri": f"{folder}/tail", "units": "m"}, {"start": [n, 0], "stop": [n + 2, width], "value": -1}]
    return aggregation.read(spark, entries, ("i", "j"), (n + 2, width), "m")


_PARTED = f"{Q}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), p AS (SELECT i, j, value FROM q UNION ALL SELECT n + k, j, -1 FROM n, range(2) a(k), (SELECT DISTINCT j FROM q) b)"


@query(f"WITH {_PARTED} SELECT i, j, round(value::DOUBLE, 6) AS value FROM p")
def aggregated_fragments(spark: SparkSession, sf: str) -> DataFrame:
    c = _parted(spark, sf)
    return c.frame().select("i", "j", F.round("value", 6).alias("value"))


@query(f"WITH {_PARTED} SELECT i, j, round(value::DOUBLE, 6) AS value FROM p, n WHERE i >= n // 3 AND i < n // 3 + n // 4 AND j BETWEEN 5 AND 9")
def fragments_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Comparisons of positions choose the fragments that are opened."""
    c = _parted(spark, sf)
    n = c.shape[0] - 2
    return c.frame().where(F.col("i").between(n // 3, n // 3 + n // 4 - 1) & F.col("j").between(5, 9)).select("i", "j", F.round("value", 6).alias("value"))


@query("WITH n AS (SELECT greatest((max(vec_id) + 1) // 50, 1) AS step FROM embeddings) SELECT vec_id AS i, (vec_id // step)::DOUBLE AS value FROM embeddings, n")
def aggregated_constants(spark: SparkSession, sf: str) -> DataFrame:
    """The number of the fiftieth that a vector is in, written nowhere: fragments of one value become constants of the manifest."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"))
    n = (rows.agg(F.max("i")).first()[0] or 0) + 1
    step = max(n // 50, 1)
    found = fragments.constants(rows.withColumn("fragment", F.expr(f"i div {step}")).withColumn("value", F.col("fragment") * 1.0), "fragment", "value")
    entries = fragments.manifest([[min(step, n - a) for a in range(0, n, step)]], unique_values=[found.get(k) for k in range(-(-n // step))])
    return aggregation.read(spark, entries, ("i",), (n,)).frame().join(rows, "i", "left_semi")


@query(f"WITH {M} SELECT i, j, value::DOUBLE AS value FROM m")
def zarr_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, in eight rows of chunks, or in more where these would pass 4096 vectors."""
    c = masked_cells(spark, sf)
    path = scratch(spark, "zarr")
    zarr3.write(c.select(c.v.cast("double")), path, (_eighth(c), 40))
    return zarr3.read(spark, path).frame()


@query(f"WITH {M} SELECT i, j, value FROM m")
def zarr_shards(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, as whole numbers, in shards of twelve chunks each."""
    c = masked_cells(spark, sf)
    path, rows = scratch(spark, "zarr"), _eighth(c, 1024)
    zarr3.write(c, path, (rows, 20), "int64", shards=(3 * rows, 80))
    return zarr3.read(spark, path).frame()


@query(f"WITH {M} SELECT i, j, value FROM m")
def zarr_version2(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    path = scratch(spark, "zarr")
    zarr3.write(c.select(c.v.cast("int")), path, (_eighth(c), 25), "int32", version=2)
    return zarr3.read(spark, path).frame().withColumn("value", F.col("value").cast("long"))


def _field(spark: SparkSession, sf: str) -> Field:
    """All vectors with their labels."""
    c, label = masked_cells(spark, sf), labels(spark, sf)
    return Field(replace(c, units="1"), (Construct("i", "domain_axis", size=c.shape[0]), Construct("auxiliarycoordinate0", "auxiliary_coordinate", ("i",), {"long_name": "label"}, data=label)))


@query(f"WITH {M} SELECT i, j, value, label FROM m JOIN embeddings ON vec_id = i")
def container_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "field")
    container.save(_field(spark, sf), path)
    f = container.load(spark, path)
    return f.data.df.join(f.construct("long_name=label").data.df.withColumnRenamed("value", "label"), "i").select("i", "j", "value", "label")


@query(f"WITH {M} SELECT i, j, value FROM m UNION ALL SELECT i + (SELECT max(vec_id) + 1 FROM embeddings), j, value FROM m")
def container_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "field")
    f = _field(spark, sf)
    container.save(f, path)
    return container.append(f, path, "i").data.frame()


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, max(value) AS max, min(value) AS min, count(value) AS count FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    events = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = reductions.windowed(stream, "ts", "value", "6 hours", "1 day", ["event_type"])
    return reductions.run_updating(out, spark, scratch(spark, "stream"), ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "max", "min", "count")
