"""Unlimited axes as streams: reductions over time windows, and slices appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, value: str, width: str, late: str, by: list[str] | None = None) -> DataFrame:
    """max, min, sum and count of each window of time; rows later than `late` are left out, and state older than that is dropped."""
    cells = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *(by or []))
    out = cells.agg(F.max(value).alias("max"), F.min(value).alias("min"), F.sum(value).alias("sum"), F.count(value).alias("count"))
    return out.select(F.col("w.start").alias("start"), *(by or []), "max", "min", "sum", "count")


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is now, in as many batches as its source makes, into Parquet at `path`; the checkpoint beside it lets a later call go on."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_updating(stream: DataFrame, spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The same for results that still change: each batch writes the rows of `keys` that it changed, and of each the newest is read.

    Rows behind the watermark are left out, and the state of windows behind it is dropped, so state stays bounded.
    A batch that is run again writes the same folder."""

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{batch}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    written = spark.read.schema(stream.schema.add("_batch", "long")).option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_new"))
    return newest.select(*(f"_new.{c}" if c in rest else c for c in stream.columns))
