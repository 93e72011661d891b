"""The driver's tables as fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cells
from ..operators.cells import from_packed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str) -> Cells:
    """A field on (i, j): vector by component."""
    df = table(spark, sf_dir, "embeddings")
    last, width = df.agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    return from_packed(df, {"i": "vec_id"}, "embedding", "j", (0 if last is None else last + 1, 0 if width is None else width))


def whole_cells(spark: SparkSession, sf_dir: str) -> Cells:
    """The same in 256ths, as whole numbers."""
    c = embedding_cells(spark, sf_dir)
    return c.select(F.floor(c.v.cast("double") * 256))


def masked_cells(spark: SparkSession, sf_dir: str) -> Cells:
    """Whole numbers, those divisible by 7 missing."""
    c = whole_cells(spark, sf_dir)
    return c.select(F.when(c.v % 7 != 0, c.v))


def labels(spark: SparkSession, sf_dir: str) -> Cells:
    """The auxiliary coordinate of the vectors."""
    df = table(spark, sf_dir, "embeddings")
    return Cells(df.select(F.col("vec_id").alias("i"), F.col("label").alias("value")), ("i",), (df.count(),))
