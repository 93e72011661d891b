"""A folder all executors share, for what a query writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is not set in a temporary folder, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="gridspark-")
        base = _own[app]
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df from storage, for what several jobs or variables are made of."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local(path: str) -> str:
    """A path that open() takes; other schemes need a file system of their own."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is not a mounted folder")
    path = path.removeprefix("file://")
    return path.removeprefix("file:")
