"""Fields in a folder of Parquet tables: the cells, every construct's cells, and a description."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Cells, Construct, Field


def _described(c: Cells) -> dict:
    return {"axes": c.axes, "shape": c.shape, "value": c.value, "units": c.units, "calendar": c.calendar, "fill": c.fill, "hardmask": c.hardmask}


def save(field: Field, path: str, mode: str = "overwrite", codec: str = "zstd", rows_per_file: int = 0, omit_data: bool = False) -> None:
    """Parquet with the cells sorted by their first axis in each file, so that sub-spaces skip row groups. With omit_data only metadata keep their cells."""
    spark = field.data.df.sparkSession

    def put(c: Cells, name: str) -> None:
        df = c.frame() if name != "data" or not omit_data else c.frame().limit(0)
        df = df.sortWithinPartitions(*c.axes) if c.axes else df
        df.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/{name}")

    put(field.data, "data")
    rows = [("", "field", json.dumps({"properties": field.properties, "data": _described(field.data)}))]
    for c in field.constructs:
        own = {k: getattr(c, k) for k in ("key", "type", "axes", "properties", "ncvar", "ncdim", "size", "measure", "method", "cell", "connectivity", "coordinates", "terms")}
        if c.data is not None:
            put(c.data, c.key)
            own["data"] = _described(c.data)
        if c.bounds is not None:
            c.bounds.write.mode(mode).parquet(f"{path}/{c.key}-bounds")
            own["bounds"] = True
        rows.append((c.key, c.type, json.dumps(own)))
    spark.createDataFrame(rows, "key string, type string, text string").coalesce(1).write.mode(mode).parquet(f"{path}/_catalogue")


def load(spark: SparkSession, path: str) -> Field:
    def cells(d: dict, name: str) -> Cells:
        return Cells(spark.read.parquet(f"{path}/{name}"), tuple(d["axes"]), tuple(d["shape"]), d["value"], d["units"], d["calendar"], d["fill"], d["hardmask"])

    out, constructs = None, []
    for r in spark.read.parquet(f"{path}/_catalogue").orderBy(F.col("key")).collect():
        d = json.loads(r["text"])
        if r["type"] == "field":
            out = Field(cells(d["data"], "data"), properties=d["properties"])
            continue
        data = cells(d.pop("data"), r["key"]) if "data" in d else None
        bounds = spark.read.parquet(f"{path}/{r['key']}-bounds") if d.pop("bounds", False) else None
        constructs.append(Construct(**{**d, "axes": tuple(d["axes"]), "coordinates": tuple(d.get("coordinates", ()))}, data=data, bounds=bounds))
    return replace(out, constructs=tuple(constructs))


def append(field: Field, path: str, axis: str) -> Field:
    """More of the field along its unlimited axis: the new cells come after those there; nothing is rewritten."""
    spark = field.data.df.sparkSession
    old = load(spark, path)
    at = old.data.sizes[axis]
    if any(n != old.data.sizes[a] for a, n in field.data.sizes.items() if a != axis):
        raise ValueError("the other axes differ")
    field.data.df.select(*((F.col(a) + at).alias(a) if a == axis else F.col(a) for a in field.data.axes), field.data.v.alias(old.data.value)).write.mode("append").parquet(f"{path}/data")
    grown = replace(old, data=replace(old.data, df=spark.read.parquet(f"{path}/data"), shape=tuple(n + (field.data.sizes[axis] if a == axis else 0) for a, n in old.data.sizes.items())))
    rows = [("", "field", json.dumps({"properties": grown.properties, "data": _described(grown.data)}))]
    kept = spark.createDataFrame([tuple(r) for r in spark.read.parquet(f"{path}/_catalogue").where("type <> 'field'").collect()] + rows, "key string, type string, text string")
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/_catalogue")
    return grown
