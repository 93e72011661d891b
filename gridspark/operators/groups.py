"""References between variables of hierarchical groups, resolved for whole tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """The names of the groups on a path; the root has none."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def joined(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def _normal(names: Column) -> Column:
    """A path without "." and ".."; NULL where it leads above the root."""
    up = lambda out: F.when(F.size(out) > 0, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
    step = lambda out, x: F.when(x == "..", up(out)).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(names, F.array().cast("array<string>"), step)


def _ancestors(path: Column, own: bool = True) -> Column:
    """The paths of a group, if `own`, and of all groups it lies in."""
    names = parts(path)
    last = F.size(names) if own else F.size(names) - 1
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: joined(F.slice(names, 1, k)))).otherwise(F.array().cast("array<string>"))


def resolved(references: DataFrame, variables: DataFrame, dimensions: DataFrame | None = None) -> DataFrame:
    """references (path, name) with `found_in`, the group of the variable that is meant, and `how` it was found; NULL for both where there is none.

    A name with a slash is a path, from the root (absolute) or from the group of the reference (relative). Any other is looked
    for in the group itself and then in those it lies in, the nearest first (proximal). If that fails, in the groups
    below the local apex, the nearest group with a dimension of that name (with `dimensions` (path, name); else the root):
    the one of least depth, if it is alone there (lateral). With a local apex, the search upwards ends at it.

    Groups and names that refer alike are resolved once. The groups a reference lies in are exploded, as many rows as it is
    deep, and met by equality; for the way down each variable is counted once in each group above it, partially
    aggregated, so a name that stands in every group makes one row a group and no pairs."""
    asked = references.select("path", "name").distinct()
    here = variables.select(F.col("path").alias("at"), "name").distinct()
    base = F.when(F.startswith(F.col("name"), F.lit("/")), F.lit("/")).otherwise(F.col("path"))
    full = _normal(F.concat(parts(base), parts(F.col("name"))))
    by_path = asked.where(F.contains("name", F.lit("/"))).withColumn("_full", full).where("_full is not null and size(_full) > 0")
    by_path = by_path.select("path", "name", joined(F.slice("_full", 1, F.size("_full") - 1)).alias("at"), F.element_at("_full", -1).alias("last"))
    by_path = by_path.join(here.withColumnRenamed("name", "last"), ["at", "last"]).select("path", "name", F.col("at").alias("found_in"), F.when(F.startswith(F.col("name"), F.lit("/")), "absolute").otherwise("relative").alias("how"))
    plain = asked.where(~F.contains("name", F.lit("/")))
    steps = plain.select("path", "name", F.explode(_ancestors(F.col("path"))).alias("at"))
    depth = F.size(parts(F.col("at")))
    above = steps.join(here, ["name", "at"]).groupBy("path", "name").agg(F.max_by("at", depth).alias("near"), F.max(depth).alias("near_depth"))
    if dimensions is None:
        apex = plain.select("path", "name", F.lit("/").alias("apex"), F.lit(0).alias("apex_depth"))
    else:
        top = steps.join(dimensions.select(F.col("path").alias("at"), "name").distinct(), ["name", "at"]).groupBy("path", "name").agg(F.max_by("at", depth).alias("apex"), F.max(depth).alias("apex_depth"))
        apex = plain.join(top, ["path", "name"], "left")
    below = here.select("name", F.explode(_ancestors(F.col("at"), own=False)).alias("apex"), "at").groupBy("name", "apex", depth.alias("depth")).agg(F.count("*").alias("n"), F.min("at").alias("at"))
    below = below.groupBy("name", "apex").agg(F.min(F.struct("depth", "n", "at")).alias("first")).where("first.n = 1").select("name", "apex", F.col("first.at").alias("far"))
    found = plain.join(above, ["path", "name"], "left").join(apex, ["path", "name"], "left").join(below, ["name", "apex"], "left")
    # A variable beyond the local apex is not looked at.
    near = F.when(F.col("near_depth") >= F.coalesce("apex_depth", F.lit(0)), F.col("near"))
    by_name = found.select("path", "name", F.coalesce(near, "far").alias("found_in"), F.when(near.isNotNull(), "proximal").when(F.col("far").isNotNull(), "lateral").alias("how"))
    return references.join(by_name.unionByName(by_path), ["path", "name"], "left")
