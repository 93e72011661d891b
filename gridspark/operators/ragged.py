"""Ragged arrays: rows of unequal length stored end to end, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Cells
from .ordering import running_start
from .reduce import trailing_count


def contiguous(samples: DataFrame, instances: DataFrame, sample: str, instance: str, count: str, element: str = "e") -> DataFrame:
    """(instance, element, sample columns) of a contiguous ragged array.

    Instance k owns the `count` samples after those of all before it. The prefix sum is taken in two levels, and
    a sample's number is matched by equality with start + element: no range join. Instances
    without samples give one row with NULL, so they are not lost."""
    return owned(instances, sample, instance, count, element).join(samples, sample, "left")


def owned(instances: DataFrame, sample: str, instance: str, count: str, element: str = "e") -> DataFrame:
    """(instance, element, sample): the samples that each instance of a contiguous ragged array owns; one row with NULL where it has none."""
    starts = running_start(instances.select(instance, F.coalesce(count, F.lit(0)).cast("long").alias("_count")), instance, "_count", "_start")
    places = starts.select(instance, F.explode_outer(F.when(F.col("_count") > 0, F.sequence(F.lit(0).cast("long"), F.col("_count") - 1))).alias(element), "_start")
    return places.withColumn(sample, F.col("_start") + F.col(element)).drop("_start")


def indexed(samples: DataFrame, instance: str, order: list[str], element: str = "e") -> DataFrame:
    """samples with `element`: their place among those of their instance, in the given order."""
    return samples.withColumn(element, (F.row_number().over(Window.partitionBy(instance).orderBy(*order)) - 1).cast("long"))


def indexed_contiguous(samples: DataFrame, profiles: DataFrame, sample: str, profile: str, instance: str, count: str, element: str = "e", place: str = "p") -> DataFrame:
    """(instance, place of the profile in it, element, sample columns): profiles belong to instances by index, samples to profiles by count."""
    placed = indexed(profiles, instance, [profile], place).select(profile, instance, place)
    return contiguous(samples, profiles, sample, profile, count, element).join(placed, profile).drop(profile)


def padded(df: DataFrame, instance: str, element: str, columns: list[str], width: int | None = None) -> DataFrame:
    """The dense form: every instance with elements 0 to width - 1 (the longest, if not given), missing where it has none."""
    if width is None:
        last = df.agg(F.max(element)).first()[0]
        width = 0 if last is None else last + 1
    grid = df.select(instance).distinct().select(instance, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias(element)) if width else df.select(instance, element).where("false")
    return grid.join(df.where(F.col(element).isNotNull()).select(instance, element, *columns), [instance, element], "left")


def compress_contiguous(cells: Cells, axis: str, sample: str = "o") -> tuple[DataFrame, DataFrame]:
    """(samples, counts): the cells of each instance up to the last that is not missing, end to end. Instances without any keep a count of 0."""
    (instance,) = [a for a in cells.axes if a != axis]
    counts = trailing_count(cells, axis)
    starts = running_start(counts, instance, "count", "_start")
    samples = cells.df.join(starts, instance).where(F.col(axis) < F.col("count"))
    return samples.select((F.col("_start") + F.col(axis)).alias(sample), cells.value), counts


def compress_indexed(cells: Cells, axis: str, sample: str = "o", index: str = "index") -> DataFrame:
    """(sample, index, value): the same samples, each with the number of its instance."""
    (instance,) = [a for a in cells.axes if a != axis]
    starts = running_start(trailing_count(cells, axis), instance, "count", "_start")
    rows = cells.df.join(starts, instance).where(F.col(axis) < F.col("count"))
    return rows.select((F.col("_start") + F.col(axis)).alias(sample), F.col(instance).alias(index), cells.value)


def compress_indexed_contiguous(cells: Cells, profile: str, element: str, sample: str = "o", number: str = "profile", index: str = "index") -> tuple[DataFrame, DataFrame]:
    """(samples, profiles) of cells on (instance, profile, element): samples (sample, value) end to end by profile, profiles (number, index, count) with their instance and how many samples they own.

    A profile has its samples up to the last that is not missing, an instance its profiles up to the last that has any;
    one between without samples keeps a count of 0. Two nested prefix sums, each in two levels: profiles are numbered from
    the counts of instances, samples from those of profiles. indexed_contiguous() is the way back."""
    (instance,) = [a for a in cells.axes if a not in (profile, element)]
    counts = cells.df.groupBy(instance, profile).agg(F.coalesce(F.max(F.when(cells.v.isNotNull(), F.col(element) + 1)), F.lit(0)).cast("long").alias("count"))
    owned = counts.groupBy(instance).agg(F.coalesce(F.max(F.when(F.col("count") > 0, F.col(profile) + 1)), F.lit(0)).cast("long").alias("_profiles"))
    first = running_start(owned, instance, "_profiles", "_first")
    every = first.where("_profiles > 0").select(instance, "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_profiles") - 1)).alias(profile))
    placed = every.join(counts, [instance, profile], "left").select(instance, profile, F.coalesce("count", F.lit(0).cast("long")).alias("count"), (F.col("_first") + F.col(profile)).alias(number))
    starts = running_start(placed, number, "count", "_start")
    samples = cells.df.join(starts, [instance, profile]).where(F.col(element) < F.col("count"))
    return samples.select((F.col("_start") + F.col(element)).alias(sample), cells.value), placed.select(number, F.col(instance).alias(index), "count")
