"""Arrays that files hold compressed by convention: ragged ones of discrete sampling geometries, and gathered ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attrs import words
from ..model import Cells, Construct, Field
from ..operators import ragged
from ..operators.cells import unravelled
from ..operators.ordering import running_start
from .scratch import written

#: Attributes by which a variable says that others are compressed.
MARKS = ("sample_dimension", "instance_dimension", "compress")


def implied(variables: DataFrame) -> DataFrame:
    """(dataset, dimension, more): dimensions of a catalogue that stand for others, and these."""
    mark = lambda k: F.try_element_at("attributes", F.lit(k))
    own = F.col("dimensions")
    kinds = [(mark("sample_dimension"), mark("sample_dimension"), own), (mark("instance_dimension"), F.get(own, F.lit(0)), F.array(mark("instance_dimension"))), (mark("compress"), F.get(own, F.lit(0)), words(F.coalesce(mark("compress"), F.lit(""))))]
    out = None
    for there, dimension, more in kinds:
        one = variables.where(there.isNotNull()).select("dataset", dimension.alias("dimension"), more.alias("more"))
        out = one if out is None else out.unionByName(one)
    return out


def spanned(fields: DataFrame, variables: DataFrame) -> DataFrame:
    """fields (dataset, variable, dimensions) with the dimensions that theirs stand for among them, in two steps: samples stand for profiles, and these for instances."""
    known = implied(variables)
    for _ in range(2):
        flat = fields.select("dataset", "variable", "dimensions", F.explode_outer("dimensions").alias("dimension")).join(known, ["dataset", "dimension"], "left")
        fields = flat.groupBy("dataset", "variable").agg(F.first("dimensions").alias("dimensions"), F.flatten(F.collect_list("more")).alias("more")).select("dataset", "variable", F.array_union("dimensions", "more").alias("dimensions"))
    return fields


@dataclass(frozen=True)
class Scheme:
    """How a dimension is to be read: contiguous, indexed, indexed_contiguous or gathered, with its variables and the dimensions it stands for."""

    kind: str
    count: str | None = None
    index: str | None = None
    dimensions: tuple[str, ...] = ()


def schemes(rows: list) -> dict[str, Scheme]:
    """By dimension, from the catalogue rows of one dataset."""
    out: dict[str, Scheme] = {}
    by_dimension = {r["dimensions"][0]: r for r in rows if r["attributes"].get("instance_dimension") and r["dimensions"]}
    for r in rows:
        a = r["attributes"]
        if a.get("sample_dimension"):
            owner = by_dimension.get(r["dimensions"][0])
            if owner:
                out[a["sample_dimension"]] = Scheme("indexed_contiguous", r["variable"], owner["variable"], (owner["attributes"]["instance_dimension"], r["dimensions"][0]))
            else:
                out[a["sample_dimension"]] = Scheme("contiguous", r["variable"], None, (r["dimensions"][0],))
        elif a.get("compress"):
            out[r["dimensions"][0]] = Scheme("gathered", None, r["variable"], tuple(a["compress"].split()))
    counted = {s.dimensions[-1] for s in out.values() if s.kind == "indexed_contiguous"}
    for d, r in by_dimension.items():
        if d not in counted:
            out[d] = Scheme("indexed", None, r["variable"], (r["attributes"]["instance_dimension"],))
    return out


def expanded(cells: Cells, found: dict[str, Scheme], read: Callable[[str], Cells], sizes: dict[str, int], known: dict | None = None) -> Cells:
    """An array without compression; `read` gives the cells of a variable. The places of samples are an axis `element`, those of profiles one named `<profiles>_place`.

    Indices are counted from 0. Where each sample belongs is written once for all variables on its dimension, and kept in
    `known` with the largest counts, the sizes of new axes."""
    known = {} if known is None else known
    for axis, s in found.items():
        if axis not in cells.axes:
            continue
        rest = [a for a in cells.axes if a != axis]
        values = cells.df.select(*cells.axes, cells.v.alias("value"))
        variable = lambda name, new: (lambda c: c.df.select(F.col(c.axes[0]).cast("long").alias(c.axes[0]), c.v.cast("long").alias(new)))(read(name))
        if s.kind == "gathered":
            shape = tuple(sizes[d] for d in s.dimensions)
            places = variable(s.index, "_place")
            df = values.join(places, axis).select(*unravelled(F.col("_place"), s.dimensions, shape), *rest, "value")
            return replace(cells, df=df, axes=(*s.dimensions, *rest), shape=(*shape, *(cells.sizes[a] for a in rest)), value="value")
        if axis not in known:
            known[axis] = _places(axis, s, variable)
        places, new, largest = known[axis]
        df = places.join(values, axis, "inner" if s.kind == "indexed" else "left")
        shape = (sizes[new[0]], *largest)
        return replace(cells, df=df.select(*new, *rest, "value"), axes=(*new, *rest), shape=(*shape, *(cells.sizes[a] for a in rest)), value="value")
    return cells


def _places(axis: str, s: Scheme, variable: Callable[[str, str], DataFrame]) -> tuple[DataFrame, tuple[str, ...], list[int]]:
    """(sample, new axes) of a compressed dimension, from storage; the new axes, and the sizes of all but the first."""
    instance = s.dimensions[0]
    if s.kind == "indexed":
        owners = variable(s.index, instance)
        places, new = ragged.indexed(owners, instance, [axis], "element"), (instance, "element")
        most = owners.groupBy(instance).agg(F.count("*").alias("n")).agg(F.max("n"))
    elif s.kind == "contiguous":
        counts = variable(s.count, "_count")
        places, new = ragged.owned(counts, axis, instance, "_count", "element"), (instance, "element")
        most = counts.agg(F.max("_count"))
    else:
        profile, place = s.dimensions[1], f"{s.dimensions[1]}_place"
        profiles = variable(s.count, "_count").join(variable(s.index, instance), profile)
        placed = ragged.indexed(profiles, instance, [profile], place).select(profile, instance, place)
        places = ragged.owned(profiles, axis, profile, "_count", "element").join(placed, profile)
        new = (instance, place, "element")
        most = profiles.groupBy(instance).agg(F.count("*").alias("n"), F.max("_count").alias("m")).agg(F.max("n"), F.max("m"))
    return written(places.where(F.col("element").isNotNull()).select(axis, *new), "places"), new, [x or 0 for x in most.first()]


def compressed(field: Field, kind: str, sample: str = "obs") -> tuple[Field, list[tuple[str, tuple[str, ...], str, dict, Cells]]]:
    """(the field with its samples end to end, count and index variables): `kind` is contiguous or indexed for data on (instance, element), and indexed_contiguous for data on (instance, profile, element).

    All arrays that span the same axes as the data are compressed alike: an instance has samples up to the last that is
    missing in none of them. Instances without any stay, with a count of 0."""
    axes = field.data.axes
    if len(axes) != (3 if kind == "indexed_contiguous" else 2) or kind not in ("contiguous", "indexed", "indexed_contiguous"):
        raise ValueError(f"{kind} does not fit the axes {axes}")
    alike = [c for c in field.constructs if c.data is not None and c.axes == axes]
    there = None
    for c in [field.data, *(c.data for c in alike)]:
        one = c.df.select(*axes, c.v.isNotNull().alias("_there"))
        there = one if there is None else there.unionByName(one)
    instance, element = axes[0], axes[-1]
    # Of each instance, or profile, its last sample alone, from storage: counts and starts read it several times.
    there = there.groupBy(*axes[:-1]).agg(F.max(F.when(F.col("_there"), F.col(element))).alias(element)).withColumn("value", F.when(F.col(element).isNotNull(), 1))
    there = Cells(written(there, "last"), axes, field.data.shape)
    long = lambda df, axis, name, n: Cells(df.select(F.col(axis).cast("long").alias(axis), F.col(name).cast("int").alias("value")), (axis,), (n,))
    if kind == "indexed_contiguous":
        _, profiles = ragged.compress_indexed_contiguous(there, axes[1], element, sample, "_profile", "_instance")
        profiles = written(profiles, "profiles")
        starts = running_start(profiles, "_profile", "count", "_start")
        first = starts.groupBy("_instance").agg(F.min("_profile").alias("_first"))
        starts = starts.join(first, "_instance").select(F.col("_instance").alias(instance), (F.col("_profile") - F.col("_first")).alias(axes[1]), "_start", "count")
        starts = written(starts, "starts")
        total, n = profiles.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        row = f"{axes[1]}_row"
        own = profiles.withColumnRenamed("_profile", row)
        extra = [("row_size", (row,), "i4", {"sample_dimension": sample}, long(own, row, "count", n)), ("instance_index", (row,), "i4", {"instance_dimension": instance}, long(own, row, "_instance", n))]
        keys, sizes = [instance, axes[1]], {row: n}
    else:
        counted = there.df.groupBy(instance).agg(F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col(element) + 1)), F.lit(0).cast("long")).alias("count"))
        starts = written(running_start(counted, instance, "count", "_start"), "starts")
        counted = starts.select(instance, "count")
        total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        if kind == "contiguous":
            extra = [("row_size", (instance,), "i4", {"sample_dimension": sample}, long(counted, instance, "count", field.data.sizes[instance]))]
        else:
            owners = starts.where("count > 0").select(instance, F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("count") - 1)).alias(sample))
            extra = [("instance_index", (sample,), "i4", {"instance_dimension": instance}, long(owners, sample, instance, total))]
        keys, sizes = [instance], {}

    def packed(c: Cells) -> Cells:
        df = c.df.join(starts, keys).where(F.col(element) < F.col("count")).select((F.col("_start") + F.col(element)).alias(sample), c.v.alias("value"))
        return replace(c, df=df, axes=(sample,), shape=(total,), value="value")

    axis = {c.key: c for c in field.constructs if c.type == "domain_axis"}
    out = [Construct(sample, "domain_axis", size=total, ncdim=sample), replace(axis.get(instance, Construct(instance, "domain_axis", size=field.data.sizes[instance])), ncdim=instance)]
    out += [Construct(a, "domain_axis", size=n, ncdim=a) for a, n in sizes.items()]
    for c in field.constructs:
        if c in alike:
            out.append(replace(c, axes=(sample,), data=packed(c.data), bounds=None))
        elif c.type not in ("domain_axis", "dimension_coordinate") and not {*axes[1:]} & {*c.axes}:
            out.append(c)
        elif c.type == "dimension_coordinate" and c.axes == (instance,):
            out.append(c)
    return replace(field, data=packed(field.data), constructs=tuple(out)), extra
