"""The catalogue of metadata constructs, and its filters: each is a condition on one small table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Construct

SCHEMA = (
    "key string, type string, axes array<string>, naxes int, identity string, identities array<string>, ncvar string, ncdim string, "
    "size bigint, measure string, method string, cell string, connectivity string, properties map<string,string>"
)
ARRAYS = ("dimension_coordinate", "auxiliary_coordinate", "domain_ancillary", "field_ancillary", "cell_measure", "domain_topology", "cell_connectivity")


def catalogue(spark: SparkSession, constructs: tuple[Construct, ...] | list[Construct]) -> DataFrame:
    rows = [
        (c.key, c.type, list(c.axes), len(c.axes), c.identity(), c.identities(), c.ncvar, c.ncdim, c.size, c.measure, c.method, c.cell, c.connectivity, {k: str(v) for k, v in c.properties.items()})
        for c in constructs
    ]
    return spark.createDataFrame(rows, SCHEMA)


def named(df: DataFrame) -> DataFrame:
    """A table of constructs (key, type, axes, ncvar, ncdim, size, measure, method, cell, connectivity, properties) of any size, with naxes and the names that Construct.identities() gives."""
    first = ("standard_name", "cf_role", "axis", "long_name")
    p = lambda k: F.try_element_at("properties", F.lit(k))
    said = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), c))
    rest = F.transform(F.filter(F.array_sort(F.map_keys("properties")), lambda k: ~k.isin(*first)), lambda k: F.concat(k, F.lit("="), F.try_element_at("properties", k)))
    own = F.array(said("", p(first[0])), *(said(f"{c}:", F.col(c)) for c in ("measure", "method", "cell", "connectivity")), *(said(f"{k}=", p(k)) for k in first[1:]))
    names = F.array_compact(F.concat(own, rest, F.array(said("ncvar%", F.col("ncvar")), said("ncdim%", F.col("ncdim")))))
    return df.select("*", F.size("axes").alias("naxes"), F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("identity"), F.concat(names, F.array(F.concat(F.lit("key%"), "key"))).alias("identities"))


def _one(column: Column, values: tuple) -> Column:
    """One of the values; those that begin with "re:" are patterns to be found in it. Without values, there is one."""
    if not values:
        return column.isNotNull()
    out = F.lit(False)
    for v in values:
        out = out | (column.rlike(v[3:]) if isinstance(v, str) and v.startswith("re:") else column == F.lit(v))
    return F.coalesce(out, F.lit(False))


def by_axis(*axes: str, mode: str = "and") -> Column:
    """Constructs that span all the axes (and), any (or), these and no others (exact), none but these (subset). Without axes: that can have data."""
    if not axes:
        return by_data()
    given = F.array(*map(F.lit, axes))
    has = F.size(F.array_intersect("axes", given))
    array = F.col("type").isin(*ARRAYS)
    return array & {
        "and": has == len(set(axes)),
        "or": has > 0,
        "exact": (has == len(set(axes))) & (F.size("axes") == len(set(axes))),
        "subset": F.size(F.array_except("axes", given)) == 0,
    }[mode]


def by_data() -> Column:
    return F.col("type").isin(*ARRAYS)


def by_identity(*names: str) -> Column:
    if not names:
        return F.lit(True)
    return F.exists("identities", lambda x: _one(x, names)) | _one(F.col("key"), names)


def by_key(*values: str) -> Column:
    return _one(F.col("key"), values)


def by_type(*values: str) -> Column:
    return _one(F.col("type"), values)


def by_measure(*values: str) -> Column:
    return (F.col("type") == "cell_measure") & _one(F.col("measure"), values)


def by_method(*values: str) -> Column:
    return (F.col("type") == "cell_method") & _one(F.col("method"), values)


def by_cell(*values: str) -> Column:
    return (F.col("type") == "domain_topology") & _one(F.col("cell"), values)


def by_connectivity(*values: str) -> Column:
    return (F.col("type") == "cell_connectivity") & _one(F.col("connectivity"), values)


def by_naxes(*values: int) -> Column:
    return by_data() & (F.col("naxes").isin(*values) if values else F.lit(True))


def by_ncvar(*values: str) -> Column:
    return _one(F.col("ncvar"), values)


def by_ncdim(*values: str) -> Column:
    return _one(F.col("ncdim"), values)


def by_size(*values: int) -> Column:
    return (F.col("type") == "domain_axis") & _one(F.col("size"), values)


def by_property(mode: str = "and", rtol: float = 0.0, **properties: object) -> Column:
    """Constructs with all (and) or any (or) of the properties; None asks for the property to exist, numbers are compared as numbers within rtol."""
    out = None
    for name, value in properties.items():
        p = F.try_element_at("properties", F.lit(name))
        if value is None:
            test = p.isNotNull()
        elif isinstance(value, (int, float)):
            test = F.coalesce(F.abs(p.try_cast("double") - F.lit(float(value))) <= F.lit(rtol * abs(value)), F.lit(False))
        else:
            test = _one(p, (value,))
        out = test if out is None else (out & test if mode == "and" else out | test)
    return F.lit(True) if out is None else out


@dataclass(frozen=True)
class Selection:
    """A catalogue and what has been filtered from it, so that filters can be undone or inverted."""

    df: DataFrame
    before: Selection | None = None

    def filter(self, *conditions: Column) -> Selection:
        out = self
        for c in conditions:
            out = replace(out, df=out.df.where(c), before=out)
        return out

    def unfilter(self, depth: int | None = None) -> Selection:
        """The selection `depth` filters ago; the first, if no depth is given."""
        out = self
        while out.before is not None and (depth is None or depth > 0):
            out, depth = out.before, None if depth is None else depth - 1
        return out

    def inverse(self, depth: int | None = None) -> Selection:
        """What the last `depth` filters (all, if none is given) have taken away."""
        old = self.unfilter(depth)
        return Selection(old.df.join(self.df.select("key"), "key", "left_anti"), self)

    def key(self) -> str:
        found = self.df.select("key").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{len(found) or 'no'} constructs, not one")
        return found[0][0]


def convertible(catalogue: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """The constructs that go along when one on `axes` becomes a field: those that span no other axis, and the axes themselves."""
    own = F.array(*map(F.lit, axes))
    return catalogue.where(F.when(F.col("type") == "domain_axis", F.col("key").isin(*axes)).otherwise((F.size("axes") > 0) & (F.size(F.array_except("axes", own)) == 0)))


def global_attributes(attributes: DataFrame, field: str = "field_id", name: str = "name", value: str = "value") -> DataFrame:
    """(name, value) of attributes that every field has with one value."""
    fields = attributes.select(F.count_distinct(field).alias("fields"))
    own = attributes.groupBy(name).agg(F.count_distinct(field).alias("n"), F.min(value).alias(value), F.max(value).alias("_last"))
    return own.join(F.broadcast(fields), (F.col("n") == F.col("fields")) & (F.col(value) == F.col("_last"))).select(name, value)  # one row is broadcast
