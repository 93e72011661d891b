"""Checks of the conventions: each gives the objects that break a rule, as rows (object, rule, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(df: DataFrame, object_: str, rule: str, broken: Column, message: Column | str) -> DataFrame:
    """The rows for which `broken` is true."""
    text = message if isinstance(message, Column) else F.lit(message)
    return df.where(F.coalesce(broken, F.lit(False))).select(F.col(object_).alias("object"), F.lit(rule).alias("rule"), text.alias("message"))


def unknown_names(variables: DataFrame, names: DataFrame, modifiers: tuple[str, ...] = ("detection_minimum", "number_of_observations", "standard_error", "status_flag")) -> DataFrame:
    """Standard names that the table lacks, and modifiers that are none: an anti-join."""
    from ..functions.attrs import name_and_modifier

    v = variables.where("standard_name is not null").withColumn("_n", name_and_modifier(F.col("standard_name")))
    missing = v.join(names.select(F.col("name").alias("_known")), F.col("_n.name") == F.col("_known"), "left_anti")
    a = violation(missing, "variable", "standard_name", F.lit(True), F.concat(F.lit("not in the table: "), F.col("_n.name")))
    b = violation(v, "variable", "standard_name_modifier", F.col("_n.modifier").isNotNull() & ~F.col("_n.modifier").isin(*modifiers), F.concat(F.lit("not a modifier: "), F.col("_n.modifier")))
    return a.unionByName(b)


def missing_references(references: DataFrame, variables: DataFrame, rule: str = "reference") -> DataFrame:
    """(variable, attribute, target) whose target is no variable."""
    lost = references.join(variables.select(F.col("variable").alias("target")), "target", "left_anti")
    return violation(lost, "variable", rule, F.lit(True), F.concat("attribute", F.lit(" names absent "), "target"))


def foreign_dimensions(coordinates: DataFrame, rule: str = "dimensions") -> DataFrame:
    """Coordinates, cell measures and ancillaries whose dimensions are not among those of the data: (variable, dimensions, parent_dimensions)."""
    return violation(coordinates, "variable", rule, F.size(F.array_except("dimensions", "parent_dimensions")) > 0, F.concat(F.lit("spans "), F.array_join(F.array_except("dimensions", "parent_dimensions"), " ")))


def bounds_shape(bounds: DataFrame) -> DataFrame:
    """Bounds need the dimensions of their parent and one more: (variable, dimensions, parent_dimensions)."""
    fits = (F.size("dimensions") == F.size("parent_dimensions") + 1) & (F.slice("dimensions", F.lit(1), F.size("parent_dimensions")) == F.col("parent_dimensions"))
    return violation(bounds, "variable", "bounds", ~fits, "dimensions must be those of the parent and one more")


def counts_total(counts: DataFrame, total: int, rule: str = "node_count") -> DataFrame:
    """The sum of node or part counts must be the size of the dimension they count: (variable, count)."""
    sums = counts.groupBy("variable").agg(F.sum("count").alias("n"))
    return violation(sums, "variable", rule, F.col("n") != total, F.concat(F.lit("counts add up to "), F.col("n").cast("string")))


def index_range(index: DataFrame, column: str, size: int, rule: str = "index") -> DataFrame:
    """Index variables must point into their dimension: (variable, index column)."""
    return violation(index, "variable", rule, (F.col(column) < 0) | (F.col(column) >= size), F.concat(F.lit("no element "), F.col(column).cast("string"))).distinct()


def not_monotonic(coordinate: DataFrame, axis: str, value: str, name: str) -> DataFrame:
    """A dimension coordinate must rise or fall strictly and have no missing values; neighbours are compared in one window per coordinate."""
    from pyspark.sql import Window

    step = F.col(value) - F.lag(value).over(Window.partitionBy(name).orderBy(axis))
    s = coordinate.withColumn("_s", F.signum(step)).groupBy(name).agg(F.min("_s").alias("a"), F.max("_s").alias("b"), F.max(F.col(value).isNull()).alias("gone"))
    return violation(s, name, "monotonic", F.col("gone") | (F.col("a") != F.col("b")) | (F.col("a") == 0), "neither rising nor falling")


def _said(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def _count(text: Column) -> Column:
    """How many words an attribute has; none if it is absent."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


#: The locations of a mesh, and the attribute each needs there.
LOCATIONS = {"node": "node_coordinates", "edge": "edge_node_connectivity", "face": "face_node_connectivity"}


def datasets(variables: DataFrame, refs: DataFrame) -> DataFrame:
    """(dataset, object, rule, message) of everything that is wrong in the metadata of a catalogue of datasets of any size.

    `variables` and `refs` are those of sources.dataset: catalogue() and references(). Checked are what variables refer to
    and the dimensions of that, bounds, grid mappings, compression, and meshes. All rules of a row are told in one pass over
    each of the two tables; only dimensions that must exist need a join."""

    def rows(df: DataFrame, *checks: tuple[str, Column, Column | str]) -> DataFrame:
        """A row for each rule (rule, broken, message) that a row breaks."""
        broken = (F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), (said if isinstance(said, Column) else F.lit(said)).alias("message"))) for rule, test, said in checks)
        return df.select("dataset", F.col("variable").alias("object"), F.inline(F.array_compact(F.array(*broken))))

    role, target = F.col("role"), F.col("target")
    of_target = lambda k: F.try_element_at("target_attributes", F.lit(k))
    is_text = F.coalesce(F.col("target_type") == "string", F.lit(False))
    spans = F.when(is_text & (F.size("target_dimensions") > 0), F.slice("target_dimensions", 1, F.greatest(F.size("target_dimensions") - 1, F.lit(0)))).otherwise(F.col("target_dimensions"))
    foreign = F.array_except(spans, "dimensions")
    fits = (F.size("target_dimensions") == F.size("dimensions") + 1) & (F.slice("target_dimensions", F.lit(1), F.size("dimensions")) == F.col("dimensions"))
    no_mesh = ~F.coalesce(of_target("cf_role") == "mesh_topology", F.lit(False))
    need = F.try_element_at(F.create_map(*[F.lit(x) for k in LOCATIONS.items() for x in k]), F.col("location"))
    lacking = F.when(no_mesh, F.concat(target, F.lit(" is no mesh"))).when(need.isNull(), F.concat(F.lit("no location "), F.coalesce("location", F.lit("given")))).otherwise(F.concat(F.lit("the mesh has no "), need))
    referred = rows(
        refs,
        ("reference", F.col("state") == "missing", F.concat(role, F.lit(" names absent "), target)),
        ("dimensions", role.isin("coordinates", "cell_measures", "ancillary_variables") & (F.size(foreign) > 0), F.concat(role, F.lit(" "), target, F.lit(" spans "), F.array_join(foreign, " "))),
        ("bounds", role.isin("bounds", "climatology") & ~fits, F.concat(target, F.lit(": dimensions must be those of the parent and one more"))),
        ("grid_mapping", (role == "grid_mapping") & (F.col("state") == "found") & of_target("grid_mapping_name").isNull(), F.concat(target, F.lit(" has no grid_mapping_name"))),
        ("mesh", (role == "mesh") & (no_mesh | need.isNull() | F.try_element_at("target_attributes", need).isNull()), lacking),
    )
    is_mesh = F.coalesce(_said("cf_role") == "mesh_topology", F.lit(False))
    nodes = _count(_said("node_coordinates"))
    alone = rows(
        variables,
        ("compress", _said("compress").isNotNull() & (F.size("dimensions") != 1), "a list has one dimension"),
        ("mesh", _said("mesh").isNotNull() & (_count(_said("mesh")) == 0), " is no mesh"),
        ("mesh", is_mesh & _said("node_coordinates").isNull(), "node_coordinates are missing"),
        *(("mesh", is_mesh & _said(f"{k}_coordinates").isNotNull() & (_count(_said(f"{k}_coordinates")) != nodes), f"{k}_coordinates are not as many as node_coordinates") for k in ("edge", "face")),
    )
    one = lambda k: F.when(_said(k).isNotNull(), F.array(F.struct(F.lit(k).alias("rule"), _said(k).alias("_d"))))
    lists = F.when(_said("compress").isNotNull(), F.transform(F.filter(F.split(_said("compress"), r"\s+"), lambda x: x != ""), lambda x: F.struct(F.lit("compress").alias("rule"), x.alias("_d"))))
    asked = variables.select("dataset", F.col("variable").alias("object"), F.inline(F.flatten(F.array_compact(F.array(one("sample_dimension"), one("instance_dimension"), lists)))))
    dims = variables.select("dataset", F.explode("dimensions").alias("_d")).distinct()
    lost = asked.join(dims.hint("merge"), ["dataset", "_d"], "left_anti").select("dataset", "object", "rule", F.concat(F.lit("no dimension "), "_d").alias("message"))
    return report(referred, alone, lost)


def report(*checks: DataFrame) -> DataFrame:
    """All violations together."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def as_dict(violations: DataFrame) -> dict[str, list[dict]]:
    """The report of one dataset's metadata, by object."""
    out: dict[str, list[dict]] = {}
    for r in violations.orderBy("object", "rule", "message").collect():
        out.setdefault(r["object"], []).append({"rule": r["rule"], "message": r["message"]})
    return out
