"""Fields in classic netCDF files: written as the conventions say, and put together again from what files refer to."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attrs import format_cell_methods, key_values, parse_cell_methods, parse_grid_mapping, parse_key_values, words
from ..functions.references import coordinates_of
from ..model import Cells, Construct, Domain, Field
from . import aggregation, netcdf3, ugrid, zarr3
from .compression import MARKS, compressed, expanded, schemes, spanned
from .discover import dataset_type
from .scratch import local

CATALOGUE = "dataset string, variable string, type string, dimensions array<string>, shape array<bigint>, attributes map<string,string>, globals map<string,string>"
#: Attributes that refer to other variables by their names alone, and as "term: name" lists.
LISTS, TERMS = ("coordinates", "bounds", "climatology", "ancillary_variables"), ("cell_measures", "formula_terms", "aggregated_data")
#: Attributes of variables on meshes, and of mesh variables.
MESH = ("mesh", *ugrid.COORDINATES, *ugrid.CONNECTIVITY)
#: What a variable is to the field that refers to it.
KINDS = {"dimension": "dimension_coordinate", "coordinates": "auxiliary_coordinate", "cell_measures": "cell_measure", "ancillary_variables": "field_ancillary", "formula_terms": "domain_ancillary", "grid_mapping": "coordinate_reference"}


def catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a variable of all files; their headers are read by tasks, some files each."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path in b["path"]:
                if dataset_type(path) in ("zarr", "kerchunk"):
                    own, said = zarr3.arrays(path)
                    said = {k: str(v) for k, v in said.items()}
                    out += [(path, k, zarr3.TYPES[m["data_type"]], zarr3.axes_of(m), m["shape"], {x: str(y) for x, y in m.get("attributes", {}).items()}, said) for k, m in own.items()]
                    continue
                h = netcdf3.read_header(local(path))
                said = {k: str(v) for k, v in h.attributes.items()}
                for v in h.variables.values():
                    on, shape = [h.dimensions[d][0] for d in v.dimensions], list(h.shape(v))
                    if "aggregated_dimensions" in v.attributes:  # a scalar that stands for an array
                        on = v.attributes["aggregated_dimensions"].split()
                        shape = [dict(h.dimensions)[d] for d in on]
                    out.append((path, v.name, netcdf3.TYPES[v.type][1], on, shape, {k: str(x) for k, x in v.attributes.items()}, said))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CATALOGUE.split(", ")])

    some = spark.createDataFrame([(p,) for p in paths], "path string")
    return some.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism))).mapInPandas(headers, CATALOGUE)


def _given(name: str, column: str = "attributes") -> Column:
    return F.try_element_at(column, F.lit(name))


def _attribute(name: str, column: str = "attributes") -> Column:
    return F.coalesce(_given(name, column), F.lit(""))


def references(variables: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """(dataset, variable, role, term, target, found_in, target_dimensions, state, and more): what every variable of a catalogue refers to.

    `found_in` is the dataset with the target: that of the variable itself (state found), or, if it says that the target is
    an external variable, the one of `external`, another catalogue, that alone has it (external); else there is none (missing).
    A dimension refers to its coordinate variable if there is one. `dimensions` and `location` are those of the variable,
    `target_type` and `target_attributes` those of a target in its dataset. One explode and joins by name, whatever the
    number of datasets: variables meet in a merge join, as estimates of exploded tables are far too small to decide on a broadcast."""
    none = F.lit(None)

    def ref(role: str, term: Column, target: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), term.cast("string").alias("term"), target.alias("target"))

    def given(k: str, refs: Column) -> Column:
        """None for an attribute that a variable lacks, as it lacks most; the text is not taken apart then."""
        return F.when(_given(k).isNotNull(), refs)

    def listed(k: str) -> Column:
        return given(k, F.transform(words(_given(k)), lambda x: ref(k, none, x)))

    def termed(k: str) -> Column:
        return given(k, F.flatten(F.transform(F.map_entries(key_values(_given(k))), lambda e: F.transform(e["value"], lambda x: ref(k, e["key"], x)))))

    spans = F.col("dimensions")
    dimensions = F.when(_given("dimensions").isNotNull(), F.array_union(spans, words(_given("dimensions")))).otherwise(F.array_distinct(spans))  # a domain variable names them
    parts = [F.transform(dimensions, lambda d: ref("dimension", none, d)), *map(listed, (*LISTS, *MESH)), *map(termed, TERMS)]
    mapping = _given("grid_mapping")
    names = F.when(mapping.contains(":"), F.map_keys(key_values(mapping))).otherwise(words(mapping))
    parts.append(given("grid_mapping", F.transform(names, lambda x: ref("grid_mapping", none, x))))
    said = variables.select(
        "dataset", "variable", "dimensions", _given("location").alias("location"), F.concat(F.lit(" "), F.regexp_replace(_attribute("external_variables", "globals"), r"\s+", " "), F.lit(" ")).alias("outside"),
        F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("r"),
    )
    asked = said.select("dataset", "variable", "dimensions", "location", "r.*", ((F.col("r.role") == "cell_measures") & F.col("outside").contains(F.concat(F.lit(" "), F.col("r.target"), F.lit(" ")))).alias("outside"))
    there = variables.select("dataset", F.col("variable").alias("target"), F.col("dimensions").alias("own"), F.col("type").alias("target_type"), F.col("attributes").alias("target_attributes"))
    out = asked.join(there.hint("merge"), ["dataset", "target"], "left")
    if external is None:
        out = out.withColumn("elsewhere", F.lit(None).cast("string")).withColumn("outer", F.lit(None).cast("array<string>"))
    else:
        alone = external.groupBy(F.col("variable").alias("target")).agg(F.count("*").alias("n"), F.first("dataset").alias("elsewhere"), F.first("dimensions").alias("outer")).where("n = 1").drop("n")
        out = out.join(alone, "target", "left")
    # Only cell measures may be external; a dimension's coordinate variable spans that dimension alone.
    is_out = F.col("own").isNull() & F.col("outside") & F.col("elsewhere").isNotNull()
    state = F.when(F.col("own").isNotNull(), "found").when(is_out, "external").otherwise("missing")
    out = out.where((F.col("role") != "dimension") | F.coalesce(F.col("own") == F.array("target"), F.lit(False)))
    return out.select(
        "dataset", "variable", "role", "term", "target", F.when(F.col("own").isNotNull(), F.col("dataset")).when(is_out, F.col("elsewhere")).alias("found_in"),
        F.when(F.col("own").isNotNull(), F.col("own")).when(is_out, F.col("outer")).alias("target_dimensions"), state.alias("state"), "dimensions", "location", "target_type", "target_attributes",
    )


def data_variables(variables: DataFrame, refs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, variable, dimensions) of the variables that become fields: those that nothing in their dataset refers to, and those that are referred to by roles in `extra` only."""
    used = refs.where((F.col("state") == "found") & (~F.col("role").isin(*extra) if extra else F.lit(True))).select("dataset", F.col("target").alias("variable")).distinct()
    # Variables that only say how others are compressed are none.
    own = variables.where(~F.exists(F.map_keys("attributes"), lambda k: k.isin(*MARKS, "dimensions") | F.coalesce(_attribute("cf_role") == "mesh_topology", F.lit(False))))
    return own.join(used, ["dataset", "variable"], "left_anti").select("dataset", "variable", "dimensions")


def domain_variables(variables: DataFrame) -> DataFrame:
    """(dataset, variable, dimensions) of the variables that stand for a domain: they say its dimensions in an attribute."""
    own = F.try_element_at("attributes", F.lit("dimensions"))
    return variables.where(own.isNotNull() & (F.size("dimensions") == 0)).select("dataset", "variable", words(own).alias("dimensions"))


def constructs(variables: DataFrame, refs: DataFrame, fields: DataFrame) -> DataFrame:
    """(dataset, field, kind, term, variable, found_in, dimensions, bounds): the constructs of each field, with the variable of their bounds.

    A variable that spans a dimension the field lacks does not apply to it; a field has also the dimensions that its compressed
    ones stand for. Terms of a coordinate's formula are domain
    ancillaries of every field that has the coordinate. Character variables have one dimension more than they span."""
    text = variables.where("type = 'string'").select(F.col("dataset").alias("found_in"), F.col("variable").alias("target"), F.lit(True).alias("text"))
    known = refs.where("state <> 'missing'").join(text, ["found_in", "target"], "left")
    spans = F.when(F.coalesce("text", F.lit(False)), F.slice("target_dimensions", 1, F.greatest(F.size("target_dimensions") - 1, F.lit(0)))).otherwise(F.col("target_dimensions"))
    known = known.withColumn("spans", spans)
    own = spanned(fields, variables).withColumnRenamed("variable", "field").withColumnRenamed("dimensions", "of_field")
    direct = own.join(known.withColumnRenamed("variable", "field"), ["dataset", "field"])
    direct = direct.where(F.col("role").isin(*KINDS) & (F.size(F.array_except("spans", "of_field")) == 0))
    formula = known.where("role = 'formula_terms'").select(F.col("dataset").alias("found_in"), F.col("variable").alias("by"), F.col("term").alias("t"), F.col("target").alias("g"), F.col("spans").alias("s"))
    nested = direct.where("role in ('dimension', 'coordinates')").join(formula.where("g <> by"), (formula["found_in"] == direct["found_in"]) & (F.col("by") == F.col("target")))
    nested = nested.where(F.size(F.array_except("s", "of_field")) == 0).select("dataset", "field", F.lit("formula_terms").alias("role"), F.col("t").alias("term"), F.col("g").alias("target"), direct["found_in"], F.col("s").alias("spans"))
    every = direct.select("dataset", "field", "role", "term", "target", "found_in", "spans").unionByName(nested).distinct()
    edges = refs.where("state = 'found' and role in ('bounds', 'climatology')").select(F.col("dataset").alias("found_in"), F.col("target").alias("bounds"), F.col("variable").alias("target"))
    kind = F.create_map(*[F.lit(x) for k in KINDS.items() for x in k])[F.col("role")]
    return every.join(edges, ["found_in", "target"], "left").select("dataset", "field", kind.alias("kind"), "term", F.col("target").alias("variable"), "found_in", F.col("spans").alias("dimensions"), "bounds")


def grouped(spark: SparkSession, paths: list[str], external: list[str] | None = None, extra: tuple[str, ...] = (), domain: bool = False) -> dict[str, list]:
    """The fields of each file, by variable, or its domains; cell measures that files leave to others are looked for in `external`. Metadata come to the driver, data stay where they are."""
    own = catalogue(spark, paths).persist()
    outer = catalogue(spark, external).persist() if external else None
    refs = references(own, outer).drop("dimensions", "location", "target_type", "target_attributes").persist()
    fields = domain_variables(own) if domain else data_variables(own, refs, extra)
    found = constructs(own if outer is None else own.unionByName(outer), refs, fields)
    described = {(r["dataset"], r["variable"]): r for part in (own, outer) if part is not None for r in part.collect()}
    mine: dict[tuple[str, str], list] = {}
    for r in found.collect():
        mine.setdefault((r["dataset"], r["field"]), []).append(r)
    names = fields.collect()
    for df in (refs, own, outer):
        if df is not None:
            df.unpersist()
    make = _domain if domain else _field
    out: dict[str, list] = {p: [] for p in paths}
    places: dict[str, dict] = {p: {} for p in paths}  # of compressed dimensions, and bounds on meshes, for all variables of a file
    for d, v in sorted((r["dataset"], r["variable"]) for r in names):
        out[d].append(make(spark, described, d, v, mine.get((d, v), []), places))
    return out


def read(spark: SparkSession, paths: list[str], external: list[str] | None = None, extra: tuple[str, ...] = (), domain: bool = False) -> list[Field] | list[Domain]:
    """All of grouped() in the order of the files."""
    return [f for part in grouped(spark, paths, external, extra, domain).values() for f in part]


def variable(spark: SparkSession, path: str, name: str, **how: str) -> Cells:
    """One variable of a dataset of any format."""
    if dataset_type(path) in ("zarr", "kerchunk"):
        own = os.path.isdir(local(path)) and name not in zarr_names(path)
        return zarr3.read(spark, path, "" if own else name, **how)
    return netcdf3.read(spark, path, name, **how)


def zarr_names(path: str) -> list[str]:
    """The arrays in a folder, none if it is an array itself."""
    return [x for x in os.listdir(local(path)) if os.path.isdir(f"{local(path)}/{x}") and any(os.path.exists(f"{local(path)}/{x}/{y}") for y in ("zarr.json", ".zarray"))]


def dimensions_of(path: str) -> dict[str, int]:
    """The dimensions that a dataset declares; those of Zarr are its arrays'."""
    return {} if dataset_type(path) in ("zarr", "kerchunk") else dict(netcdf3.read_header(local(path)).dimensions)


def _cells(spark: SparkSession, r: object, described: dict, places: dict[str, dict]) -> Cells:
    def raw(r: object) -> Cells:
        if "aggregated_data" in r["attributes"]:
            return aggregation.stored(spark, r["dataset"], r["variable"])
        return variable(spark, r["dataset"], r["variable"], **({"last": "text"} if r["type"] == "string" and r["dimensions"] else {}))

    own = [x for (d, _), x in described.items() if d == r["dataset"]]
    sizes = {d: n for x in own for d, n in zip(x["dimensions"], x["shape"])}
    sizes |= dimensions_of(r["dataset"])
    return expanded(raw(r), schemes(own), lambda name: raw(described[r["dataset"], name]), sizes, places.setdefault(r["dataset"], {}))


def _properties(r: object) -> dict:
    return {k: v for k, v in r["attributes"].items() if k not in (*LISTS, *TERMS, "mesh", "location", "aggregated_dimensions", "dimensions", "grid_mapping", "cell_methods", "_FillValue", "units", "calendar", "featureType")}


def _field(spark: SparkSession, described: dict, dataset: str, name: str, found: list, places: dict[str, dict]) -> Field:
    r = described[dataset, name]
    data = _cells(spark, r, described, places)
    out = _constructs(spark, described, dataset, r, found, data.sizes, places)
    for k, m in enumerate(parse_cell_methods(r["attributes"].get("cell_methods", ""))):
        out.append(Construct(f"cellmethod{k}", "cell_method", tuple(m["axes"]), {q: str(v) for q, v in m.items() if q not in ("axes", "method")}, method=m["method"]))
    return Field(data, tuple(out), {**r["globals"], **_properties(r)})


def _domain(spark: SparkSession, described: dict, dataset: str, name: str, found: list, places: dict[str, dict]) -> Domain:
    r = described[dataset, name]
    sizes = dimensions_of(dataset) | {d: n for (x, _), y in described.items() if x == dataset for d, n in zip(y["dimensions"], y["shape"])}
    return Domain(tuple(_constructs(spark, described, dataset, r, found, {d: sizes[d] for d in r["attributes"]["dimensions"].split()}, places)), {**r["globals"], **_properties(r)})


def _constructs(spark: SparkSession, described: dict, dataset: str, r: object, found: list, sizes: dict[str, int], places: dict[str, dict]) -> list[Construct]:
    out = [Construct(a, "domain_axis", size=n, ncdim=a) for a, n in sizes.items()]
    for x in sorted(found, key=lambda x: (list(KINDS.values()).index(x["kind"]), x["variable"])):
        if x["kind"] == "coordinate_reference":
            continue
        own = described[x["found_in"], x["variable"]]
        cells, bounds = _cells(spark, own, described, places), None
        if x["bounds"]:
            bounds = variable(spark, x["found_in"], x["bounds"], last="array").df.withColumnRenamed("value", "bounds")
        key, kind = x["variable"], x["kind"]
        if kind == "auxiliary_coordinate" and not cells.axes and own["type"] != "string":  # a scalar number is a coordinate on an axis of its own
            kind, cells = "dimension_coordinate", Cells(cells.df.select(F.lit(0).cast("long").alias(key), cells.v.alias("value")), (key,), (1,), units=cells.units, calendar=cells.calendar, fill=cells.fill)
            bounds = bounds.select(F.lit(0).cast("long").alias(key), "bounds") if bounds is not None else None
            out.append(Construct(key, "domain_axis", size=1, ncdim=key))
        if kind == "dimension_coordinate":  # an axis has the name of its coordinate
            key = f"axis_{key}"
        out.append(Construct(key, kind, tuple(cells.axes), _properties(own), ncvar=x["variable"], measure=x["term"] if x["kind"] == "cell_measure" else None, data=cells, bounds=bounds))
    raw = lambda x, **how: variable(spark, dataset, x, **how)
    out += ugrid.constructs(described, dataset, r, sizes, raw, places.setdefault(dataset, {}))
    return out + _references(described, dataset, r, found, out)


def _references(described: dict, dataset: str, r: object, found: list, known: list[Construct]) -> list[Construct]:
    """The coordinate references of a field: one for each grid mapping, and one for each coordinate with a formula."""
    out = []
    by_variable = {c.ncvar: c for c in known if c.ncvar}
    is_coordinate = [c for c in known if c.type in ("dimension_coordinate", "auxiliary_coordinate")]
    mapping = r["attributes"].get("grid_mapping", "")
    for variable, coordinates in (parse_grid_mapping(mapping) if mapping.strip() else {}).items():
        if (dataset, variable) not in described:
            continue
        parameters = described[dataset, variable]["attributes"]
        # Without a list the mapping goes with coordinates that have the standard names for it.
        names = coordinates_of(parameters.get("grid_mapping_name", ""))
        keys = [by_variable[v].key for v in coordinates if v in by_variable] if coordinates else [c.key for c in is_coordinate if c.properties.get("standard_name") in names]
        out.append(Construct(f"reference_{variable}", "coordinate_reference", (), dict(parameters), ncvar=variable, coordinates=tuple(keys)))
    for c in is_coordinate:
        terms = parse_key_values(described.get((dataset, c.ncvar), {"attributes": {}})["attributes"].get("formula_terms", "") or "")
        if terms:
            name = c.properties.get("computed_standard_name")
            own = {"standard_name": c.properties.get("standard_name", "")} | ({"computed_standard_name": name} if name else {})
            here = {t: by_variable[v[0]].key for t, v in terms.items() if v and v[0] in by_variable and by_variable[v[0]] is not c}
            out.append(Construct(f"formula_{c.ncvar}", "coordinate_reference", (), own, coordinates=(c.key,), terms=here))
    return out


def make(folder: str) -> None:
    """The folder that files go to."""
    os.makedirs(local(folder), exist_ok=True)


def _free(name: str, taken: dict | set) -> str:
    name = "".join(c if c.isalnum() or c == "_" else "_" for c in name) or "data"
    out, k = name, 0
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def _without_axis(c: Construct, gone: set[str]) -> Construct:
    """A coordinate on an axis of size 1 as a scalar one."""
    if c.type != "dimension_coordinate" or c.axes[0] not in gone:
        return c
    bounds = c.bounds.select("bounds") if c.bounds is not None else None
    return replace(c, type="auxiliary_coordinate", axes=(), data=replace(c.data, df=c.data.df.select(c.data.value), axes=(), shape=()), bounds=bounds)


def append(f: Field, path: str, axis: str) -> int:
    """More of a field along the unlimited axis of a file that write() made of one like it; gives the new size. Only what spans the axis is written, after what is there."""
    h = netcdf3.read_header(local(path))
    known = next((c for c in f.constructs if c.type == "domain_axis" and c.key == axis), None)
    name = (known and known.ncdim) or axis
    own = f.properties.get("ncvar") or f.properties.get("standard_name") or f.properties.get("long_name") or "data"
    arrays = {_free(own, {}): f.data}
    for c in f.constructs:
        if c.data is not None and c.axes[:1] == (axis,):
            variable = name if c.type == "dimension_coordinate" else c.ncvar or c.identity("variable")
            arrays[_free(variable, {})] = c.data
            if c.bounds is not None:
                arrays[h.variables[_free(variable, {})].attributes["bounds"]] = Cells(c.bounds, c.axes, c.data.shape, "bounds")
    for k, c in arrays.items():
        v = h.variables.get(k)
        if v is None or not h.is_record(v) or h.dimensions[v.dimensions[0]][0] != name or h.shape(v)[1 : c.ndim] != c.shape[1:]:
            raise ValueError(f"{k} does not go on along {name}")
    lost = [k for k, v in h.variables.items() if h.is_record(v) and k not in arrays]
    if lost:
        raise ValueError(f"there is no more of {', '.join(lost)}")
    first = h.records
    h = netcdf3.extend(path, f.data.sizes[axis])
    for k, c in arrays.items():
        netcdf3.put(c, path, h, k, first=first)
    return h.records


def write(fields: list[Field | Domain], path: str, external: str | None = None, attributes: dict | None = None, limits: bool = True, compress: str | None = None, aggregate: int | None = None, unlimited: str | None = None) -> dict[str, int]:
    """Fields and domains as one classic file, or two: cell measures go to `external` if it is given, and the first file names them. With `compress` (contiguous, indexed, indexed_contiguous) a field's samples are stored end to end: see compressed(). With `aggregate` its data go to fragments of so many indices of the first axis, in files beside this one. The axis named `unlimited` can grow: see append().

    Axes of equal names and sizes are one dimension, coordinates on an axis of size 1 that the data lack are scalar; equal constructs are written once. Headers come first, then tasks
    write each variable's cells at their places. Gives the number of values outside valid_min and valid_max by variable,
    as seen by the jobs that write."""
    dims: dict[str, int] = {}
    outside: dict[str, int] = {}
    plans: dict[str, tuple] = {}  # name: (dimensions, type, attributes, cells), and those of the external file
    outer: dict[str, tuple] = {}
    done: list[tuple[Construct, str]] = []

    def dimension(name: str, size: int, into: dict[str, int] = dims) -> str:
        if into.get(name, size) != size:
            name = _free(name, into)
        into[name] = size
        return name

    def kind_of(c: Cells) -> tuple[str, int]:
        kind = c.df.schema[c.value].dataType.simpleString()
        if kind == "string":
            return "S1", max(1, c.df.agg(F.max(F.octet_length(c.v))).first()[0] or 1)
        return netcdf3.OF_SPARK[kind], 0

    def planned(c: Cells, name: str, on: tuple[str, ...], own: dict, into: dict[str, tuple] = plans, sizes: dict[str, int] = dims) -> None:
        kind, width = kind_of(c)
        own = {k: v for k, v in own.items() if v is not None} | ({"units": c.units} if c.units else {}) | ({"calendar": c.calendar} if c.calendar else {})
        if c.fill is not None and kind != "S1":
            own["_FillValue"] = np.dtype(kind).type(c.fill)
        into[name] = ((*on, dimension(f"strlen{width}", width, sizes)) if width else on, kind, own, c)

    meshes: dict[int, tuple[str, ugrid.Plan]] = {}
    spark = SparkSession.getActiveSession()
    given: set[str] = set()

    def allotted(x: str) -> str:
        given.add(out := _free(x, given))
        return out

    for p in ugrid.planned(spark, fields, allotted):
        for a, n in p.sizes.items():
            dims[a] = n
        plans.update(p.variables)
        own = _free("mesh", {*plans, *dims})
        plans[own] = ((), "i4", p.attributes, None)
        meshes |= {k: (own, p) for k in p.axes}
    for number, f in enumerate(fields):
        axis: dict[str, str] = {}
        along = None
        if number in meshes:
            own, p = meshes[number]
            along, location = p.axes[number]
            on = p.attributes.get(f"{location}_dimension") or next(iter(p.sizes))
            axis[along] = on
            rest = [c for c in f.constructs if c.axes != (along,) or c.type not in ("auxiliary_coordinate", "domain_topology", "cell_connectivity")]
            rest = [replace(c, data=p.moved(number, c.data)) if c.data is not None else c for c in rest]
            f = replace(f, **({"data": p.moved(number, f.data)} if isinstance(f, Field) else {}), properties={**f.properties, "mesh": own, "location": location}, constructs=tuple(rest))
        more: list[tuple] = []
        if compress:
            f, more = compressed(f, compress, _free("obs", dims))
        written: dict[str, str] = {}  # variables by keys of constructs
        formulas = {c.coordinates[0]: c for c in f.constructs if c.type == "coordinate_reference" and c.terms and c.coordinates}
        for a, n in (f.sizes if isinstance(f, Domain) else f.data.sizes).items():
            if a == along:
                continue
            known = next((c for c in f.constructs if c.type == "domain_axis" and c.key == a), None)
            axis[a] = dimension((known and known.ncdim) or a, n)
        scalar = set() if isinstance(f, Domain) else {c.axes[0] for c in f.constructs if c.type == "dimension_coordinate" and c.axes[0] not in f.data.axes and c.data.size == 1}
        f = replace(f, constructs=tuple(_without_axis(c, scalar) for c in f.constructs if not (c.type == "domain_axis" and c.key in scalar)))
        for c in f.constructs:
            if c.type == "domain_axis" and c.key not in axis:
                axis[c.key] = dimension(c.ncdim or c.key, c.size)
        for name, on, kind, own, c in more:
            plans[_free(name, {*plans, *dims})] = (tuple(axis[a] for a in on), kind, {k: axis.get(v, v) for k, v in own.items()}, c)
        said: dict[str, list[str]] = {}
        # Terms of formulas come before the coordinates that name them.
        for c in sorted(f.constructs, key=lambda c: c.type != "domain_ancillary"):
            if c.type == "cell_method":
                said.setdefault("cell_methods", []).append(format_cell_methods([{"axes": [axis.get(a, a) for a in c.axes], "method": c.method, **{k: v for k, v in c.properties.items() if k in ("within", "where", "over", "comment")}}]))
            if c.data is None:
                continue
            on = tuple(axis[a] for a in c.axes)
            name = next((n for k, n in done if k == replace(c, key=k.key)), None)
            away = c.type == "cell_measure" and external is not None
            if name is None:
                wanted = on[0] if c.type == "dimension_coordinate" else c.ncvar or c.identity("variable")
                into, sizes = (outer, outside) if away else (plans, dims)
                name = wanted if c.type == "dimension_coordinate" and wanted not in plans else _free(wanted, {*plans, *outer, *(dims if c.type != "dimension_coordinate" else ())})
                own = dict(c.properties)
                if c.key in formulas:
                    own["formula_terms"] = " ".join(f"{t}: {written[k]}" for t, k in formulas[c.key].terms.items() if k in written)
                if away:
                    for a in on:
                        outside[a] = dims[a]
                if c.bounds is not None:
                    corners = c.bounds.agg(F.max(F.size("bounds"))).first()[0] or 1
                    own["bounds"] = edge = _free(f"{name}_bounds", {*plans, *dims})
                    plans[edge] = ((*on, dimension(f"bounds{corners}", corners)), "f8", {"_FillValue": np.float64(netcdf3.DEFAULT_FILL["double"])}, Cells(c.bounds, c.axes, c.data.shape, "bounds"))
                planned(c.data, name, on, own, into, sizes)
                done.append((c, name))
            written[c.key] = name
            role = {"auxiliary_coordinate": "coordinates", "field_ancillary": "ancillary_variables", "cell_measure": "cell_measures"}.get(c.type)
            if role:
                said.setdefault(role, []).append(f"{c.measure}: {name}" if role == "cell_measures" else name)
        for c in f.constructs:
            if c.type == "coordinate_reference" and not c.terms:
                name = next((n for k, n in done if k == replace(c, key=k.key)), None)
                if name is None:
                    name = _free(c.ncvar or c.properties.get("grid_mapping_name", "crs"), {*plans, *outer, *dims})
                    plans[name] = ((), "i4", dict(c.properties), None)
                    done.append((c, name))
                said.setdefault("grid_mapping", []).append(f"{name}: {' '.join(written[k] for k in c.coordinates if k in written)}")
        name = _free(f.properties.get("ncvar") or f.properties.get("standard_name") or f.properties.get("long_name") or "data", {*plans, *dims, *outer})
        own = {**{k: v for k, v in f.properties.items() if k != "ncvar"}, **{k: " ".join(v) for k, v in said.items()}}
        if isinstance(f, Domain):
            name = _free(f.properties.get("ncvar", "domain"), {*plans, *dims, *outer})
            plans[name] = ((), "i4", {**own, "dimensions": " ".join(axis[a] for a in f.sizes)}, None)
        elif aggregate:
            file = local(path)
            more, sizes, variables = aggregation.planned(f.data, f"file://{file}.fragments", name, aggregate, os.path.dirname(file))
            dims |= sizes
            plans.update(variables)
            planned(f.data, name, tuple(axis[a] for a in f.data.axes), own)
            on, kind, own, _ = plans[name]
            plans[name] = ((), kind, {**own, **more, "aggregated_dimensions": " ".join(on)}, None)
        else:
            planned(f.data, name, tuple(axis[a] for a in f.data.axes), own)
    noted = {"Conventions": "CF-1.11", **(attributes or {})} | ({"external_variables": " ".join(outer)} if outer else {})
    beyond: dict[str, int] = {}
    for target, sizes, variables, own in ((path, dims, plans, noted), (external, outside, outer, {"Conventions": "CF-1.11"})):
        if target is None:
            continue
        h = netcdf3.create(target, sizes, {k: x[:3] for k, x in variables.items()}, own, unlimited if unlimited in sizes else None)
        for k, (_, kind, a, c) in variables.items():
            if c is None:  # attributes only
                continue
            if isinstance(c, np.ndarray):
                netcdf3.put_array(target, h, k, c)
                continue
            low, high = a.get("valid_min"), a.get("valid_max")
            ends = (-np.inf if low is None else low, np.inf if high is None else high) if limits and kind != "S1" and (low is not None or high is not None) else None
            n = netcdf3.put(c, target, h, k, limits=tuple(map(float, ends)) if ends else None)
            if ends:
                beyond[k] = n
    return beyond
