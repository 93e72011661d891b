"""Meshes in files by the unstructured-grid conventions: what a mesh variable names becomes constructs, and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cells, Construct, Field
from ..operators import mesh as M
from ..operators.ordering import dense_places
from .scratch import written

#: Attributes of a mesh variable that name coordinates, and connectivities.
COORDINATES = ("node_coordinates", "edge_coordinates", "face_coordinates")
CONNECTIVITY = ("edge_node_connectivity", "face_node_connectivity", "edge_edge_connectivity", "face_face_connectivity", "edge_face_connectivity", "face_edge_connectivity", "boundary_node_connectivity")
#: Cells of a domain topology by the location of a variable.
CELLS = {"node": "point", "edge": "edge", "face": "face"}


def constructs(described: dict, dataset: str, r: object, sizes: dict[str, int], read: Callable[..., Cells], known: dict | None = None) -> list[Construct]:
    """Domain topology, cell connectivity and coordinates of a variable that has a mesh and a location; none if it has no such.

    `read(name, last=...)` gives the cells of a variable. Ids count from 0, padding is left out. Point topologies follow from
    edges, or else faces. Coordinates of edges and faces have bounds from their nodes; without coordinates of their own they
    have bounds only. Those of all coordinates come from one join, written once for all variables at a location and kept in `known`."""
    a = r["attributes"]
    name, location = a.get("mesh"), a.get("location", "")
    if (dataset, name) not in described or location not in CELLS:
        return []
    m = described[dataset, name]["attributes"]
    ids = lambda key: _ids(read(m[key], last="array"), described[dataset, m[key]]["attributes"])
    nodes = [x for x in m.get("node_coordinates", "").split() if (dataset, x) in described]
    if location == "node":
        axis = described[dataset, nodes[0]]["dimensions"][0] if nodes else [*sizes][-1]
    else:
        axis = described[dataset, m[f"{location}_node_connectivity"]]["dimensions"][0]
    if axis not in sizes:
        raise ValueError(f"{r['variable']} does not span {axis}, the {location} dimension of {name}")
    size = sizes[axis]
    out = []
    if location == "node":
        if m.get("edge_node_connectivity"):
            points = M.points_from_edges(ids("edge_node_connectivity").df.select(F.get("value", F.lit(0)).alias("a"), F.get("value", F.lit(1)).alias("b")))
        else:
            points = M.points_from_faces(ids("face_node_connectivity").df, "value")
        rows = M.with_own(points, "node", "neighbours", "value").select(F.col("node").alias(axis), "value")
    else:
        rows = ids(f"{location}_node_connectivity").df
    topology = Cells(rows, (axis,), (size,))
    out.append(Construct(f"topology_{location}", "domain_topology", (axis,), cell=CELLS[location], data=topology, ncvar=m.get(f"{location}_node_connectivity")))
    key = f"{location}_{location}_connectivity"
    if m.get(key):
        links = ids(key)
        own = M.cell_connectivity(links.df, axis, "value").select(axis, F.col("row").alias("value"))
        out.append(Construct(f"connectivity_{location}", "cell_connectivity", (axis,), connectivity={"face": "edge", "edge": "node"}.get(location, location), data=Cells(own, (axis,), (size,)), ncvar=m[key]))
    mine = [x for x in m.get(f"{location}_coordinates", "").split() if (dataset, x) in described]
    named = lambda x: {k: v for k, v in described[dataset, x]["attributes"].items() if k not in ("units", "calendar", "_FillValue", "bounds")}
    beside = {named(x).get("standard_name", x): x for x in mine}
    edges = _bounds(topology, axis, nodes, read, (name, location), {} if known is None else known) if location != "node" and nodes else {}
    for x in mine if location == "node" else nodes:
        own = x if location == "node" else beside.get(named(x).get("standard_name", x))
        out.append(Construct(own or x, "auxiliary_coordinate", (axis,), named(own or x), ncvar=own or x, data=read(own) if own else None, bounds=edges.get(x)))
    return out


def _bounds(topology: Cells, axis: str, nodes: list[str], read: Callable[..., Cells], key: tuple[str, str], known: dict) -> dict[str, DataFrame]:
    """(axis, bounds) of each coordinate of the nodes."""
    if key not in known:
        at = None
        for k, x in enumerate(nodes):
            there = read(x)
            one = there.df.select(F.col(there.axes[0]).alias("_node"), there.v.alias(f"_x{k}"))
            at = one if at is None else at.join(one, "_node", "full")
        known[key] = written(M.bounds_of_all(topology.df.withColumnRenamed("value", "_nodes"), axis, "_nodes", at, "_node", [f"_x{k}" for k in range(len(nodes))]), "bounds")
    return {x: known[key].select(axis, F.col(f"_x{k}").alias("bounds")) for k, x in enumerate(nodes)}


def _ids(cells: Cells, attributes: dict) -> Cells:
    start = int(float(attributes.get("start_index", 0)))
    return replace(cells, df=cells.df.select(*cells.axes, F.transform(F.array_compact(cells.v), lambda x: x.cast("long") - start).alias("value")), value="value")


@dataclass
class Plan:
    """A mesh to write: its variable's attributes, and for each variable its dimensions, type, attributes and cells."""

    attributes: dict = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    variables: dict[str, tuple] = field(default_factory=dict)
    axes: dict[int, tuple[str, str]] = field(default_factory=dict)  # of each field: the axis along the mesh, and its location
    moves: dict[int, DataFrame] = field(default_factory=dict)  # of fields on nodes: the node of each position

    def moved(self, k: int, c: Cells) -> Cells:
        """Cells of a field on nodes in the order of the nodes; others as they are."""
        axis = self.axes[k][0]
        if k not in self.moves or axis not in c.axes:
            return c
        rows = c.df.join(self.moves[k], F.col(axis) == F.col("_at")).select(*(F.col("_node").alias(a) if a == axis else F.col(a) for a in c.axes), c.v.alias(c.value))
        return replace(c, df=rows)


def topology_of(f: Field) -> Construct | None:
    return next((c for c in f.constructs if c.type == "domain_topology"), None)


def planned(spark: SparkSession, fields: list[Field], name: Callable[[str], str]) -> list[Plan]:
    """The meshes of fields with domain topologies. Fields that linked() finds on one mesh share it; one job compares all.

    Node ids are ranked among all ids of a mesh. A kind of cell is written once for a mesh, points as edges if it has
    neither edges nor faces. Node coordinates come from a field on nodes, or else from the bounds of cells."""
    own = {k: c for k, f in enumerate(fields) if (c := topology_of(f))}
    if not own:
        return []
    union = None
    for k, c in own.items():
        one = c.data.df.select(F.lit(k).alias("domain"), F.lit(c.cell).alias("kind"), F.col(c.axes[0]).alias("cell"), c.data.v.cast("array<bigint>").alias("nodes"))
        union = one if union is None else union.unionByName(one)
    union = written(union, "mesh")
    groups: dict[int, list[int]] = {}
    for r in M.linked(union).collect():  # a row for each field
        groups.setdefault(r["mesh"], []).append(r["domain"])
    out = []
    for members in (sorted(x) for x in groups.values()):
        rows = union.where(F.col("domain").isin(members))
        ids = rows.select(F.explode("nodes").alias("id")).where("id is not null").distinct()
        rank = written(dense_places(written(ids, "mesh"), "id", 0, "node").select("id", "node"), "mesh")
        n = rank.count()

        def ranked(k: int) -> DataFrame:
            """(cell, _k, node) of one field, a row for each node, lazily: only cells that are written are ranked."""
            flat = rows.where(F.col("domain") == k).select("cell", F.posexplode("nodes").alias("_k", "id"))  # noqa: B023
            return flat.join(rank, "id", "left").select("cell", "_k", "node")  # noqa: B023

        p = Plan({"cf_role": "mesh_topology", "topology_dimension": np.int32(2 if any(own[k].cell == "face" for k in members) else 1)})
        at = name("nodes")
        p.sizes[at] = n
        kinds = {own[k].cell: k for k in reversed(members)}
        for k in members:
            location = {v: x for x, v in CELLS.items()}[own[k].cell]
            axis = own[k].axes[0]
            p.axes[k] = (axis, location)
            if location == "node":
                p.moves[k] = written(own[k].data.df.select(F.col(axis).alias("_at"), F.get(own[k].data.v, F.lit(0)).alias("id")).join(rank, "id").select("_at", F.col("node").alias("_node")), "mesh")
        for location, kind in (("edge", "edge"), ("face", "face")):
            if kind in kinds:
                k = kinds[kind]
                width = rows.where(F.col("domain") == k).agg(F.max(F.size("nodes"))).first()[0] if kind == "face" else 2
                _put(p, name, location, ranked(k), own[k].data.shape[0], width or 1)
        if set(kinds) == {"point"}:
            points = M.normalised(rows.where(F.col("domain") == kinds["point"]), "cell", "nodes", ranks=rank)
            edges = written(M.edges_from_points(points.select(F.get("nodes", F.lit(0)).alias("node"), F.slice("nodes", 2, 1 << 20).alias("neighbours"))), "mesh")
            numbered = dense_places(edges.withColumn("_key", F.col("a") * n + F.col("b")), "_key", n * n, "cell")
            _put(p, name, "edge", numbered.select("cell", F.posexplode(F.array("a", "b")).alias("_k", "node")), edges.count(), 2)
        _coordinates(p, name, at, n, fields, own, members, ranked)
        out.append(p)
    return out


def _put(p: Plan, name: Callable[[str], str], location: str, rows: DataFrame, size: int, width: int) -> None:
    """The nodes of cells (cell, _k, node) as an array of two axes: rows go to their places, and no list is made of them."""
    axis, corners = name(f"{location}s"), name(f"{location}_corners")
    p.sizes |= {axis: size, corners: width}
    variable = name(f"{location}_nodes")
    cells = Cells(rows.where("node is not null").select(F.col("cell").alias(axis), F.col("_k").cast("long").alias(corners), F.col("node").alias("value")), (axis, corners), (size, width))
    p.variables[variable] = ((axis, corners), "i4", {"cf_role": f"{location}_node_connectivity", "start_index": np.int32(0), "_FillValue": np.int32(-1)}, cells)
    p.attributes[f"{location}_node_connectivity"] = variable
    p.attributes[f"{location}_dimension"] = axis


def _coordinates(p: Plan, name: Callable[[str], str], at: str, n: int, fields: list[Field], own: dict, members: list[int], ranked: Callable[[int], DataFrame]) -> None:
    """Coordinates of the nodes, and of the cells that have some of their own."""
    done: dict[str, str] = {}
    for k in sorted(members, key=lambda k: own[k].cell != "point"):
        axis, location = p.axes[k]
        for c in fields[k].constructs:
            if c.type != "auxiliary_coordinate" or c.axes != (axis,):
                continue
            label = c.properties.get("standard_name") or c.ncvar or c.key
            units = {"units": c.data.units} if c.data is not None and c.data.units else {}
            if label not in done and (location == "node" or c.bounds is not None):
                if location == "node":
                    moved = p.moved(k, c.data)
                    rows = moved.df.select(F.col(axis).alias(at), moved.v.cast("double").alias("value"))
                else:
                    # As M.node_coordinates() does: of each node what is said where it first occurs.
                    flat = ranked(k).where("node is not null").join(c.bounds.select(F.col(axis).alias("cell"), "bounds"), "cell")
                    found = flat.groupBy("node").agg(F.min_by(F.get("bounds", F.col("_k")), F.struct("cell", "_k")).alias("_x"))
                    rows = found.select(F.col("node").cast("long").alias(at), F.col("_x").cast("double").alias("value"))
                done[label] = variable = name(f"node_{c.ncvar or c.properties.get('standard_name') or c.key}")
                p.variables[variable] = ((at,), "f8", {**c.properties, **units}, Cells(rows, (at,), (n,)))
                p.attributes["node_coordinates"] = f"{p.attributes.get('node_coordinates', '')} {variable}".strip()
            if location != "node" and c.data is not None:
                on = p.attributes[f"{location}_dimension"]
                variable = name(f"{location}_{c.ncvar or c.key}")
                p.variables[variable] = ((on,), "f8", {**c.properties, **units}, Cells(c.data.df.select(F.col(axis).alias(on), c.data.v.cast("double").alias("value")), (on,), c.data.shape))
                p.attributes[f"{location}_coordinates"] = f"{p.attributes.get(f'{location}_coordinates', '')} {variable}".strip()
