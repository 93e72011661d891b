"""Mesh topology: faces, edges and points by their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import dense_places, lists


def polygon(nodes: Column | str) -> Column:
    """The nodes of a face without padding."""
    return F.array_compact(nodes)


def edges_from_faces(faces: DataFrame, nodes: str = "nodes") -> DataFrame:
    """(a, b), a < b: the distinct undirected edges of face polygons, each node joined to the next and the last to the first. Padding nodes (NULL) are left out."""
    return _sides(faces, nodes).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _sides(faces: DataFrame, nodes: str) -> DataFrame:
    """(x, y): each side of each polygon."""
    p = faces.select(polygon(nodes).alias("p")).where(F.size("p") > 1)
    return p.select("p", F.posexplode("p").alias("k", "x")).select("x", F.get("p", (F.col("k") + 1) % F.size("p")).alias("y")).where("x <> y")


def edges_from_points(points: DataFrame, own: str = "node", neighbours: str = "neighbours") -> DataFrame:
    """The distinct undirected edges of a point topology."""
    pairs = points.select(F.col(own).alias("x"), F.explode(F.array_compact(neighbours)).alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def points_from_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, neighbours): the nodes that share an edge with each node, in order. Edges may be there several times."""
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("neighbours"))
    both = edges.where(F.col(a) != F.col(b)).select(F.explode(F.array(way(a, b), way(b, a))).alias("_e")).select("_e.*")
    return lists(both, "node", ["neighbours"], ["neighbours"], distinct=True)


def points_from_faces(faces: DataFrame, nodes: str = "nodes") -> DataFrame:
    """(node, neighbours): the nodes before and after each node in its polygons. Sides of several polygons meet where neighbours are sorted, not before."""
    return points_from_edges(_sides(faces, nodes), "x", "y")


def with_own(df: DataFrame, own: str, others: str, name: str = "row") -> DataFrame:
    """Rows as a topology stores them: the own id first."""
    return df.withColumn(name, F.concat(F.array(own), F.col(others)))


def cell_connectivity(links: DataFrame, cell: str = "cell", neighbours: str = "neighbours", start_index: int = 0) -> DataFrame:
    """(cell, row): own id and those of the neighbours, counted from zero; padding is left out."""
    return links.select(cell, F.concat(F.array(F.col(cell)), F.transform(F.array_compact(neighbours), lambda x: x - start_index)).alias("row"))


def normalised(cells: DataFrame, cell: str, nodes: str, start_index: int = 0, ranks: DataFrame | None = None) -> DataFrame:
    """Node ids replaced by their rank among all ids in use; NULL padding stays where it is, and a cell without nodes has an empty list.

    Ranks come from the distinct ids, dealt over ranges of the id and counted in two levels; or they are given: (id, node), from 0."""
    flat = cells.select(cell, F.posexplode_outer(nodes).alias("_k", "_id"))
    if ranks is None:
        # The size, which dense_places() does not read, would take a job of its own.
        ranks = dense_places(flat.where("_id is not null").select(F.col("_id").alias("id")).distinct(), "id", 0, "node")
    rank = ranks.select(F.col("id").alias("_id"), (F.col("node") + start_index).cast("long").alias("_new"))
    back = flat.join(rank, "_id", "left").groupBy(cell).agg(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_new")))).alias("_x"))
    return back.select(cell, F.transform("_x", lambda x: x["_new"]).alias(nodes))


def normalised_connectivity(links: DataFrame, cell: str, neighbours: str, start_index: int = 0) -> DataFrame:
    """Own ids become 0, 1, ... in their order, counted in two levels; neighbours that are no cell are dropped, the rest sorted."""
    ids = links.select(F.col(cell).alias("_id")).where("_id is not null").distinct()
    # The size, which dense_places() does not read, would take a job of its own.
    place = dense_places(ids, "_id", 0, "_place").select("_id", (F.col("_place") + start_index).cast("long").alias("_new"))
    flat = links.select(cell, F.explode_outer(neighbours).alias("_id")).join(place, "_id", "left")
    rows = flat.groupBy(cell).agg(F.array_sort(F.collect_set("_new")).alias(neighbours))
    return rows.join(place.withColumnRenamed("_id", cell), cell).select(F.col("_new").alias(cell), neighbours)


def sorted_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).orderBy(a, b)


def node_coordinates(cells: DataFrame, cell: str, nodes: str, bounds: str, name: str = "coordinate") -> DataFrame:
    """(node, coordinate): of each node what the bounds say where it first occurs."""
    flat = cells.select(cell, F.posexplode(F.arrays_zip(F.col(nodes).alias("n"), F.col(bounds).alias("x"))).alias("_k", "_z")).where("_z.n is not null")
    return flat.groupBy(F.col("_z.n").alias("node")).agg(F.min_by("_z.x", F.struct(cell, "_k")).alias(name))


def bounds_from_nodes(cells: DataFrame, cell: str, nodes: str, coordinates: DataFrame, node: str, value: str) -> DataFrame:
    """(cell, bounds): the coordinates of a cell's nodes in their order; padding stays missing."""
    return bounds_of_all(cells, cell, nodes, coordinates, node, [value]).select(cell, F.col(value).alias("bounds"))


def bounds_of_all(cells: DataFrame, cell: str, nodes: str, coordinates: DataFrame, node: str, values: list[str]) -> DataFrame:
    """(cell, and a column of bounds for each of several coordinates), from one join: see bounds_from_nodes()."""
    flat = cells.select(cell, F.posexplode_outer(nodes).alias("_k", node))
    return lists(flat.join(coordinates.select(node, *values), node, "left"), cell, ["_k"], values)


def linked(topologies: DataFrame, domain: str = "domain", kind: str = "kind", nodes: str = "nodes") -> DataFrame:
    """(domain, mesh): the mesh of each domain, named by the smallest of its domains; `kind` of a row is face, edge or point, its nodes a polygon, two ends, or a point and its neighbours.

    Domains are of one mesh if their topologies imply the same edges and, where they have faces, the same faces, told by
    their sets of nodes. Whatever the order of rows, and of nodes in an edge, each domain gets a fingerprint of its
    distinct edges and one of its faces: counts and two hashes combined by exclusive or, partially aggregated. Edges and faces go
    through one pass and one shuffle, by domain and two hashes of their own. Domains meet by fingerprints, no pair of them is
    compared. One without faces joins the domains with its edges, of several meshes with them the first. A domain
    without edges stands alone."""
    none = F.array().cast(topologies.schema[nodes].dataType)
    rows = topologies.select(domain, kind, F.coalesce(polygon(nodes), none).alias("_p"))
    is_face, n, k, x = F.col(kind) == "face", F.size("_p"), F.col("_k"), F.col("_x")
    # A row for each node, and for faces one more that stands for the face: what follows is generated code, without a function over arrays.
    flat = rows.select(domain, kind, "_p", F.posexplode_outer(F.when(is_face, F.concat("_p", F.array(F.lit(None)))).otherwise(F.col("_p"))).alias("_k", "_x"))
    first, following = F.get("_p", F.lit(0)), F.get("_p", F.when(k + 1 < n, k + 1).otherwise(0))
    own_face = is_face & (k == n)
    start = F.when(is_face, x).otherwise(first)
    end = F.when(is_face, following).when(F.col(kind) == "edge", F.when(k == 1, x)).otherwise(F.when(k > 0, x))
    told = lambda seed: F.when(F.col("_own"), F.xxhash64(F.lit(seed), F.sort_array(F.array_distinct("_p")))).when(F.col("_a") != F.col("_b"), F.xxhash64(F.lit(seed), F.least("_a", "_b"), F.greatest("_a", "_b")))
    items = flat.select(domain, "_p", own_face.alias("_own"), start.alias("_a"), end.alias("_b"))
    items = items.select(domain, F.when(F.col("_own"), True).when(F.col("_a") != F.col("_b"), False).alias("face"), told(1).alias("h1"), told(2).alias("h2"))
    # Edges count once, faces as often as they occur; a row without either keeps its domain.
    items = items.groupBy(domain, "face", "h1", "h2").agg(F.count("*").alias("n"))
    face, edge = F.coalesce("face", F.lit(False)), F.coalesce(~F.col("face"), F.lit(False))
    mixed = lambda which, h: F.coalesce(F.bit_xor(F.when(which, h)), F.lit(0).cast("long"))
    own = items.groupBy(domain).agg(
        F.count_if(edge).alias("_en"), mixed(edge, F.col("h1")).alias("_e1"), mixed(edge, F.col("h2")).alias("_e2"),
        F.count_if(face).alias("_fn"), mixed(face, F.xxhash64("h1", "n")).alias("_f1"), mixed(face, F.xxhash64("h2", "n")).alias("_f2"),
    )
    # Domains without edges meet nothing, and not each other in one task.
    own = own.withColumn("_e1", F.when(F.col("_en") > 0, F.col("_e1")).otherwise(F.xxhash64(domain)))
    by_edges, keys = ["_en", "_e1", "_e2"], ["_en", "_e1", "_e2", "_fn", "_f1", "_f2"]
    meshes = own.where("_en > 0").groupBy(*keys).agg(F.min(domain).alias("_least"))
    bare = F.col("_fn") == 0
    # The first mesh with the edges takes the domains without faces along, and so may get a smaller name.
    first = meshes.groupBy(*by_edges).agg(F.min(F.when(~bare, F.col("_least"))).alias("_first"), F.min("_least").alias("_all"))
    named = meshes.join(first.hint("merge"), by_edges).select(*keys, F.when(bare | (F.col("_least") == F.col("_first")), F.col("_all")).otherwise(F.col("_least")).alias("_mesh"))
    return own.join(named.hint("merge"), keys, "left").select(domain, F.coalesce("_mesh", domain).alias("mesh"))


def without_empty_columns(cells: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Rows of equal length cut to the columns from the first to the last in which any row has a value; one row of bounds is broadcast."""
    at = cells.select(F.posexplode(nodes).alias("_k", "_x")).where("_x is not null").agg(F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    cut = F.when(F.col("_low").isNull(), F.slice(nodes, 1, 0)).otherwise(F.slice(nodes, F.coalesce("_low", F.lit(0)) + 1, F.coalesce(F.col("_high") - F.col("_low") + 1, F.lit(0))))
    return cells.crossJoin(F.broadcast(at)).withColumn(nodes, cut).drop("_low", "_high")
