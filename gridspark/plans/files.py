"""Queries on files as fields: what datasets refer to, and fields written and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cells, Construct, Field
from ..operators import mesh, ragged
from ..operators.ordering import dense_places, lists
from ..sources import dataset
from ..sources.scratch import scratch, written
from ..sources.tables import table
from .registry import query


@query(
    "WITH c AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) - 1 AS c, c_custkey, c_acctbal::DOUBLE AS b, c_mktsegment, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT 'region' || region AS field, c, CASE WHEN b BETWEEN 0 AND 5000 THEN b END AS balance, 2.0 * c AS place, [2.0 * c - 1, 2.0 * c + 1]::DOUBLE[] AS bounds, c_custkey, c_mktsegment AS segment, n_nationkey::INTEGER AS nation, (c_custkey % 100)::SMALLINT AS flag FROM c"
)
def fields_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file of each region's customers, cell measures in others: written, found again by what the files refer to, and joined along the axes of the fields."""
    everyone = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    folder = scratch(spark, "fields")
    dataset.make(folder)
    regions = [r[0] for r in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # five
    sizes = {r[0]: r[1] for r in everyone.groupBy("n_regionkey").count().collect()}
    paths, others = [], []
    for r in regions:
        n = sizes.get(r, 0)
        dense_places(everyone.where(F.col("n_regionkey") == r), "c_custkey", n, "c").write.parquet(f"{folder}/rows{r}")
        rows = spark.read.parquet(f"{folder}/rows{r}")
        along = lambda value: Cells(rows.select("c", value.alias("value")), ("c",), (n,))  # noqa: B023, E731
        place = F.col("c") * 2.0
        field = Field(
            along(F.col("c_acctbal").cast("double")),
            (
                Construct("c", "domain_axis", size=n, ncdim="customer"),
                Construct("d", "dimension_coordinate", ("c",), {"long_name": "place"}, data=along(place), bounds=rows.select("c", F.array(place - 1, place + 1).alias("bounds"))),
                Construct("a", "auxiliary_coordinate", ("c",), {"long_name": "key"}, ncvar="custkey", data=along(F.col("c_custkey").cast("long"))),
                Construct("s", "auxiliary_coordinate", ("c",), {"long_name": "segment"}, ncvar="segment", data=along(F.col("c_mktsegment"))),
                Construct("m", "cell_measure", ("c",), {}, ncvar=f"nation{r}", measure="area", data=along(F.col("n_nationkey").cast("int"))),
                Construct("f", "field_ancillary", ("c",), {"long_name": "flag"}, ncvar="flag", data=along((F.col("c_custkey") % 100).cast("smallint"))),
            ),
            {"long_name": f"region{r}", "valid_min": 0.0, "valid_max": 5000.0},
        )
        paths.append(f"{folder}/{r}.nc")
        others.append(f"{folder}/{r}-measures.nc")
        dataset.write([field], paths[-1], others[-1])
    out = None
    for f in dataset.read(spark, paths, others):
        axis = f.data.axes[0]
        by = {c.properties.get("long_name", c.type): c for c in f.constructs if c.data is not None}
        rows = f.data.df.withColumnRenamed("value", "balance").join(by["place"].bounds, axis)
        for name, value in (("place", "place"), ("key", "c_custkey"), ("segment", "segment"), ("cell_measure", "nation"), ("flag", "flag")):
            rows = rows.join(by[name].data.df.withColumnRenamed("value", value), axis)
        rows = rows.select(F.lit(f.properties["long_name"]).alias("field"), F.col(axis).alias("c"), "balance", "place", "bounds", "c_custkey", "segment", "nation", "flag")
        out = rows if out is None else out.unionByName(rows)
    return out


_LINES = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_SAMPLES = f"""o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) - 1 AS e, CASE WHEN l_quantity > 10 THEN l_quantity::DOUBLE END AS quantity, CASE WHEN l_quantity < 30 THEN l_extendedprice::DOUBLE END AS price FROM lineitem)"""


def _sampled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """(orders with their number i and their place p among those of customer c, lines e with some values missing, how many of i, c, p, e)."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    path = scratch(spark, "sampled")
    # Each is numbered once and written; sizes come from what is written.
    ragged.indexed(dense_places(orders, "o_orderkey", 0, "i"), "c", ["o_orderkey"], "p").write.parquet(f"{path}/orders")
    orders = spark.read.parquet(f"{path}/orders")
    q = F.col("l_quantity")
    lines = ragged.indexed(table(spark, sf, "lineitem"), "l_orderkey", _LINES.split(", ")).select(F.col("l_orderkey").alias("o_orderkey"), "e", F.when(q > 10, q.cast("double")).alias("quantity"), F.when(q < 30, F.col("l_extendedprice").cast("double")).alias("price"))
    orders.join(lines, "o_orderkey").write.parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")
    n, c, p = orders.agg(F.count("*"), F.max("c") + 1, F.max("p") + 1).first()
    return orders, lines, (n, c, p, lines.agg(F.max("e") + 1).first()[0])


def _by_order(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Orders as instances with their lines as samples, stored in that way and read back."""
    orders, lines, (n, _, _, e) = _sampled(spark, sf)
    on = lambda name: Cells(lines.select("i", "e", F.col(name).alias("value")), ("i", "e"), (n, e))
    key = Cells(orders.select("i", F.col("o_orderkey").alias("value")), ("i",), (n,))
    named = lambda key, axes, data: Construct(key, "auxiliary_coordinate", axes, {"long_name": key}, ncvar=key, data=data)
    f = Field(on("quantity"), (Construct("i", "domain_axis", size=n, ncdim="order"), named("price", ("i", "e"), on("price")), named("key", ("i",), key)), {"long_name": "quantity"})
    path = scratch(spark, "dsg")
    dataset.write([f], path, compress=kind, attributes={"featureType": "timeSeries"})
    (g,) = dataset.read(spark, [path])
    price, key = (g.construct(f"long_name={k}").data.df.withColumnRenamed("value", k) for k in ("price", "key"))
    rows = g.data.df.withColumnRenamed("value", "quantity").join(price, list(g.data.axes)).join(key, g.data.axes[0])
    return rows.select(F.col(g.data.axes[0]).alias("i"), F.col("element").alias("e"), "quantity", "price", "key")


_BY_ORDER = f"WITH {_SAMPLES} SELECT i, e, quantity, price, o_orderkey AS key FROM o JOIN l ON o_orderkey = l_orderkey"


@query(_BY_ORDER)
def dsg_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    return _by_order(spark, sf, "contiguous")


@query(_BY_ORDER)
def dsg_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return _by_order(spark, sf, "indexed")


@query(
    f"WITH {_SAMPLES}, k AS (SELECT c, max(p) AS last FROM o JOIN l ON o_orderkey = l_orderkey GROUP BY c) SELECT c, p, e, quantity, price FROM o JOIN k USING (c) JOIN l ON o_orderkey = l_orderkey WHERE p <= last"
)
def dsg_indexed_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as instances, their orders as profiles and lines as samples."""
    _, lines, (_, c, p, e) = _sampled(spark, sf)
    on = lambda name: Cells(lines.select("c", "p", "e", F.col(name).alias("value")), ("c", "p", "e"), (c, p, e))
    price = Construct("price", "auxiliary_coordinate", ("c", "p", "e"), {"long_name": "price"}, ncvar="price", data=on("price"))
    path = scratch(spark, "dsg")
    dataset.write([Field(on("quantity"), (price,), {"long_name": "quantity"})], path, compress="indexed_contiguous", attributes={"featureType": "timeSeriesProfile"})
    (g,) = dataset.read(spark, [path])
    rows = g.data.df.withColumnRenamed("value", "quantity").join(g.construct("long_name=price").data.df.withColumnRenamed("value", "price"), list(g.data.axes))
    return rows.select(*(F.col(a).alias(b) for a, b in zip(g.data.axes, ("c", "p", "e"))), "quantity", "price")


_NAMES = """v AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS n, l_suppkey % 3 AS a FROM lineitem),
q AS (SELECT d, n, 'coordinates' AS role, NULL AS term, 'v' || (n + 1) AS target FROM v UNION ALL SELECT d, n, 'ancillary_variables', NULL, 'v' || (n + a) FROM v
  UNION ALL SELECT d, n, 'cell_measures', 'area', 'x' || n FROM v UNION ALL SELECT d, n, 'dimension', NULL, 'v' || n FROM v WHERE n = 4)"""


@query(
    f"WITH {_NAMES}, e AS (SELECT 'x' || n_regionkey AS target, min('e' || n_nationkey) AS place FROM nation GROUP BY n_regionkey HAVING count(*) = 1 UNION ALL SELECT 'x' || r_regionkey + 5, 'r' || r_regionkey FROM region) "
    "SELECT 'o' || q.d AS dataset, 'v' || q.n AS variable, role, term, q.target, CASE WHEN t.d IS NOT NULL THEN 'o' || q.d WHEN role = 'cell_measures' AND q.n <> 6 THEN place END AS found_in, "
    "CASE WHEN t.d IS NOT NULL THEN 'found' WHEN role = 'cell_measures' AND q.n <> 6 AND place IS NOT NULL THEN 'external' ELSE 'missing' END AS state "
    "FROM q LEFT JOIN v t ON q.d = t.d AND q.target = 'v' || t.n LEFT JOIN e ON q.target = e.target"
)
def dataset_references(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as datasets, their lines as variables that refer to each other and to external ones: a catalogue of any size in one go."""
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    d, n, a = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey") % 3
    rows = table(spark, sf, "lineitem").select(d.alias("d"), n.alias("n"), a.alias("a")).distinct()
    n = F.col("n")
    attributes = F.create_map(F.lit("coordinates"), text("v", n + 1), F.lit("ancillary_variables"), text("v", n + F.col("a")), F.lit("cell_measures"), text("area: x", n))
    spans = F.when(n == 4, F.array(F.lit("v4"))).otherwise(F.array(F.lit("other")))
    outside = F.create_map(F.lit("external_variables"), F.lit("x0 x1 x2 x3 x4 x5 x7 x8 x9"))
    variables = rows.select(text("o", F.col("d")).alias("dataset"), text("v", n).alias("variable"), F.lit("double").alias("type"), spans.alias("dimensions"), attributes.alias("attributes"), outside.alias("globals"))
    none = F.create_map().cast("map<string,string>")
    like = lambda df, where, name: df.select(where.alias("dataset"), name.alias("variable"), F.lit("double").alias("type"), F.array(F.lit("other")).alias("dimensions"), none.alias("attributes"), none.alias("globals"))
    external = like(table(spark, sf, "nation"), text("e", F.col("n_nationkey")), text("x", F.col("n_regionkey"))).unionByName(like(table(spark, sf, "region"), text("r", F.col("r_regionkey")), text("x", F.col("r_regionkey") + 5)))
    found = dataset.references(variables, external)
    return found.select("dataset", "variable", "role", "term", "target", "found_in", "state")


@query(
    "WITH f AS (SELECT l_orderkey AS o, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nodes FROM lineitem GROUP BY l_orderkey), i AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS face, nodes FROM f), "
    "x AS (SELECT face, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS k FROM i), r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT DISTINCT id FROM x)) "
    "SELECT face, any_value(o_totalprice)::DOUBLE AS price, list(node ORDER BY k) AS nodes, list(p_retailprice::DOUBLE ORDER BY k) AS lat, list(p_size::DOUBLE ORDER BY k) AS lon "
    "FROM x JOIN r USING (id) JOIN part ON id = p_partkey JOIN i USING (face) JOIN orders ON o_orderkey = o GROUP BY face"
)
def mesh_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as faces of parts, a field on the faces and one on the nodes of the same mesh: written as one mesh with node coordinates, and read back with bounds from nodes."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("nodes"), "l_suppkey").where("l_orderkey is not null")
    prices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("double").alias("price"))
    # What is numbered is read twice, so it is written before.
    faces = written(lists(lines, "l_orderkey", ["l_linenumber", "nodes", "l_suppkey"], ["nodes"]).join(prices, "l_orderkey"), "mesh")
    folder = scratch(spark, "mesh")
    faces = written(dense_places(faces, "l_orderkey", 0, "face").select("face", "nodes", "price"), "mesh")
    n = faces.count()
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("lat"), F.col("p_size").cast("double").alias("lon"))
    on = lambda df, axis, name, size: Cells(df.select(axis, F.col(name).alias("value")), (axis,), (size,))

    # Bounds stay lazy: node coordinates come from the field on nodes, and only where there is none from bounds.
    edges = lambda name: mesh.bounds_from_nodes(faces, "face", "nodes", part, "id", name)
    named = lambda name, axis, **k: Construct(name, "auxiliary_coordinate", (axis,), {"standard_name": {"lat": "latitude", "lon": "longitude"}[name]}, ncvar=name, **k)
    on_faces = Field(on(faces, "face", "price", n), (Construct("t", "domain_topology", ("face",), cell="face", data=on(faces, "face", "nodes", n)), *(named(x, "face", bounds=edges(x)) for x in ("lat", "lon"))), {"long_name": "price"})
    points = mesh.with_own(mesh.points_from_faces(faces), "node", "neighbours").drop("neighbours")
    points = written(points.join(part.withColumnRenamed("id", "node"), "node"), "mesh")
    points = written(dense_places(points, "node", 0, "at").withColumnRenamed("node", "id"), "mesh")
    m = points.count()
    on_nodes = Field(on(points, "at", "lat", m), (Construct("t", "domain_topology", ("at",), cell="point", data=on(points, "at", "row", m)), *(named(x, "at", data=on(points, "at", x, m)) for x in ("lat", "lon"))), {"long_name": "size"})
    dataset.write([on_faces, on_nodes], folder)
    f = next(x for x in dataset.read(spark, [folder]) if x.properties.get("long_name") == "price")
    axis = f.data.axes[0]
    by = {c.identity(): c for c in f.constructs}
    rows = f.data.df.withColumnRenamed("value", "price").join(by["cell:face"].data.df.withColumnRenamed("value", "nodes"), axis)
    for name, k in (("lat", "latitude"), ("lon", "longitude")):
        rows = rows.join(by[k].bounds.withColumnRenamed("bounds", name), axis)
    return rows.select(F.col(axis).alias("face"), "price", "nodes", "lat", "lon")


@query(
    """WITH o AS (SELECT 'o' || o_orderkey AS dataset, o_orderkey AS k FROM orders)
SELECT dataset, 'mesh' AS object, 'mesh' AS rule, 'node_coordinates are missing' AS message FROM o WHERE k % 3 = 0
UNION ALL SELECT dataset, 'mesh', 'mesh', 'face_coordinates are not as many as node_coordinates' FROM o
UNION ALL SELECT dataset, 't', 'mesh', CASE WHEN k % 7 = 0 THEN 'other is no mesh' WHEN k % 4 = 0 THEN 'no location volume' ELSE 'the mesh has no face_node_connectivity' END FROM o WHERE k % 7 = 0 OR k % 4 = 0 OR k % 2 = 0
UNION ALL SELECT dataset, 't', 'reference', 'mesh names absent other' FROM o WHERE k % 7 = 0
UNION ALL SELECT dataset, 'mesh', 'reference', 'node_coordinates names absent lon' FROM o WHERE k % 3 <> 0
UNION ALL SELECT dataset, 't', 'reference', 'coordinates names absent lost' FROM o
UNION ALL SELECT dataset, 't', 'dimensions', 'coordinates wide spans extra' FROM o
UNION ALL SELECT dataset, 'lat', 'bounds', 'edges: dimensions must be those of the parent and one more' FROM o WHERE k % 5 = 0
UNION ALL SELECT dataset, 't', 'grid_mapping', 'crs has no grid_mapping_name' FROM o WHERE k % 6 = 0
UNION ALL SELECT dataset, 'rows', 'sample_dimension', 'no dimension obs' FROM o"""
)
def conformance_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a dataset of seven variables with some things wrong: the report on all of them."""
    from . import conformance

    k = F.col("o_orderkey")
    given = lambda test, *pairs: F.when(test, F.create_map(*map(F.lit, pairs))).otherwise(F.create_map().cast("map<string,string>"))
    always, text = F.lit(True), lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    rows = [
        ("t", text("x"), F.map_concat(given(always, "coordinates", "lat wide lost", "grid_mapping", "crs"), F.create_map(F.lit("mesh"), F.when(k % 7 == 0, "other").otherwise("mesh"), F.lit("location"), F.when(k % 4 == 0, "volume").when(k % 2 == 0, "face").otherwise("edge")))),
        ("lat", text("x"), given(always, "bounds", "edges")),
        ("edges", F.when(k % 5 == 0, text("two", "x")).otherwise(text("x", "two")), given(~always)),
        ("wide", text("x", "extra"), given(~always)),
        ("crs", text(), given(k % 6 != 0, "grid_mapping_name", "mercator")),
        ("mesh", text(), F.map_concat(given(always, "cf_role", "mesh_topology", "face_coordinates", "lat lat lat", "edge_node_connectivity", "edges"), given(k % 3 != 0, "node_coordinates", "lat lon"))),
        ("rows", text("x"), given(always, "sample_dimension", "obs")),
    ]
    one = F.array(*(F.struct(F.lit(v).alias("variable"), F.lit("double").alias("type"), d.alias("dimensions"), a.alias("attributes"), F.create_map().cast("map<string,string>").alias("globals")) for v, d, a in rows))
    variables = table(spark, sf, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("dataset"), F.inline(one))
    return conformance.datasets(variables, dataset.references(variables))
