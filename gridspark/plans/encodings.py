"""Queries on encodings: ragged, gathered, tie points, geometry, meshes, fragments."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Cells
from ..operators import fragments, gathered, geometry, mesh, ragged, tiepoints
from ..operators.masking import validity
from ..operators.ordering import dense_places
from ..sources.tables import masked_cells, table, whole_cells
from .arrays import M, Q
from .registry import query

LINE = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(
    "SELECT o_orderkey, max(q) AS max_quantity, min(q) AS min_quantity, sum(q) AS sum_quantity, count(l_orderkey) AS elements FROM orders LEFT JOIN "
    "(SELECT l_orderkey, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS q FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey"
)
def ragged_masked_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as the ragged axis of orders; quantities outside the valid range are missing; orders without lines stay."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.when(~validity(F.col("l_quantity"), valid_range=(5, 45)), F.col("l_quantity")).alias("q"))
    per = lines.groupBy("l_orderkey").agg(F.max("q").alias("max_quantity"), F.min("q").alias("min_quantity"), F.sum("q").alias("sum_quantity"), F.count("*").alias("elements"))
    joined = table(spark, sf, "orders").select("o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "max_quantity", "min_quantity", "sum_quantity", F.coalesce("elements", F.lit(0)).alias("elements"))


@query(f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) - 1 AS e, l_quantity, l_partkey FROM lineitem")
def ragged_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return ragged.indexed(table(spark, sf, "lineitem"), "l_orderkey", LINE.split(", ")).select("l_orderkey", "e", "l_quantity", "l_partkey")


def _contiguous(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(samples numbered in the order of vector and component, counts of vectors): the masked field, compressed."""
    return ragged.compress_contiguous(masked_cells(spark, sf), "j")


_RAGGED_WHOLE = f"{M}, n AS (SELECT i, coalesce(max(CASE WHEN value IS NOT NULL THEN j + 1 END), 0) AS n FROM m GROUP BY i), s AS (SELECT i, n, coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n)"


@query(f"WITH {_RAGGED_WHOLE} SELECT start + j AS o, value FROM s JOIN m USING (i) WHERE j < n")
def ragged_compress(spark: SparkSession, sf: str) -> DataFrame:
    return _contiguous(spark, sf)[0]


@query(f"WITH {_RAGGED_WHOLE} SELECT start + j AS o, i AS index, value FROM s JOIN m USING (i) WHERE j < n")
def ragged_compress_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return ragged.compress_indexed(masked_cells(spark, sf), "j")


@query(f"WITH {_RAGGED_WHOLE} SELECT i, j AS e, start + j AS o, value FROM s JOIN m USING (i) WHERE j < n")
def ragged_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    samples, counts = _contiguous(spark, sf)
    return ragged.contiguous(samples, counts, "o", "i", "count").where("e is not null").select("i", "e", "o", "value")


@query(f"WITH {M} SELECT i, j AS e, value FROM m")
def ragged_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    samples, counts = _contiguous(spark, sf)
    return ragged.padded(ragged.contiguous(samples, counts, "o", "i", "count"), "i", "e", ["value"], 64)


@query(
    f"WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders), "
    f"l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) - 1 AS e FROM lineitem) SELECT o_custkey, p, e, l_quantity FROM o LEFT JOIN l ON o_orderkey = l_orderkey"
)
def ragged_indexed_contiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' profiles are orders, by index; orders' samples are lines, by count."""
    lines = ragged.indexed(table(spark, sf, "lineitem"), "l_orderkey", LINE.split(", "))
    counts = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey", "left")
    # Stored end to end in the order of the orders, as a file has them.
    starts = ragged.running_start(counts.withColumn("n", F.coalesce("n", F.lit(0))), "o_orderkey", "n", "start")
    samples = lines.join(starts.select(F.col("o_orderkey").alias("l_orderkey"), "start"), "l_orderkey").select((F.col("start") + F.col("e")).alias("o"), "l_quantity")
    return ragged.indexed_contiguous(samples, counts, "o", "o_orderkey", "o_custkey", "n").select("o_custkey", "p", "e", "l_quantity")


_PROFILES = f"""o AS (SELECT o_custkey AS c, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p FROM orders),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) - 1 AS e, CASE WHEN l_quantity > 10 THEN l_quantity END AS value FROM lineitem),
n AS (SELECT c, p, coalesce(max(CASE WHEN value IS NOT NULL THEN e + 1 END), 0) AS n FROM o LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY c, p),
k AS (SELECT c, p, n, row_number() OVER (ORDER BY c, p) - 1 AS profile, coalesce(sum(n) OVER (ORDER BY c, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM n JOIN (SELECT c, max(p) AS last FROM n WHERE n > 0 GROUP BY c) USING (c) WHERE p <= last)"""


def _profiles(spark: SparkSession, sf: str) -> Cells:
    """Customers' orders and their lines, small quantities missing, on (customer, profile, element)."""
    lines = ragged.indexed(table(spark, sf, "lineitem"), "l_orderkey", LINE.split(", ")).select(F.col("l_orderkey").alias("o_orderkey"), "e", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("value"))
    orders = ragged.indexed(table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), "o_orderkey"), "c", ["o_orderkey"], "p")
    df = orders.join(lines, "o_orderkey", "left").select("c", "p", F.coalesce("e", F.lit(0).cast("long")).alias("e"), "value")
    n = df.agg(*(F.coalesce(F.max(x) + 1, F.lit(0)) for x in ("c", "p", "e"))).first()
    return Cells(df, ("c", "p", "e"), tuple(n))


@query(f"WITH {_PROFILES} SELECT start + e AS o, profile, c AS index, value FROM k JOIN o USING (c, p) JOIN l ON o_orderkey = l_orderkey WHERE e < n")
def ragged_compress_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Samples by profile and profiles by instance, from whole orders and lines; each sample with the profile that owns it."""
    samples, profiles = ragged.compress_indexed_contiguous(_profiles(spark, sf), "p", "e")
    owned = ragged.contiguous(samples, profiles, "o", "profile", "count").where("e is not null")
    return owned.join(profiles, "profile").select("o", "profile", "index", "value")


@query(f"WITH {_PROFILES} SELECT c, p, e, value FROM k JOIN o USING (c, p) LEFT JOIN l ON o_orderkey = l_orderkey AND e < n")
def ragged_roundtrip_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    samples, profiles = ragged.compress_indexed_contiguous(_profiles(spark, sf), "p", "e")
    return ragged.indexed_contiguous(samples, profiles, "o", "profile", "index", "count").select(F.col("index").alias("c"), "p", "e", "value")


@query(f"WITH {Q}, l AS (SELECT i * 64 + j AS place, row_number() OVER (ORDER BY i * 64 + j) - 1 AS item FROM q WHERE value > 20) SELECT item, place, value FROM l JOIN q ON i * 64 + j = place")
def gathered_gather(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    cells, places = gathered.gather(replace(c, df=c.df.where("value > 20")), ("i", "j"))
    return cells.join(places, "item").select("item", "place", "value")


@query(f"WITH {Q} SELECT i, j, value FROM q WHERE value > 20")
def gathered_scatter(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    cells, places = gathered.gather(replace(c, df=c.df.where("value > 20")), ("i", "j"))
    return gathered.scatter(cells, places, "item", "place", c.axes, c.shape)


@query(f"WITH {Q} SELECT i, j, value FROM q WHERE value <> 0")
def sparse_cells(spark: SparkSession, sf: str) -> DataFrame:
    return gathered.sparse(whole_cells(spark, sf)).frame()


_TIE = "t AS (SELECT p_partkey, unnest([0, 4, 5, 13]) AS k, unnest([p_retailprice, p_size, 2.0 * p_size, p_retailprice])::DOUBLE AS u FROM part)"
_AREA = (
    "a AS (SELECT p_partkey, k AS low, lead(k) OVER w AS high, u AS ua, lead(u) OVER w AS ub, coalesce(k - lag(k) OVER w, 0) <= 1 AS first FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY k)), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY low) - 1 AS area FROM a WHERE high - low > 1)"
)


def _ties(spark: SparkSession, sf: str) -> DataFrame:
    """Four tie points of each part, in two continuous areas."""
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    points = F.array(*(F.struct(F.lit(k).cast("long").alias("k"), v.alias("value")) for k, v in ((0, price), (4, size), (5, 2 * size), (13, price))))
    return table(spark, sf, "part").select("p_partkey", F.inline(points))


@query(f"WITH {_TIE}, {_AREA} SELECT p_partkey, i::BIGINT AS i, ua + (i - low) / (high - low) * (ub - ua) AS value FROM s, range(14) r(i) WHERE i <= high AND (i > low OR first AND i = low)")
def tie_linear(spark: SparkSession, sf: str) -> DataFrame:
    return tiepoints.interpolated(_ties(spark, sf), "k", over=["p_partkey"])


@query(
    f"WITH {_TIE}, {_AREA} SELECT p_partkey, i::BIGINT AS i, ua + (i - low) / (high - low) * (ub - ua) + 4 * w * (i - low) / (high - low) * (1 - (i - low) / (high - low)) AS value "
    "FROM s JOIN (VALUES (0, 1.5::DOUBLE), (1, -4.0)) p(n, w) ON area = n, range(14) r(i) WHERE i <= high AND (i > low OR first AND i = low)"
)
def tie_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.createDataFrame([(0, 1.5), (1, -4.0)], "area int, w double")
    return tiepoints.interpolated(_ties(spark, sf), "k", over=["p_partkey"], w="w", parameters=w)


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_extendedprice - (0.75 * l_quantity + 0.25 * 100)) / 0.75 AS w, l_extendedprice AS u FROM lineitem")
def tie_quadratic_parameter(spark: SparkSession, sf: str) -> DataFrame:
    """The parameter that gives a value at a quarter of the way, and the value from it."""
    a, b, u, s = F.col("l_quantity"), F.lit(100.0), F.col("l_extendedprice"), F.lit(0.25)
    w = tiepoints.quadratic_w(a, b, u, s)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("w"), F.round(tiepoints.quadratic(a, b, w, s), 6).alias("u"))


_SURFACE = "part, (VALUES (0, 8, true), (8, 12, false)) s1(low, high, first), (VALUES (0, 4, true), (4, 10, false)) s2(lo2, hi2, first2)"


def _surface(spark: SparkSession, sf: str) -> DataFrame:
    """Nine tie points of a surface for each part."""
    at = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(q).cast("long").alias("q")) for p in (0, 8, 12) for q in (0, 4, 10)))
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size", F.inline(at)).select("p_partkey", "p", "q", (price * F.col("p") + size * F.col("q") + 0.5 * F.col("p") * F.col("q")).alias("value"))


@query(
    f"SELECT p_partkey, i::BIGINT AS i, j::BIGINT AS j, round(p_retailprice * i + p_size * j + 0.5 * i * j, 4)::DOUBLE AS value FROM {_SURFACE}, range(13) a(i), range(11) b(j) "
    "WHERE i <= high AND (i > low OR first AND i = low) AND j <= hi2 AND (j > lo2 OR first2 AND j = lo2)"
)
def tie_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    """A bi-linear surface is restored from its tie points, for every part."""
    return tiepoints.interpolated_2d(_surface(spark, sf), "p", "q", over=["p_partkey"]).select("p_partkey", "i", "j", F.round("value", 4).alias("value"))


@query(
    f"WITH {_TIE}, {_AREA} SELECT p_partkey, i::BIGINT AS i, [round(ua + (i - f) / (high - f + 1) * (ub - ua), 6), round(ua + (i - f + 1) / (high - f + 1) * (ub - ua), 6)]::DOUBLE[] AS bounds "
    "FROM (SELECT *, CASE WHEN first THEN low ELSE low + 1 END AS f FROM s), range(14) r(i) WHERE i BETWEEN f AND high"
)
def tie_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of two continuous areas of each part, from the vertices at their ends."""
    return tiepoints.bounds(_ties(spark, sf), "k", over=["p_partkey"]).select("p_partkey", "i", F.transform("bounds", lambda x: F.round(x, 6)).alias("bounds"))


@query(
    f"WITH c AS (SELECT p_partkey, i, j, p_retailprice AS a, p_size AS b, low + (i - f) * (high - low)::DOUBLE / (high - f + 1) AS x0, low + (i - f + 1) * (high - low)::DOUBLE / (high - f + 1) AS x1, "
    "lo2 + (j - f2) * (hi2 - lo2)::DOUBLE / (hi2 - f2 + 1) AS y0, lo2 + (j - f2 + 1) * (hi2 - lo2)::DOUBLE / (hi2 - f2 + 1) AS y1 "
    f"FROM (SELECT *, CASE WHEN first THEN low ELSE low + 1 END AS f, CASE WHEN first2 THEN lo2 ELSE lo2 + 1 END AS f2 FROM {_SURFACE}), range(13) a(i), range(11) b(j) WHERE i BETWEEN f AND high AND j BETWEEN f2 AND hi2) "
    "SELECT p_partkey, i::BIGINT AS i, j::BIGINT AS j, [round(a * x0 + b * y0 + 0.5 * x0 * y0, 4), round(a * x0 + b * y1 + 0.5 * x0 * y1, 4), round(a * x1 + b * y1 + 0.5 * x1 * y1, 4), round(a * x1 + b * y0 + 0.5 * x1 * y0, 4)]::DOUBLE[] AS bounds FROM c"
)
def tie_bounds_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a bi-linear surface by their corners, for every part."""
    return tiepoints.bounds_2d(_surface(spark, sf), "p", "q", over=["p_partkey"]).select("p_partkey", "i", "j", F.array(*(F.round(F.get("bounds", F.lit(k)), 4) for k in range(4))).alias("bounds"))


@query(
    "WITH p AS (SELECT p_partkey, k, k / 10.0 AS s, radians((p_size % 40)::DOUBLE) AS la, radians(p_partkey % 70 + 10.0) AS oa, radians(p_size % 40 + 15.0) AS lb, radians(p_partkey % 70 + 30.0) AS ob FROM part, range(11) r(k)), "
    "v AS (SELECT *, cos(la) * cos(oa) AS ax, cos(la) * sin(oa) AS ay, sin(la) AS az, cos(lb) * cos(ob) AS bx, cos(lb) * sin(ob) AS by_, sin(lb) AS bz FROM p), "
    "c AS (SELECT *, (1 / sqrt(((ax + bx) * (ax + bx) + (ay + by_) * (ay + by_) + (az + bz) * (az + bz)) / 4) - 1) * 4 * s * (1 - s) / 2 AS c FROM v), "
    "x AS (SELECT p_partkey, k, ax + s * (bx - ax) + c0 * (ax + bx) AS x, ay + s * (by_ - ay) + c0 * (ay + by_) AS y, az + s * (bz - az) + c0 * (az + bz) AS z "
    "FROM (SELECT *, (1 - sqrt(((ax + bx) * (ax + bx) + (ay + by_) * (ay + by_) + (az + bz) * (az + bz)) / 4)) * 4 * s * (1 - s) / 2 AS c0 FROM c)) "
    "SELECT p_partkey, k::BIGINT AS k, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM x"
)
def tie_lat_lon_sphere(spark: SparkSession, sf: str) -> DataFrame:
    """Along a great circle between two points of each part, without coefficients."""
    n = F.lit(None).cast("double")
    lat, lon = F.col("p_size") % 40 * 1.0, F.col("p_partkey") % 70 + 10.0
    rows = table(spark, sf, "part").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("k"))
    at = tiepoints.quadratic_lat_lon(lat, lon, lat + 15.0, lon + 20.0, n, n, F.col("k") / 10.0, F.lit(True))
    return rows.select("p_partkey", "k", F.round(at[0], 6).alias("lat"), F.round(at[1], 6).alias("lon"))


@query(
    "WITH n AS (SELECT s_suppkey AS cell, [{'x': s_acctbal + e, 'y': s_nationkey * e} FOR e IN [0, 1, 2, 3, 4, 5, 6]] AS n FROM supplier) SELECT cell, [n[1:3], n[4:7]] AS parts, [0, 1] AS rings FROM n"
)
def geometry_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as cells of two parts, an outline of three nodes and a ring of four."""
    s = table(spark, sf, "supplier")
    k, e = F.col("s_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("e")
    nodes = s.select("*", e).select((k * 7 + F.col("e")).alias("n"), (F.col("s_acctbal") + F.col("e")).alias("x"), (F.col("s_nationkey") * F.col("e")).alias("y"))
    parts = s.select(F.inline(F.array(*(F.struct((k * 2 + r).alias("p"), F.lit(3 + r).alias("size"), F.lit(r).alias("ring")) for r in (0, 1)))))
    return geometry.nested(nodes, parts, s.select(k.alias("cell"), F.lit(7).alias("nodes")), "n", "p", "cell", "size", "nodes", ring="ring")


@query("SELECT l_orderkey AS cell, min(l_quantity) AS min_x, max(l_quantity) AS max_x, min(l_tax) AS min_y, max(l_tax) AS max_y, count(*) AS nodes FROM lineitem GROUP BY l_orderkey")
def geometry_boxes(spark: SparkSession, sf: str) -> DataFrame:
    part = F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_tax").alias("y")))
    return geometry.bounding_box(table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.array(part).alias("parts")), "cell")


_FACES = "f AS (SELECT l_orderkey AS cell, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nodes FROM lineitem GROUP BY l_orderkey)"
_EDGES = f"{_FACES}, e AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT nodes[k + 1] AS x, nodes[(k + 1) % len(nodes) + 1] AS y FROM f, range(100) r(k) WHERE k < len(nodes)) WHERE x <> y)"


def _faces(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as polygons of the parts in them."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    return lines.select("cell", F.transform("x", lambda x: x["l_partkey"]).alias("nodes"))


@query(f"WITH {_EDGES} SELECT a, b FROM e")
def edges_from_faces(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.edges_from_faces(_faces(spark, sf))


@query(f"WITH {_EDGES} SELECT node, list(n ORDER BY n) AS neighbours FROM (SELECT a AS node, b AS n FROM e UNION SELECT b, a FROM e) GROUP BY node")
def point_topology_faces(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.points_from_faces(_faces(spark, sf))


@query("SELECT node, list(n ORDER BY n) AS neighbours, list_concat([node], list(n ORDER BY n)) AS row FROM (SELECT DISTINCT l_partkey AS node, 1000000000 + l_suppkey AS n FROM lineitem UNION SELECT DISTINCT 1000000000 + l_suppkey, l_partkey FROM lineitem) GROUP BY node")
def point_topology_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b"))
    return mesh.with_own(mesh.points_from_edges(edges), "node", "neighbours")


@query(f"WITH {_EDGES} SELECT a, b FROM e")
def edges_from_points(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.edges_from_points(mesh.points_from_faces(_faces(spark, sf)))


@query(f"WITH {_FACES}, n AS (SELECT DISTINCT unnest(nodes) AS id FROM f), r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new FROM n), x AS (SELECT cell, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS k FROM f) SELECT cell, list(new ORDER BY k) AS nodes FROM x JOIN r USING (id) GROUP BY cell")
def topology_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.normalised(_faces(spark, sf), "cell", "nodes")


@query("WITH c AS (SELECT c_custkey AS cell, [c_custkey + 3, c_custkey - 2, c_custkey + 100000] AS n FROM customer), r AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS new FROM c) SELECT r.new AS cell, list_sort(list(s.new)) AS neighbours FROM (SELECT cell, unnest(n) AS id FROM c) x JOIN r USING (cell) LEFT JOIN r s ON x.id = s.cell WHERE s.new IS NOT NULL GROUP BY r.new")
def connectivity_normalise(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    links = table(spark, sf, "customer").select(k.alias("cell"), F.array(k + 3, k - 2, k + 100000).alias("neighbours"))
    return mesh.normalised_connectivity(links, "cell", "neighbours")


@query(f"WITH {_FACES}, x AS (SELECT cell, unnest(nodes) AS id, generate_subscripts(nodes, 1) AS k FROM f) SELECT cell, list(p_retailprice ORDER BY k) AS bounds FROM x LEFT JOIN part ON id = p_partkey GROUP BY cell")
def bounds_from_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.bounds_from_nodes(_faces(spark, sf), "cell", "nodes", table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice"), "id", "p_retailprice")


@query(f"WITH {_FACES}, x AS (SELECT cell, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS k FROM f) SELECT node, arg_min(cell * 100.0 + (k - 1), cell * 1000 + k)::DOUBLE AS coordinate FROM x GROUP BY node")
def node_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    faces = _faces(spark, sf).withColumn("bounds", F.transform("nodes", lambda x, k: F.col("cell") * 100.0 + k))
    return mesh.node_coordinates(faces, "cell", "nodes", "bounds")


@query("SELECT c_custkey AS cell, [c_custkey, c_custkey + 1, c_custkey * 2] AS row FROM customer")
def cell_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return mesh.cell_connectivity(table(spark, sf, "customer").select(k.alias("cell"), F.array(k + 2, F.lit(None).cast("long"), k * 2 + 1).alias("neighbours")), start_index=1)


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def topology_sort(spark: SparkSession, sf: str) -> DataFrame:
    return mesh.sorted_edges(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct())


@query("SELECT page_id, url, CASE WHEN page_id::VARCHAR LIKE '1%' THEN '/b' || substr('/a/1/' || page_id, 5) ELSE '/a/2/' || page_id END AS uri FROM pages")
def fragments_relocated(spark: SparkSession, sf: str) -> DataFrame:
    id = F.col("page_id").cast("string")
    rows = table(spark, sf, "pages").select("page_id", "url", F.concat(F.when(id.startswith("1"), "/a/1/").otherwise("/a/2/"), id).alias("uri"))
    return fragments.relocated(rows, "/a/1", "/b")


@query("SELECT o_custkey AS fragment, min(o_orderstatus) IS NOT DISTINCT FROM max(o_orderstatus) AS constant, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS value FROM orders GROUP BY o_custkey")
def fragment_unique_value(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.unique_value(table(spark, sf, "orders").select(F.col("o_custkey").alias("fragment"), "o_orderstatus"), "fragment", "o_orderstatus").withColumnRenamed("o_orderstatus", "value")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS e, ts, value FROM events")
def time_series_features(spark: SparkSession, sf: str) -> DataFrame:
    """Events as discrete sampling geometry: one time series for each user."""
    return ragged.indexed(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "e", "ts", "value")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events WHERE value > 50")
def dense_renumbering(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return dense_places(events.where("value > 50").select("event_id"), "event_id", events.count(), "place")


@query("SELECT p_partkey, i::BIGINT AS i, j::BIGINT AS j, round(p_size % 40 + 20 * i / 4.0, 6) AS lat, (p_partkey % 100)::DOUBLE AS lon FROM part, range(5) a(i), range(3) b(j)")
def tie_bi_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    """Four points on one meridian for each part, without coefficients: great-circle arcs along it, equal steps of the angle at the tie points and half-way."""
    n = F.lit(None).cast("double")
    none = {k: (n, n) for k in ("ab", "cd", "ac", "bd", "z")}
    low, lon = F.col("p_size") % 40 * 1.0, F.col("p_partkey") % 100 * 1.0
    grid = table(spark, sf, "part").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j"))
    corners = ((low, lon), (low + 20.0, lon), (low, lon), (low + 20.0, lon))
    lat, lon = tiepoints.bi_quadratic_lat_lon(corners, none, F.col("i") / 4, F.col("j") / 2, F.lit(False))
    return grid.select("p_partkey", "i", "j", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber & 4) <> 0 AS sensor FROM lineitem")
def interpolation_flags(spark: SparkSession, sf: str) -> DataFrame:
    masks = {"location_use_3d_cartesian": 1, "sensor_direction_use_3d_cartesian": 2, "solar_direction_use_3d_cartesian": 4}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tiepoints.flag(F.col("l_linenumber"), masks, "solar_direction_use_3d_cartesian").alias("sensor"))


_MESHES = """l AS (SELECT DISTINCT l_orderkey AS o, l_partkey % 50 AS x FROM lineitem), f AS (SELECT o, list(x ORDER BY x) AS nodes FROM l GROUP BY o),
r AS (SELECT o, nodes[k + 1] AS x, nodes[(k + 1) % len(nodes) + 1] AS y FROM f, range(10) t(k) WHERE k < len(nodes)),
d AS (SELECT DISTINCT 'f' || o AS domain, o, least(x, y) AS a, greatest(x, y) AS b FROM r WHERE x <> y),
e AS (SELECT domain, o, list((a, b) ORDER BY a, b) AS edges FROM d GROUP BY domain, o),
m AS (SELECT domain, o, edges, nodes FROM e JOIN f USING (o) UNION ALL SELECT 'e' || o, o, CASE WHEN o % 5 = 0 THEN edges[2:] ELSE edges END, NULL FROM e UNION ALL SELECT 'p' || o, o, edges, NULL FROM e)"""


@query(
    f"""WITH {_MESHES}, n AS (SELECT domain, CASE WHEN len(edges) > 0 THEN edges END AS edges, nodes FROM m UNION ALL SELECT 'f' || o, NULL, nodes FROM f WHERE len(nodes) < 2),
g AS (SELECT edges, nodes, min(domain) AS least FROM n WHERE edges IS NOT NULL AND nodes IS NOT NULL GROUP BY ALL),
h AS (SELECT edges, min(least) AS first FROM g GROUP BY edges),
b AS (SELECT edges, min(domain) AS bare FROM n WHERE edges IS NOT NULL AND nodes IS NULL GROUP BY edges)
SELECT domain, CASE WHEN n.edges IS NULL THEN domain WHEN g.least IS NULL OR g.least = h.first THEN least(coalesce(bare, first), coalesce(first, bare)) ELSE g.least END AS mesh
FROM n LEFT JOIN g ON n.edges = g.edges AND n.nodes = g.nodes LEFT JOIN h ON n.edges = h.edges LEFT JOIN b ON n.edges = b.edges WHERE NOT (n.edges IS NULL AND starts_with(domain, 'e'))"""
)
def mesh_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as a face of parts, as its edges turned round, one of them lacking in every fifth, and as points: which domains are of one mesh."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") % 50).alias("x"))
    faces = lines.groupBy("o").agg(F.array_sort(F.collect_set("x")).alias("nodes"))
    key = lambda p: F.concat(F.lit(p), F.col("o").cast("string")).alias("domain")
    n = F.size("nodes")
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array(F.get("nodes", (k + 1) % n), F.get("nodes", k)))
    turned = F.array_sort(F.array_distinct(F.transform(F.filter(ring, lambda e: e[0] != e[1]), lambda e: F.array_sort(e))))
    kept = F.when(F.col("o") % 5 == 0, F.slice(turned, 2, 1000)).otherwise(turned)
    edges = faces.where("size(nodes) > 1").select(key("e"), F.lit("edge").alias("kind"), F.explode(kept).alias("nodes")).withColumn("nodes", F.reverse("nodes"))
    # Both ways in one explode: rows stay with their order, so that nothing is shuffled again.
    both = faces.where("size(nodes) > 1").select("o", F.explode(F.concat(turned, F.transform(turned, lambda e: F.reverse(e)))).alias("e")).select("o", F.col("e")[0].alias("x"), F.col("e")[1].alias("y"))
    points = both.groupBy("o", "x").agg(F.collect_list("y").alias("y")).select(key("p"), F.lit("point").alias("kind"), F.concat(F.array("x"), "y").alias("nodes"))
    return mesh.linked(faces.select(key("f"), F.lit("face").alias("kind"), "nodes").unionByName(edges).unionByName(points))


@query(
    f"WITH {_FACES}, x AS (SELECT cell, list_concat([NULL], nodes, list_transform(range(8 - len(nodes)), lambda z: NULL)) AS n FROM f), w AS (SELECT max(len(nodes)) AS w FROM f) SELECT cell, n[2 : w + 1] AS nodes FROM x, w"
)
def mesh_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as padded rows of parts, with a column before and some after in which no order has any."""
    none = F.array(F.lit(None).cast("long"))
    wide = F.concat(none, F.col("nodes").cast("array<bigint>"), F.array_repeat(F.lit(None).cast("long"), F.lit(8) - F.size("nodes")))
    return mesh.without_empty_columns(_faces(spark, sf).select("cell", wide.alias("nodes")))
