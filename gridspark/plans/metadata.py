"""Queries on metadata: the catalogue's filters, names, units, times, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, time, units
from ..model import Cells, Construct, Field
from ..operators import groups, matching
from ..operators.combine import newest
from ..operators.ordering import dense_places
from ..sources.tables import table
from . import catalog
from .registry import query

#: Parts as constructs: the key's remainder by 8 (m) says which kind, the quotient (h) the rest.
KINDS = ("domain_axis", "dimension_coordinate", "auxiliary_coordinate", "cell_measure", "cell_method", "domain_topology", "cell_connectivity", "field_ancillary")
_PARTS = (
    f"c AS (SELECT 'c' || p_partkey AS key, {list(KINDS)}[m + 1] AS type, CASE WHEN m = 0 THEN 0 WHEN m IN (2, 3) THEN 2 WHEN m = 7 THEN 3 ELSE 1 END AS naxes, * "
    "FROM (SELECT p_partkey, p_name, p_partkey % 8 AS m, p_partkey // 8 AS h FROM part))"
)


def _constructs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    m, h = k % 8, F.expr("p_partkey div 8")
    x = F.concat(F.lit("x"), (h % 3).cast("string"))
    one = lambda n, *values: F.get(F.array(*map(F.lit, values)), (h % n).cast("int"))
    properties = F.create_map(
        *(F.lit("standard_name"), F.when(m == 1, one(3, "depth", "height", None))),
        *(F.lit("units"), F.when(m.isin(1, 2, 3), one(4, "m", "kg m-2", "K", "K"))),
        *(F.lit("long_name"), F.when(m == 2, F.col("p_name"))),
        *(F.lit("level"), F.when(m == 7, (h % 5).cast("string"))),
    )
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("c"), k.cast("string")).alias("key"),
        F.get(F.array(*map(F.lit, KINDS)), m.cast("int")).alias("type"),
        F.when(m == 0, F.array().cast("array<string>")).when(m.isin(1, 4), F.array(x)).when(m == 2, F.array(x, F.lit("y"))).when(m == 3, F.array(F.lit("x0"), F.lit("y"))).when(m == 7, F.array(x, F.lit("y"), F.lit("z"))).otherwise(F.array(F.lit("y"))).alias("axes"),
        F.when(m.isin(1, 3), F.concat(F.lit("v"), h.cast("string"))).alias("ncvar"),
        F.when(m == 0, x).alias("ncdim"),
        F.when(m == 0, h % 50 + 1).alias("size"),
        F.when(m == 3, one(2, "area", "volume")).alias("measure"),
        F.when(m == 4, one(2, "mean", "maximum")).alias("method"),
        F.when(m == 5, one(3, "face", "edge", "point")).alias("cell"),
        F.when(m == 6, one(2, "node", "edge")).alias("connectivity"),
        F.map_filter(properties, lambda _, v: v.isNotNull()).alias("properties"),
    )
    return catalog.named(rows)


#: For each filter its condition on the catalogue, and the same on (key, m, h).
_FILTERS = {
    "axis_and": (lambda: catalog.by_axis("x0", "y"), "m IN (2, 7) AND h % 3 = 0 OR m = 3"),
    "axis_or": (lambda: catalog.by_axis("x1", "z", mode="or"), "m IN (1, 2) AND h % 3 = 1 OR m = 7"),
    "axis_exact": (lambda: catalog.by_axis("y", mode="exact"), "m IN (5, 6)"),
    "axis_subset": (lambda: catalog.by_axis("x2", "y", mode="subset"), "m IN (1, 2) AND h % 3 = 2 OR m IN (5, 6)"),
    "identity": (lambda: catalog.by_identity("depth", "measure:area", "re:^method:max"), "m = 1 AND h % 3 = 0 OR m = 3 AND h % 2 = 0 OR m = 4 AND h % 2 = 1"),
    "key": (lambda: catalog.by_key("c12", "re:7$"), "key = 'c12' OR p_partkey % 10 = 7"),
    "property_and": (lambda: catalog.by_property(units="re:^kg", standard_name="height"), "m = 1 AND h % 4 = 1 AND h % 3 = 1"),
    "property_or": (lambda: catalog.by_property(mode="or", level=3.0, units="K"), "m = 7 AND h % 5 = 3 OR m IN (1, 2, 3) AND h % 4 >= 2"),
    "property_exists": (lambda: catalog.by_property(long_name=None), "m = 2"),
    "naxes": (lambda: catalog.by_naxes(2), "m IN (2, 3)"),
    "size": (lambda: catalog.by_size(1, 8), "m = 0 AND h % 50 IN (0, 7)"),
    "type": (lambda: catalog.by_type("cell_method", "domain_axis"), "m IN (0, 4)"),
    "measure": (lambda: catalog.by_measure("area"), "m = 3 AND h % 2 = 0"),
    "method": (lambda: catalog.by_method("mean"), "m = 4 AND h % 2 = 0"),
    "cell": (lambda: catalog.by_cell("face"), "m = 5 AND h % 3 = 0"),
    "connectivity": (lambda: catalog.by_connectivity(), "m = 6"),
    "ncvar": (lambda: catalog.by_ncvar("re:^v1"), "m IN (1, 3) AND h::VARCHAR LIKE '1%'"),
    "ncdim": (lambda: catalog.by_ncdim("x1"), "m = 0 AND h % 3 = 1"),
    "data": (lambda: catalog.by_data(), "m NOT IN (0, 4)"),
}


def _selected(spark: SparkSession, sf: str) -> catalog.Selection:
    return catalog.Selection(_constructs(spark, sf))


for _name, (_condition, _where) in _FILTERS.items():

    def _filter(spark: SparkSession, sf: str, condition: object = _condition) -> DataFrame:
        return _selected(spark, sf).filter(condition()).df.select("key", "type", "naxes")

    _filter.__name__ = f"construct_filter_{_name}"
    query(f"WITH {_PARTS} SELECT key, type, naxes FROM c WHERE {_where}")(_filter)


@query(f"WITH {_PARTS} SELECT key, CASE WHEN h % 3 = 0 THEN 'depth' WHEN h % 3 = 1 THEN 'height' ELSE 'units=' || ['m', 'kg m-2', 'K', 'K'][h % 4 + 1] END AS identity FROM c WHERE m = 1")
def construct_identities(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).filter(catalog.by_type("dimension_coordinate")).df.select("key", "identity")


@query(f"WITH {_PARTS} SELECT key FROM c WHERE m <> 1")
def construct_filter_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).filter(catalog.by_type("dimension_coordinate"), catalog.by_naxes(1)).inverse().df.select("key")


@query(f"WITH {_PARTS} SELECT key FROM c WHERE m = 1")
def construct_unfilter(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf).filter(catalog.by_type("dimension_coordinate"), catalog.by_identity("depth")).unfilter(1).df.select("key")


@query(f"WITH {_PARTS} SELECT key FROM c WHERE m IN (1, 2, 4) AND h % 3 = 0 OR m IN (3, 5, 6) OR key = 'c8'")
def construct_convert(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.convertible(_selected(spark, sf).df, ("x0", "y", "c8")).select("key")


@query("SELECT 'source' AS name, 'x' AS value WHERE false UNION ALL SELECT 'kind' AS name, 'order' AS value WHERE (SELECT count(*) FROM orders) > 0")
def global_attributes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("field_id"), F.lit("kind").alias("name"), F.lit("order").alias("value")).unionByName(o.select(F.col("o_orderkey").alias("field_id"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")))
    return catalog.global_attributes(rows)


_PATHS = r"""u AS (SELECT page_id, list_concat(list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')), list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) AS g FROM pages),
v AS (SELECT DISTINCT '/' || array_to_string(g[1 : page_id % (len(g) + 1)], '/') AS grp, 'v' || page_id % 7 AS name FROM u),
d AS (SELECT DISTINCT '/' || array_to_string(g[1 : page_id % 3], '/') AS grp, 'v' || page_id % 5 AS name FROM u),
r AS (SELECT DISTINCT '/' || array_to_string(g, '/') AS path, 'v' || (page_id * 3 + 1) % 9 AS name FROM u),
up(path, grp) AS (SELECT path, path FROM (SELECT path FROM r UNION SELECT grp FROM v) UNION
  SELECT path, CASE WHEN grp = '/' THEN NULL WHEN regexp_replace(grp, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(grp, '/[^/]*$', '') END FROM up WHERE grp IS NOT NULL),
a AS (SELECT path, grp, len(list_filter(string_split(grp, '/'), lambda x: x <> '')) AS depth FROM up WHERE grp IS NOT NULL)"""


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as groups, hosts from their ends on and then paths; variables and dimensions stand at some level above each, references in the page."""
    url, page = F.col("url"), F.col("page_id")
    g = F.concat(F.reverse(F.split(F.regexp_extract(url, r"^https?://([^/?#]+)", 1), r"\.")), groups.parts(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)))
    u = table(spark, sf, "pages").select("page_id", g.alias("g"))
    at = lambda k: groups.joined(F.slice("g", 1, k.cast("int")))
    name = lambda k: F.concat(F.lit("v"), k.cast("string"))
    variables = u.select(at(page % (F.size("g") + 1)).alias("path"), name(page % 7).alias("name"))
    dimensions = u.select(at(page % 3).alias("path"), name(page % 5).alias("name"))
    return u.select("page_id", groups.joined(F.col("g")).alias("path"), name((page * 3 + 1) % 9).alias("name")), variables, dimensions


@query(
    f"""WITH RECURSIVE {_PATHS},
near AS (SELECT path, name, arg_max(grp, depth) AS near, max(depth) AS depth FROM r JOIN a USING (path) JOIN v USING (grp, name) GROUP BY path, name),
apex AS (SELECT path, name, arg_max(grp, depth) AS apex, max(depth) AS depth FROM r JOIN a USING (path) JOIN d USING (grp, name) GROUP BY path, name),
below AS (SELECT name, a.grp AS apex, v.grp AS far, o.depth FROM v JOIN a ON a.path = v.grp AND a.grp <> v.grp JOIN a o ON o.path = v.grp AND o.grp = v.grp),
least AS (SELECT name, apex, min(depth) AS depth FROM below GROUP BY name, apex),
alone AS (SELECT name, apex, min(far) AS far FROM below JOIN least USING (name, apex, depth) GROUP BY name, apex HAVING count(*) = 1),
f AS (SELECT path, name, CASE WHEN near.depth >= coalesce(apex.depth, 0) THEN near END AS near, far FROM r LEFT JOIN near USING (path, name) LEFT JOIN apex USING (path, name) LEFT JOIN alone USING (name, apex))
SELECT page_id, path, name, coalesce(near, far) AS found_in, CASE WHEN near IS NOT NULL THEN 'proximal' WHEN far IS NOT NULL THEN 'lateral' END AS how
FROM (SELECT page_id, '/' || array_to_string(g, '/') AS path, 'v' || (page_id * 3 + 1) % 9 AS name FROM u) LEFT JOIN f USING (path, name)"""
)
def variable_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups.resolved(*_groups(spark, sf)).select("page_id", "path", "name", "found_in", "how")


@query(
    "WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k, p_retailprice, p_size FROM part) SELECT k AS p, p_retailprice AS price, p_size::DOUBLE AS size, (p_size + 1)::DOUBLE AS other FROM p"
)
def match_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Two fields on two axes as long as there are parts, named and ordered otherwise: found by what stands along them, and read back by the axes of the first."""
    rows = table(spark, sf, "part")
    n = rows.count()
    rows = dense_places(rows.select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), "p_partkey", n, "k")

    def along(key: str, axis: str, value: object, name: str = "") -> Construct:
        return Construct(key, "auxiliary_coordinate", (axis,), {"long_name": name}, data=Cells(rows.select(F.col("k").alias(axis), value.alias("value")), (axis,), (n,)))

    price, size = F.col("p_retailprice"), F.col("p_size")
    diagonal = lambda x, y, v: Cells(rows.select(F.col("k").alias(x), F.col("k").alias(y), v.alias("value")), (x, y), (n, n))
    a = Field(diagonal("p", "q", price), (along("a0", "p", price), along("a1", "p", size), along("a2", "q", size), along("a3", "q", size + 1), Construct("a4", "auxiliary_coordinate", ("p", "q"), {}, data=diagonal("p", "q", size))))
    b = Field(diagonal("s", "r", price), (along("b0", "r", size), along("b1", "r", size + 1), along("b2", "s", size), along("b3", "s", price), Construct("b4", "auxiliary_coordinate", ("r", "s"), {}, data=diagonal("r", "s", size))))
    found = matching.matched(a, b)
    own = {c.key: matching.renamed(c.data, found.axes) for c in b.constructs}
    part = lambda key, name: own[found.keys[key]].df.withColumnRenamed("value", name)
    return part("a0", "price").join(part("a1", "size"), "p").join(part("a3", "other").withColumnRenamed("q", "p"), "p").select("p", "price", "size", "other")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000 AS hours FROM events")
def time_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", time.encode(F.col("ts").cast("timestamp"), "hours since 2024-01-01").alias("hours"))


@query("SELECT o_orderkey, TIMESTAMP '1990-03-01 06:00:00' + to_hours(CAST(o_orderkey % 100000 AS BIGINT)) AS t, strftime(TIMESTAMP '1990-03-01 06:00:00' + to_hours(CAST(o_orderkey % 100000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS text FROM orders")
def time_decode(spark: SparkSession, sf: str) -> DataFrame:
    t = time.decode(F.col("o_orderkey") % 100000, "hours since 1990-03-01 06:00:00")
    return table(spark, sf, "orders").select("o_orderkey", t.cast("timestamp_ntz").alias("t"), time.to_text(t).alias("text"))


@query("SELECT o_orderkey, (o_orderkey % 1000) * 24.0 + 744 AS hours FROM orders")
def time_rebase(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", time.rebase((F.col("o_orderkey") % 1000).cast("double"), "days since 2000-02-01", "hours since 2000-01-01").alias("hours"))


@query("WITH d AS (SELECT o_orderkey, o_orderkey % 20000 + 720029 AS n FROM orders) SELECT o_orderkey, n // 360 AS year, (n % 360 // 30 + 1)::INTEGER AS month, (n % 30 + 1)::INTEGER AS day FROM d")
def calendar_360_day(spark: SparkSession, sf: str) -> DataFrame:
    f = time.fields(F.col("o_orderkey") % 20000, "days since 2000-01-30", "360_day")
    return table(spark, sf, "orders").select("o_orderkey", f["year"].alias("year"), f["month"].alias("month"), f["day"].alias("day"))


@query("WITH d AS (SELECT o_orderkey, o_orderkey % 20000 AS n FROM orders), x AS (SELECT o_orderkey, 2001 + n // 365 AS year, DATE '2001-01-01' + (n % 365)::INTEGER AS d FROM d) SELECT o_orderkey, year, month(d)::INTEGER AS month, day(d)::INTEGER AS day FROM x")
def calendar_noleap(spark: SparkSession, sf: str) -> DataFrame:
    f = time.fields(F.col("o_orderkey") % 20000, "days since 2001-01-01", "noleap")
    return table(spark, sf, "orders").select("o_orderkey", f["year"].alias("year"), f["month"].alias("month"), f["day"].alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS t FROM orders")
def time_from_text(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("text", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 3 == 0, "+01:00").otherwise("")))
    return o.select("o_orderkey", time.from_text(F.col("text")).cast("timestamp_ntz").alias("t"))


@query("SELECT user_id, arg_min(value, event_id) FILTER (event_type <> 'click') AS value FROM events GROUP BY user_id")
def first_present(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(time.first_present(F.when(F.col("event_type") != "click", F.col("value")), F.col("event_id")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1000.0 AS m, l_quantity + 273.15 AS k, l_quantity * 0.2777777777777778 AS speed FROM lineitem")
def unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", units.converted(q, "km", "metres").alias("m"), units.converted(q, "degC", "K").alias("k"), units.converted(q, "km h-1", "m s-1").alias("speed"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'supplier' WHEN s_suppkey % 4 = 1 THEN 'cf_role=id' WHEN s_suppkey % 4 = 2 THEN 'long_name=' || s_name ELSE 'ncvar%s' || s_suppkey END AS identity FROM supplier")
def identity_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    p = F.when(k == 0, F.create_map(F.lit("standard_name"), F.lit("supplier"))).when(k == 1, F.create_map(F.lit("cf_role"), F.lit("id"))).when(k == 2, F.create_map(F.lit("long_name"), F.col("s_name"))).otherwise(F.expr("map('comment', 'x')"))
    return table(spark, sf, "supplier").select("s_suppkey", attrs.identity(p, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("identity"))


@query("SELECT c_custkey, [c_mktsegment, c_custkey::VARCHAR] AS a, [c_name] AS b FROM customer")
def attribute_key_values(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("text", F.concat(F.lit("a: "), "c_mktsegment", F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" b: "), "c_name"))
    m = attrs.key_values(F.col("text"))
    return c.select("c_custkey", F.try_element_at(m, F.lit("a")).alias("a"), F.try_element_at(m, F.lit("b")).alias("b"))


@query("SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'standard_error' END AS modifier FROM nation")
def standard_name_modifier(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("x", attrs.name_and_modifier(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, " standard_error").otherwise(""))))
    return n.select("n_nationkey", F.col("x.name").alias("name"), F.col("x.modifier").alias("modifier"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def newest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return newest(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("SELECT 's' || s_suppkey AS object, 'standard_name' AS rule, 'not in the table: ' || s_name AS message FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 's' || s_suppkey, 'standard_name_modifier', 'not a modifier: guess' FROM supplier WHERE s_suppkey % 7 = 0")
def conformance_names(spark: SparkSession, sf: str) -> DataFrame:
    from . import conformance

    s = table(spark, sf, "supplier")
    names = F.concat("s_name", F.when(F.col("s_suppkey") % 7 == 0, " guess").otherwise(F.when(F.col("s_suppkey") % 2 == 0, " standard_error").otherwise("")))
    known = s.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("name"))
    return conformance.unknown_names(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("variable"), names.alias("standard_name")), known)


@query("SELECT 'o' || o_orderkey AS object, 'reference' AS rule, 'lines names absent l' || o_orderkey AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def conformance_references(spark: SparkSession, sf: str) -> DataFrame:
    from . import conformance

    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    references = table(spark, sf, "orders").select(key("o", "o_orderkey").alias("variable"), F.lit("lines").alias("attribute"), key("l", "o_orderkey").alias("target"))
    return conformance.missing_references(references, table(spark, sf, "lineitem").select(key("l", "l_orderkey").alias("variable")).distinct())


@query("WITH w AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id::VARCHAR AS object, 'monotonic' AS rule, 'neither rising nor falling' AS message FROM w GROUP BY user_id HAVING min(sign(s)) <> max(sign(s)) OR min(sign(s)) = 0")
def conformance_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    from . import conformance

    return conformance.not_monotonic(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_id", "value"), "event_id", "value", "user_id")


@query(
    """SELECT 'o' || o_orderkey AS object, 'bounds' AS rule, 'dimensions must be those of the parent and one more' AS message FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT 'o' || o_orderkey, 'dimensions', 'spans z' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 's' || l_suppkey, 'node_count', 'counts add up to ' || sum(l_linenumber) FROM lineitem GROUP BY l_suppkey HAVING sum(l_linenumber) <> 1800
UNION ALL SELECT DISTINCT 'p' || l_partkey, 'index', 'no element ' || l_linenumber FROM lineitem WHERE l_linenumber > 5"""
)
def conformance_shapes(spark: SparkSession, sf: str) -> DataFrame:
    from . import conformance

    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("variable")
    x, z = F.array(F.lit("x")), F.array(F.lit("x"), F.lit("z"))
    o, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    bounds = o.select(key("o", "o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, x).otherwise(F.array(F.lit("x"), F.lit("v"))).alias("dimensions"), x.alias("parent_dimensions"))
    spans = o.select(key("o", "o_orderkey"), F.when(F.col("o_orderkey") % 5 == 0, z).otherwise(x).alias("dimensions"), x.alias("parent_dimensions"))
    return conformance.report(
        conformance.bounds_shape(bounds),
        conformance.foreign_dimensions(spans),
        conformance.counts_total(lines.select(key("s", "l_suppkey"), F.col("l_linenumber").alias("count")), 1800),
        conformance.index_range(lines.select(key("p", "l_partkey"), F.col("l_linenumber").alias("k")), "k", 6),
    )
