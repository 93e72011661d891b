"""Queries on arrays: indexing, shape, masks, elementwise operators, reductions, concatenation, equality."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..model import Cells, Construct, Field
from ..operators import cells as C
from ..operators import combine, elementwise, equality, indexing, masking, reduce, shape
from ..operators.ordering import dense_places
from ..sources.tables import embedding_cells, labels, masked_cells, table, whole_cells
from .registry import query

E = "e AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, unnest(embedding) AS f FROM embeddings)"
Q = f"{E}, q AS (SELECT i, j, CAST(floor(CAST(f AS DOUBLE) * 256) AS BIGINT) AS value FROM e)"
M = f"{Q}, m AS (SELECT i, j, CASE WHEN value % 7 <> 0 THEN value END AS value FROM q)"


@query(f"WITH {Q} SELECT (i - 10) // 5 AS i, j, value FROM q WHERE i >= 10 AND i < 60 AND (i - 10) % 5 = 0 AND j < 8")
def subspace_slice(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), (slice(10, 60, 5), slice(0, 8))).frame()


@query(f"WITH {Q} SELECT CASE i WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS i, CASE j WHEN 5 THEN 0 ELSE 1 END::BIGINT AS j, value FROM q WHERE i IN (3, 1, 40) AND j IN (5, 0)")
def subspace_list(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), ([3, 1, 40], [5, 0])).frame()


@query(f"WITH {Q} SELECT (20 - i) // 3 AS i, (63 - j) // 16 AS j, value FROM q WHERE i <= 20 AND i > 0 AND (20 - i) % 3 = 0 AND (63 - j) % 16 = 0")
def subspace_negative_step(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), (slice(20, 0, -3), slice(None, None, -16))).frame()


@query(f"WITH {Q} SELECT i, j // 4 AS j, value FROM q WHERE j % 4 = 0 AND i < 5")
def subspace_bool(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), (slice(5), [k % 4 == 0 for k in range(64)])).frame()


@query(f"WITH {Q} SELECT CASE i WHEN 7 THEN 0 WHEN 2 THEN 1 WHEN 30 THEN 2 ELSE 3 END::BIGINT AS i, (60 - j) // 5 AS j, value FROM q WHERE i IN (7, 2, 30, 11) AND j <= 60 AND (60 - j) % 5 = 0")
def subspace_orthogonal2(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), ([7, 2, 30, 11], slice(60, None, -5))).frame()


@query(f"WITH {Q} SELECT 0::BIGINT AS i, 0::BIGINT AS j, value FROM q WHERE j = 3 AND i = (SELECT max(i) FROM q)")
def subspace_integer(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), (-1, 3)).frame()


@query(f"WITH {Q}, p(old, new) AS (VALUES (4, 0), (4, 1), (2, 2)) SELECT new::BIGINT AS i, j, value FROM q JOIN p ON i = old WHERE j < 2")
def subspace_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace(whole_cells(spark, sf), ([4, 4, 2], slice(2))).frame()


@query(f"WITH {Q} SELECT i, j, value FROM q WHERE i IN (SELECT vec_id FROM embeddings WHERE label IN (2, 5)) AND j < 4")
def subspace_by_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.subspace_where(indexing.subspace(whole_cells(spark, sf), (..., slice(4))), "i", labels(spark, sf), [2, 5])


@query(f"WITH {Q} SELECT i, j, CASE WHEN i >= 2 AND i < 9 AND j IN (0, 7) THEN -1 ELSE value END AS value FROM q")
def assign_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.assign(whole_cells(spark, sf), (slice(2, 9), [0, 7]), F.lit(-1).cast("long")).frame()


@query(f"WITH {Q} SELECT i, j, CASE WHEN i % 3 = 1 THEN NULL ELSE value END AS value FROM q")
def assign_mask(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.assign(whole_cells(spark, sf), (slice(1, None, 3),), F.lit(None).cast("long")).frame()


@query(f"WITH {Q} SELECT i, j, CASE WHEN i % 2 = 1 AND j >= 8 AND j < 12 THEN (j - 8) * 100 ELSE value END AS value FROM q")
def assign_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    """One row for every other vector."""
    row = Cells(spark.range(4).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"), (F.col("id") * 100).alias("value")), ("i", "j"), (1, 4))
    return indexing.assign(whole_cells(spark, sf), (slice(1, None, 2), slice(8, 12)), row).frame()


@query(f"WITH {M} SELECT i, j, CASE WHEN value IS NOT NULL AND j < 32 THEN 5 ELSE value END AS value FROM m")
def hardmask_assign(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.assign(masked_cells(spark, sf), (..., slice(32)), F.lit(5).cast("long")).frame()


@query(f"WITH {M} SELECT i, j, CASE WHEN j < 32 THEN 5 ELSE value END AS value FROM m")
def softmask_assign(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.assign(masking.soften_mask(masked_cells(spark, sf)), (..., slice(32)), F.lit(5).cast("long")).frame()


@query(f"WITH {Q} SELECT j, 0::BIGINT AS k, i, value FROM q")
def insert_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return shape.transpose(shape.insert_dimension(whole_cells(spark, sf), "k", 1)).frame()


@query(f"WITH {Q} SELECT j, value FROM q WHERE i = 6")
def squeeze_axis(spark: SparkSession, sf: str) -> DataFrame:
    return shape.squeeze(indexing.subspace(whole_cells(spark, sf), (6,))).frame()


@query(f"WITH {Q} SELECT i * 64 + j AS flat, value FROM q")
def flatten_axes(spark: SparkSession, sf: str) -> DataFrame:
    return shape.flatten(whole_cells(spark, sf)).frame()


@query(f"WITH {Q}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT (i * 64 + j) // (4 * n) AS a, (i * 64 + j) // 4 % n AS b, (i * 64 + j) % 4 AS c, value FROM q, n")
def reshape_3d(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return shape.reshape(c, ("a", "b", "c"), (c.shape[1] // 4, c.shape[0], 4)).frame()


@query(f"WITH {Q}, g AS (SELECT a.i, b.j FROM (SELECT DISTINCT i FROM q) a, (SELECT unnest(generate_series(0, 68)) AS j) b) SELECT g.i, g.j::BIGINT AS j, value FROM g LEFT JOIN q ON q.i = g.i AND q.j = g.j - 2")
def pad_missing(spark: SparkSession, sf: str) -> DataFrame:
    return shape.pad_missing(whole_cells(spark, sf), "j", 2, 3).frame()


@query(f"WITH {M} SELECT i, list(value ORDER BY j) AS values, len(list(value ORDER BY j))::BIGINT AS n FROM m GROUP BY i")
def cells_to_packed(spark: SparkSession, sf: str) -> DataFrame:
    return C.to_packed(masked_cells(spark, sf), "j", "values").withColumn("n", F.size("values").cast("long"))


@query("SELECT i::BIGINT AS i, j::BIGINT AS j, 2.5::DOUBLE AS value FROM range(30) a(i), range(7) b(j)")
def full_array(spark: SparkSession, sf: str) -> DataFrame:
    return C.full(spark, ("i", "j"), (30, 7), 2.5).frame()


@query(f"WITH {Q} SELECT i, j, CASE WHEN value > 40 THEN value ELSE 0 END AS value FROM q")
def sparse_to_dense(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return C.densified(replace(c, df=c.df.where("value > 40")), 0).frame()


@query(f"WITH {M} SELECT i, j, value IS NULL AS value FROM m")
def mask_of(spark: SparkSession, sf: str) -> DataFrame:
    return masking.mask(masked_cells(spark, sf)).frame()


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity >= 10 AND l_quantity <= 40 THEN l_extendedprice END AS price, CASE WHEN l_discount >= 0.02 THEN l_discount END AS discount FROM lineitem")
def mask_valid_range(spark: SparkSession, sf: str) -> DataFrame:
    bad = masking.validity(F.col("l_quantity"), valid_range=(10, 40))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(~bad, F.col("l_extendedprice")).alias("price"), F.when(~masking.validity(F.col("l_discount"), valid_min=0.02), F.col("l_discount")).alias("discount"))


@query(f"WITH {Q} SELECT i, j, CASE WHEN value NOT IN (-3, 0, 12) THEN value END AS value FROM q")
def mask_fill_values(spark: SparkSession, sf: str) -> DataFrame:
    return masking.apply_masking(whole_cells(spark, sf), fill_values=(-3, 0, 12)).frame()


@query(f"WITH {Q} SELECT i, j, CASE WHEN NOT (i % 5 = 0 AND value > 0) THEN value END AS value FROM q")
def mask_where(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return masking.masked_where(c, (F.col("i") % 5 == 0) & (c.v > 0)).frame()


@query(f"WITH {E} SELECT i, j, CASE WHEN abs(f::DOUBLE - 0.25) <= 0.01 + 0.1 * 0.25 THEN NULL ELSE f::DOUBLE END AS value FROM e")
def masked_values_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    c = embedding_cells(spark, sf)
    return masking.masked_values(c.select(c.v.cast("double")), 0.25, rtol=0.1, atol=0.01).frame()


@query(f"WITH {M} SELECT i, j, coalesce(value, -9999) AS value FROM m")
def filled(spark: SparkSession, sf: str) -> DataFrame:
    return masking.filled(masked_cells(spark, sf), -9999).frame()


@query(f"WITH {M} SELECT i, j, coalesce(value::INTEGER, -2147483647) AS value FROM m")
def filled_default(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return masking.filled(c.select(c.v.cast("int"))).frame()


@query(f"WITH {M} SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, value FROM m WHERE value IS NOT NULL")
def compressed_drop_masked(spark: SparkSession, sf: str) -> DataFrame:
    return masking.compressed(masked_cells(spark, sf), "k").frame()


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 7 THEN NULL ELSE l_quantity * 0.5 + 100 END AS value FROM lineitem")
def unpack_scale_offset(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_quantity").cast("int")
    masked = F.when(~masking.validity(x, fill_values=(7,)), x)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", codecs.unpacked(masked, 0.5, 100.0).alias("value"))


@query(f"WITH {Q} SELECT i, j, CASE WHEN value < 0 THEN value + 65536 ELSE value END::INTEGER AS value FROM q")
def unsigned_view(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return c.select(codecs.unsigned(c.v.cast("smallint"), "smallint")).frame()


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_quantity - 1) / 2.0, 0)::SMALLINT AS packed FROM lineitem")
def pack_half_even(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", codecs.packed(F.col("l_quantity"), 2.0, 1.0).alias("packed"))


@query("SELECT c_custkey, list_transform(generate_series(1, 12), lambda k: substring(c_mktsegment, k, 1)) AS chars, rtrim(c_mktsegment) AS back FROM customer")
def string_characters(spark: SparkSession, sf: str) -> DataFrame:
    chars = codecs.characters(F.col("c_mktsegment"), 12)
    return table(spark, sf, "customer").select("c_custkey", chars.alias("chars"), codecs.joined(chars).alias("back"))


@query(f"WITH {M}, c AS (SELECT *, CASE WHEN (i + j) % 3 = 0 THEN NULL ELSE value > 0 END AS yes FROM m) SELECT i, j, CASE WHEN value IS NULL THEN NULL WHEN yes THEN 1 WHEN NOT yes THEN -1 ELSE value END AS value FROM c")
def where_three_way(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    yes = F.when((F.col("i") + F.col("j")) % 3 != 0, c.v > 0)
    return c.select(masking.where(yes, c.v, F.lit(1).cast("long"), F.lit(-1).cast("long"))).frame()


@query(f"WITH {Q}, n AS (SELECT *, CASE WHEN value % 5 = 0 THEN NULL WHEN value % 3 = 0 THEN 'nan'::DOUBLE ELSE value::DOUBLE END AS x FROM q) SELECT i, j, CASE WHEN x IS NULL THEN NULL ELSE NOT isnan(x) AND x = x END AS eq, CASE WHEN x IS NULL THEN NULL ELSE isnan(x) OR x <> 4 END AS ne, CASE WHEN x IS NULL THEN NULL ELSE NOT isnan(x) AND x > 4 END AS gt, CASE WHEN x IS NULL THEN NULL ELSE NOT isnan(x) AND x >= 4 END AS ge, CASE WHEN x IS NULL THEN NULL ELSE NOT isnan(x) AND x < 4 END AS lt, CASE WHEN x IS NULL THEN NULL ELSE NOT isnan(x) AND x <= 4 END AS le FROM n")
def compare_nan(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    x = F.when(c.v % 5 == 0, None).when(c.v % 3 == 0, float("nan")).otherwise(c.v.cast("double"))
    four = F.lit(4.0)
    return c.df.select("i", "j", x.alias("x")).select("i", "j", elementwise.compare("==", F.col("x"), F.col("x")).alias("eq"), *(elementwise.compare(op, F.col("x"), four).alias(n) for op, n in (("!=", "ne"), (">", "gt"), (">=", "ge"), ("<", "lt"), ("<=", "le"))))


@query(f"WITH {M} SELECT a.i, a.j, a.value > b.value AS value FROM m a JOIN (SELECT j, value FROM m WHERE i = 0) b USING (j)")
def compare_aligned(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return elementwise.binary(">", c, indexing.subspace(c, (0,))).frame()


@query(f"WITH {Q} SELECT i, j, value & 12 AS a, value | 12 AS o, xor(value, 12) AS x FROM q")
def bit_and_or_xor(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return c.df.select("i", "j", *(elementwise.bits(op, c.v, F.lit(12)).alias(n) for op, n in (("&", "a"), ("|", "o"), ("^", "x"))))


@query(f"WITH {Q} SELECT i, j, abs(value) << (j % 8) AS l, value >> (j % 8) AS r FROM q")
def bit_shift(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return c.df.select("i", "j", elementwise.bits("<<", F.abs(c.v), F.col("j") % 8).alias("l"), elementwise.bits(">>", c.v, F.col("j") % 8).alias("r"))


@query(f"WITH {M} SELECT i, j, abs(value) AS a, -value AS n, ~value AS b, value AS p FROM m")
def unary_operators(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return c.df.select("i", "j", *(elementwise.unary(op, c.v).alias(n) for op, n in (("abs", "a"), ("-", "n"), ("~", "b"), ("+", "p"))))


for _how, _sql in (("max", "max(value)"), ("min", "min(value)"), ("sum", "sum(value)::BIGINT"), ("any", "bool_or(value <> 0)"), ("all", "bool_and(value <> 0)")):

    def _all(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return reduce.collapse(masked_cells(spark, sf), how).frame()

    def _axis(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return reduce.collapse(masked_cells(spark, sf), how, ("j",), squeeze=True).frame()

    def _kept(spark: SparkSession, sf: str, how: str = _how) -> DataFrame:
        return reduce.collapse(masked_cells(spark, sf), how, ("i",)).frame()

    for _f, _name, _text in ((_all, "all_axes", f"SELECT 0::BIGINT AS i, 0::BIGINT AS j, {_sql} AS value FROM m"), (_axis, "last_axis", f"SELECT i, {_sql} AS value FROM m GROUP BY i"), (_kept, "first_axis", f"SELECT 0::BIGINT AS i, j, {_sql} AS value FROM m GROUP BY j")):
        _f.__name__ = f"reduce_{_how}_{_name}"
        query(f"WITH {M} {_text}")(_f)


@query(f"WITH {Q}, n AS (SELECT i, CASE WHEN value % 11 = 0 THEN NULL WHEN value % 50 = 1 THEN 'nan'::DOUBLE ELSE value::DOUBLE END AS x FROM q) SELECT i, CASE WHEN bool_or(isnan(x)) THEN 'nan'::DOUBLE ELSE min(x) END AS value FROM n GROUP BY i")
def reduce_min_nan(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return reduce.collapse(c.select(F.when(c.v % 11 == 0, None).when(c.v % 50 == 1, float("nan")).otherwise(c.v.cast("double"))), "min", ("j",), squeeze=True).frame()


@query(f"WITH {Q} SELECT i, max(CASE WHEN i % 2 = 0 THEN value END) AS value FROM q GROUP BY i")
def reduce_all_masked(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return reduce.collapse(c.select(F.when(F.col("i") % 2 == 0, c.v)), "max", ("j",), squeeze=True).frame()


@query(f"WITH {M} SELECT DISTINCT value FROM m")
def unique_values(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.unique(masked_cells(spark, sf))


@query(f"WITH {M} SELECT arg_min(value, i * 64 + j) FILTER (i * 64 + j = 0) AS first_element, max(value) FILTER (i * 64 + j = 1) AS second_element, arg_max(value, i * 64 + j) AS last_element FROM q JOIN m USING (i, j, value)")
def ends_cache(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return C.ends(replace(c, df=c.df.where("value is not null")))


@query(f"WITH {M} SELECT i, coalesce(max(CASE WHEN value IS NOT NULL THEN j + 1 END), 0) AS count FROM m GROUP BY i")
def trailing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reduce.trailing_count(masked_cells(spark, sf), "j")


@query(f"WITH {Q} SELECT i, j, value FROM q WHERE j < 8 UNION ALL SELECT i, 8 + (63 - j), value FROM q WHERE j >= 56 UNION ALL SELECT i, 16, value FROM q WHERE j = 30")
def concat_three(spark: SparkSession, sf: str) -> DataFrame:
    c = whole_cells(spark, sf)
    return combine.concatenate([indexing.subspace(c, (..., slice(8))), indexing.subspace(c, (..., slice(None, 55, -1))), indexing.subspace(c, (..., 30))], "j").frame()


@query(f"WITH {Q}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT CASE WHEN i >= n // 3 THEN i - n // 3 ELSE i + n - n // 3 END AS i, j, value FROM q, n")
def concat_axis(spark: SparkSession, sf: str) -> DataFrame:
    """The last two thirds, then the first."""
    c = whole_cells(spark, sf)
    k = c.shape[0] // 3
    return combine.concatenate([indexing.subspace(c, (slice(k, None),)), indexing.subspace(c, (slice(k),))], "i").frame()


@query(f"WITH {Q}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT i, j, CASE WHEN i < n // 2 THEN value::DOUBLE ELSE value::DOUBLE * 1000.0 END AS value FROM q, n")
def concat_units(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves, the second in other units."""
    c = whole_cells(spark, sf)
    c = replace(c.select(c.v.cast("double")), units="m")
    k = c.shape[0] // 2
    return combine.concatenate([indexing.subspace(c, (slice(k),)), replace(indexing.subspace(c, (slice(k, None),)), units="km")], "i").frame()


@query("WITH s AS (SELECT *, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS shared FROM supplier) SELECT s_suppkey, s_nationkey, shared FROM s")
def dedupe_components(spark: SparkSession, sf: str) -> DataFrame:
    return combine.dropped_repeats(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", ["s_nationkey"])


@query(f"WITH {M} SELECT count(*) AS cells, true AS masks_equal, bool_and(value IS NULL OR abs(value - (value + CASE WHEN i = 3 THEN 1 ELSE 0 END)) <= 0.5) AS close FROM m")
def equals_allclose(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return equality.summary(c, c.select(c.v + F.when(F.col("i") == 3, 1).otherwise(0)), rtol=0.0, atol=0.5)


@query(f"WITH {M} SELECT count(*) AS cells, bool_and((value IS NULL) = (b IS NULL)) AS masks_equal, bool_and((value IS NULL AND b IS NULL) OR coalesce(abs(value - b) <= 0, false)) AS close FROM (SELECT *, CASE WHEN i <> 9 THEN value END AS b FROM m)")
def equals_mask_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return equality.summary(c, c.select(F.when(F.col("i") != 9, c.v)), rtol=0.0, atol=0.0)


@query(f"WITH {M}, d AS (SELECT *, CASE WHEN i = 9 THEN NULL WHEN i = 4 THEN value + 2 ELSE value END AS b FROM m) SELECT i, j, value AS x, b AS y FROM d WHERE NOT (value IS NULL AND b IS NULL) AND NOT coalesce(value = b, false)")
def diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = masked_cells(spark, sf)
    return equality.differing(c, c.select(F.when(F.col("i") == 9, None).when(F.col("i") == 4, c.v + 2).otherwise(c.v)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice = 0 THEN 0 ELSE (floor(l_extendedprice / pow(2.0, floor(3.3219280948873626 * (floor(log10(l_extendedprice)) + 1 - 3)))) + 0.5) * pow(2.0, floor(3.3219280948873626 * (floor(log10(l_extendedprice)) + 1 - 3))) END AS value FROM lineitem")
def quantise_digitround(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", codecs.quantised(F.col("l_extendedprice"), "digitround", 3).alias("value"))


@query(f"WITH {E}, p AS (SELECT i, j, f::DOUBLE AS x, CASE WHEN f = 0 THEN 1 ELSE pow(2.0, floor(log2(abs(f::DOUBLE)))) END AS p FROM e) SELECT i, j, round_even(x / (p / 256), 0) * (p / 256) AS value FROM p")
def quantise_bitround(spark: SparkSession, sf: str) -> DataFrame:
    c = embedding_cells(spark, sf)
    return c.select(codecs.quantised(c.v, "bitround", 8)).frame()


_POWER = "CASE WHEN f = 0 THEN 0 ELSE floor(log2(abs(f::DOUBLE))) END"
_P = f"{E}, p0 AS (SELECT i, j, f::DOUBLE AS x, {_POWER} AS g FROM e), p AS (SELECT i, j, x, CASE WHEN x <> 0 AND pow(2.0, g) > abs(x) THEN g - 1 WHEN x <> 0 AND pow(2.0, g + 1) <= abs(x) THEN g + 1 ELSE g END AS g FROM p0)"


@query(
    f"WITH {_P}, s AS (SELECT i, j, x, g, floor(abs(x) / pow(2.0, g - 11)) * pow(2.0, g - 11) AS low FROM p) "
    "SELECT i, j, CASE WHEN x = 0 THEN x ELSE sign(x) * CASE WHEN (i * 64 + j) % 2 = 0 THEN low ELSE low + (pow(2.0, g - 11) - pow(2.0, g - 23)) END END::FLOAT AS value FROM s"
)
def quantise_bitgroom(spark: SparkSession, sf: str) -> DataFrame:
    c = embedding_cells(spark, sf)
    return c.select(codecs.quantised(c.v, "bitgroom", 3, "float", C.linear_index(c))).frame()


@query(
    "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DOUBLE AS x, floor(log2(l_extendedprice::DOUBLE)) AS g FROM lineitem), "
    "w AS (SELECT *, CASE WHEN pow(2.0, g) > x THEN g ELSE CASE WHEN pow(2.0, g + 1) <= x THEN g + 2 ELSE g + 1 END END AS e FROM v), "
    "d AS (SELECT *, log10(x / pow(2.0, e)) AS m FROM w), "
    "q AS (SELECT *, floor(3.3219280948873626 * (floor(e * 0.30102999566398120 + m) + 1 - 3)) AS q FROM d), "
    "s AS (SELECT *, pow(2.0, e - 1 - (abs(floor(e - 3.3219280948873626 * m) - q) - 1)) AS step FROM q) "
    "SELECT l_orderkey, l_linenumber, l_partkey, floor(x / step + 0.5) * step AS value FROM s"
)
def quantise_granular_bitround(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", codecs.quantised(F.col("l_extendedprice"), "granular_bitround", 3).alias("value"))


@query(
    "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS x, o_totalprice AS v FROM orders), n AS (SELECT count(*) AS n FROM o) "
    "SELECT x, round(v::DOUBLE, 4) AS value, [round(v - 1, 4), round(v + 1, 4), NULL, NULL]::DOUBLE[] AS bounds FROM o UNION ALL SELECT x + n, round(v::DOUBLE, 4), [round(v, 4), round(v + 1, 4), round(v + 2, 4), CASE WHEN x % 2 = 0 THEN round(v + 3, 4) END]::DOUBLE[] FROM o, n"
)
def concat_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Fields with cells of two, and of three and four, corners end to end, the second in kilometres: corners are padded and follow the units."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("v"))
    n = rows.count()
    rows = dense_places(rows, "o_orderkey", n, "x")
    v, four = F.col("v"), F.col("x") % 2 == 0

    def field(bounds: object, scale: float, units: str) -> Field:
        data = Cells(rows.select("x", (v * scale).alias("value")), ("x",), (n,), units=units)
        edges = rows.select("x", F.transform(bounds, lambda y: y * scale).alias("bounds"))
        return Field(data, (Construct("x", "domain_axis", size=n), Construct("d", "dimension_coordinate", ("x",), data=data, bounds=edges)))

    both = combine.concatenate_fields([field(F.array(v - 1, v + 1), 1.0, "m"), field(F.when(four, F.array(v, v + 1, v + 2, v + 3)).otherwise(F.array(v, v + 1, v + 2)), 0.001, "km")], "x")
    c = both.constructs[1]
    return c.data.df.join(c.bounds, "x").select("x", F.round("value", 4).alias("value"), F.transform("bounds", lambda y: F.round(y, 4)).alias("bounds"))
