"""Kernels against numpy and known values, and algebraic laws."""

from dataclasses import replace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.functions import attrs, codecs, time, units
from gridspark.model import Cells, Construct, Field
from gridspark.operators import cells, combine, elementwise, equality, fragments, gathered, indexing, masking, matching, mesh, ragged, reduce, shape, tiepoints
from gridspark.plans import catalog
from gridspark.sources import netcdf3

quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def made(spark, x, gone=None):
    gone = np.zeros(x.shape, bool) if gone is None else gone
    axes = tuple("abcd"[: x.ndim])
    rows = [(*map(int, k), None if gone[k] else x[k].item()) for k in np.ndindex(x.shape)]
    return Cells(spark.createDataFrame(rows, ", ".join(f"{a} long" for a in axes) + f", value {'long' if x.dtype.kind == 'i' else 'double'}"), axes, x.shape)


def back(c):
    out = np.ma.masked_all(c.shape, float)
    for r in c.df.select(*c.axes, c.value).collect():
        if r[-1] is not None:
            out[tuple(r[:-1])] = r[-1]
    return out


def same(a, b):
    assert a.shape == b.shape
    assert (np.ma.getmaskarray(a) == np.ma.getmaskarray(b)).all()
    assert np.ma.allequal(a, b)


X = np.arange(60).reshape(3, 4, 5)
GONE = X % 7 == 3


@pytest.mark.parametrize("index", [(1,), (slice(None, None, -1), slice(1, 3)), ([2, 0], [0, 3, 1]), (..., [True, False, True, False, True]), (slice(0, 3, 2), -1, slice(4, None, -2)), (..., [0, 0, 4])])
def test_subspace_is_orthogonal_and_keeps_axes(spark, index):
    got = back(indexing.subspace(made(spark, X, GONE), index))
    want = np.ma.array(X, mask=GONE)
    for axis, chosen in enumerate(indexing.parsed(index, X.shape)):
        want = want.take(list(chosen), axis=axis)
    same(got, want)


def test_indices_are_checked():
    with pytest.raises(IndexError):
        indexing.parsed((0, 5), (3, 4))
    with pytest.raises(IndexError):
        indexing.parsed(([True, False],), (3,))
    with pytest.raises(IndexError):
        indexing.parsed((0, 0, 0), (3, 4))


@pytest.mark.parametrize("how", ["max", "min", "sum", "any", "all"])
@pytest.mark.parametrize("axes", [None, ("a",), ("b", "c")])
def test_reductions(spark, how, axes):
    x = np.ma.array(X, mask=GONE | (X < 20))
    got = back(reduce.collapse(made(spark, X, GONE | (X < 20)), how, axes))
    numbers = None if axes is None else tuple("abc".index(a) for a in axes)
    want = getattr(x, how)(axis=numbers, keepdims=True)
    same(got, np.ma.array(want, dtype=float))


def test_min_propagates_nan(spark):
    c = made(spark, np.array([[1.0, np.nan], [3.0, 2.0]]))
    got = {r["a"]: r["value"] for r in reduce.collapse(c, "min", ("b",), squeeze=True).df.collect()}
    assert np.isnan(got[0]) and got[1] == 2


def test_shape_algebra(spark):
    c, x = made(spark, X, GONE), np.ma.array(X, mask=GONE)
    same(back(shape.transpose(c, ("c", "a", "b"))), x.transpose(2, 0, 1))
    same(back(shape.flatten(c)), x.reshape(-1))
    same(back(shape.reshape(c, ("p", "q"), (6, 10))), x.reshape(6, 10))
    same(back(shape.squeeze(shape.insert_dimension(c, "k", 2), ("k",))), x)
    padded = back(shape.pad_missing(c, "b", 1, 2))
    same(padded[:, 1:5], x)
    assert np.ma.getmaskarray(padded)[:, [0, 5, 6]].all()
    with pytest.raises(ValueError):
        shape.squeeze(c, ("a",))
    with pytest.raises(ValueError):
        shape.reshape(c, ("p",), (7,))


def test_compressed_and_elements(spark):
    c, x = made(spark, X, GONE), np.ma.array(X, mask=GONE)
    got = [r["value"] for r in masking.compressed(c, "k").df.orderBy("k").collect()]
    assert got == x.compressed().tolist()
    assert tuple(cells.ends(made(spark, X)).first()) == (0, 1, 59)


def test_ends_of_a_table_without_its_first_cell(spark):
    c = made(spark, X)
    assert tuple(cells.ends(replace(c, df=c.df.where(c.v > 0))).first()) == (None, 1, 59)
    assert tuple(cells.ends(replace(c, df=c.df.where(c.v > 7))).first()) == (None, None, 59)


@quick
@given(st.lists(st.integers(0, 6), min_size=1, max_size=6))
def test_ragged_there_and_back(spark, counts):
    x = np.full((len(counts), 7), -1)
    gone = np.arange(7)[None] >= np.array(counts)[:, None]
    c = made(spark, x, gone)
    samples, n = ragged.compress_contiguous(c, "b")
    assert sorted(tuple(r) for r in n.collect()) == list(enumerate(counts))
    dense = ragged.padded(ragged.contiguous(samples, n, "o", "a", "count"), "a", "e", ["value"], 7)
    got = Cells(dense.withColumnRenamed("e", "b"), ("a", "b"), x.shape)
    same(back(got), np.ma.array(x, mask=gone, dtype=float))


def test_ragged_values(spark):
    counts = spark.createDataFrame(list(enumerate([2, 0, 6, 4])), "i long, n int")
    rows = ragged.contiguous(spark.createDataFrame([(k, k * 10) for k in range(12)], "o long, x int"), counts, "o", "i", "n").orderBy("i", "e").collect()
    assert [(r["i"], r["e"], r["x"]) for r in rows if r["i"] in (0, 1)] == [(0, 0, 0), (0, 1, 10), (1, None, None)]
    assert [r["x"] for r in rows if r["i"] == 3] == [80, 90, 100, 110]


def test_gathered_there_and_back(spark):
    c = made(spark, X, GONE)
    on, places = gathered.gather(c, ("b", "c"))
    out = gathered.scatter(on, places, "item", "place", ("b", "c"), (4, 5), ("a",))
    same(back(Cells(out, ("a", "b", "c"), X.shape)), np.ma.array(X, mask=GONE, dtype=float))


def test_tie_points(spark):
    ties = {0: 3.0, 6: -9.0, 7: 1.0, 10: 2.5, 15: 30.0}
    tie = spark.createDataFrame(list(ties.items()), "k long, value double")
    got = [r["value"] for r in tiepoints.interpolated(tie, "k").orderBy("i").collect()]
    assert np.allclose(got, np.interp(np.arange(16), list(ties), list(ties.values())))
    ends = spark.createDataFrame([(0, 2.0), (3, 10.0), (4, 10.0), (6, 11.5)], "k long, value double")
    edges = np.r_[np.linspace(2, 10, 5), np.linspace(10, 11.5, 4)[1:]]
    b = [r["bounds"] for r in tiepoints.bounds(ends, "k").orderBy("i").collect()]
    assert np.allclose(b, np.c_[edges[:-1], edges[1:]])


def test_quadratic_gives_back_the_value(spark):
    r = spark.range(1).select(tiepoints.quadratic(F.lit(1.0), F.lit(4.0), tiepoints.quadratic_w(F.lit(1.0), F.lit(4.0), F.lit(9.0), F.lit(0.3)), F.lit(0.3)).alias("u"), *tiepoints.quadratic_lat_lon(*map(F.lit, (0.0, 0.0, 0.0, 90.0, 0.0, 0.0, 0.5)), F.lit(True))).first()
    assert abs(r[0] - 9) < 1e-12 and abs(r[1]) < 1e-12 and abs(r[2] - 45) < 1e-9


FACES = [(0, [0, 1, 5, 4]), (1, [1, 2, 5, None]), (2, [2, 3, 7, 5]), (3, [4, 5, 6, None])]


def test_mesh(spark):
    faces = spark.createDataFrame(FACES, "cell long, nodes array<long>")
    edges = set()
    for _, nodes in FACES:
        own = [n for n in nodes if n is not None]
        edges |= {tuple(sorted(e)) for e in zip(own, own[1:] + own[:1])}
    assert sorted(tuple(r) for r in mesh.edges_from_faces(faces).collect()) == sorted(edges)
    points = {r["node"]: r["neighbours"] for r in mesh.points_from_faces(faces).collect()}
    assert points == {n: sorted({a + b - n for a, b in edges if n in (a, b)}) for n in range(8)}
    assert sorted(tuple(r) for r in mesh.edges_from_points(mesh.points_from_faces(faces)).collect()) == sorted(edges)
    shifted = faces.select("cell", F.transform("nodes", lambda x: x * 3 + 11).alias("nodes"))
    got = {r["cell"]: r["nodes"] for r in mesh.normalised(shifted, "cell", "nodes").collect()}
    assert got == dict(FACES)
    again = {r["cell"]: r["nodes"] for r in mesh.normalised(mesh.normalised(shifted, "cell", "nodes"), "cell", "nodes").collect()}
    assert again == got
    place = np.sqrt(np.arange(8))
    x = spark.createDataFrame([(k, float(v)) for k, v in enumerate(place)], "node long, x double")
    bounds = {r["cell"]: r["bounds"] for r in mesh.bounds_from_nodes(faces, "cell", "nodes", x, "node", "x").collect()}
    assert bounds == {c: [None if n is None else place[n] for n in nodes] for c, nodes in FACES}
    found = faces.join(spark.createDataFrame(list(bounds.items()), "cell long, bounds array<double>"), "cell")
    assert {r["node"]: r["coordinate"] for r in mesh.node_coordinates(found, "cell", "nodes", "bounds").collect()} == dict(enumerate(place))


def test_concatenation_is_associative_and_splits_back(spark):
    c = made(spark, X, GONE)
    parts = [indexing.subspace(c, (..., slice(a, b))) for a, b in ((0, 1), (1, 3), (3, 5))]
    one = combine.concatenate([combine.concatenate(parts[:2], "c"), parts[2]], "c")
    two = combine.concatenate([parts[0], combine.concatenate(parts[1:], "c")], "c")
    assert equality.equal(one, two) and equality.equal(one, c)
    with pytest.raises(ValueError):
        combine.concatenate([c, indexing.subspace(c, (0,))], "c")


def test_equality(spark):
    c = made(spark, X.astype(float), GONE)
    assert equality.equal(c, c.select(c.v + 1e-17))
    assert not equality.equal(c, c.select(c.v + 1e-3))
    assert not equality.equal(c, masking.filled(c, 0.0))
    assert equality.differing(c, masking.filled(c, 0.0)).count() == GONE.sum()


def test_fields(spark):
    lat = Cells(spark.createDataFrame([(k, k * 10.0) for k in range(4)], "b long, value double"), ("b",), (4,))
    bounds = spark.createDataFrame([(k, [k * 10.0 - 5, k * 10.0 + 5]) for k in range(4)], "b long, bounds array<double>")
    f = Field(made(spark, X), (Construct("b", "domain_axis", size=4), Construct("dimensioncoordinate0", "dimension_coordinate", ("b",), {"standard_name": "latitude"}, data=lat, bounds=bounds)))
    cut = indexing.subspace_field(f, (..., slice(3, 0, -1), slice(None)))
    assert cut.data.shape == (3, 3, 5) and cut.constructs[0].size == 3
    assert [r["bounds"] for r in cut.constructs[1].bounds.orderBy("b").collect()] == [[35, 25], [25, 15], [15, 5]]
    assert indexing.indices(f, latitude=[30.0, 10.0]) == (slice(None), [1, 3], slice(None))
    with pytest.raises(IndexError):
        indexing.indices(f, latitude=[99.0])
    assert matching.matched(f, f).axes == {"b": "b", "a": "a", "c": "c"}
    joined = combine.concatenate_fields([f, f], "b")
    assert joined.data.sizes["b"] == 8 and joined.construct("latitude").data.shape == (8,)


def test_masks(spark):
    c = made(spark, np.array([1.0, 2.0, -9.0, 4.0, np.nan]))
    got = back(masking.apply_masking(c, fill_values=(-9.0,), valid_range=(2, 4)))
    assert np.ma.getmaskarray(got).tolist() == [True, False, True, False, False]
    with pytest.raises(ValueError):
        masking.validity(F.lit(1), valid_min=0, valid_range=(0, 1))
    hard = indexing.assign(masking.masked_where(c, c.v == 1), (slice(0, 2),), 7.0)
    assert np.ma.getmaskarray(back(hard))[0] and back(hard)[1] == 7
    assert back(indexing.assign(masking.soften_mask(masking.masked_where(c, c.v == 1)), (slice(0, 2),), 7.0))[0] == 7


def test_binary_operators(spark):
    a, b = made(spark, np.array([[1, 2, 3], [4, 5, 6]])), made(spark, np.array([[3, 2, 1]]))
    assert back(elementwise.binary(">=", a, b)).tolist() == [[False, True, True], [True, True, True]]
    assert back(elementwise.binary("^", a, 3)).tolist() == [[2, 1, 0], [7, 6, 5]]


def test_codecs(spark):
    r = spark.range(1).select(codecs.packed(F.lit(2.5), None, None).alias("a"), codecs.packed(F.lit(3.5)).alias("b"), codecs.unsigned(F.lit(-1).cast("tinyint"), "tinyint").alias("c"), codecs.unsigned(F.lit(-1).cast("bigint"), "bigint").alias("d"), codecs.bit_rounded(F.lit(3.14159), 4).alias("e"), codecs.significant(F.lit(-123.456), 2).alias("f")).first()
    assert (r["a"], r["b"], r["c"], int(r["d"]), r["e"]) == (2, 4, 255, 2**64 - 1, 3.125)
    assert abs(r["f"] + 123.456) < 5


def test_units_and_times(spark):
    assert units.equivalent("km", "metres") and not units.equivalent("km", "s")
    with pytest.raises(ValueError):
        units.converted(F.lit(1), "km", "K")
    r = spark.range(1).select(units.converted(F.lit(25.0), "celsius", "K").alias("k"), time.rebase(F.lit(1.0), "days since 2000-01-02", "hours since 2000-01-01").alias("h"), time.fields(F.lit(59), "days since 2001-01-01", "all_leap").alias("d"), time.to_text(time.decode(F.lit(36.5), "hours since 1999-12-31")).alias("t")).first()
    assert r["k"] == 298.15 and r["h"] == 48 and (r["d"]["year"], r["d"]["month"], r["d"]["day"]) == (2001, 2, 29)
    assert r["t"] == "2000-01-01 12:30:00"
    with pytest.raises(ValueError):
        time.reference("2000-01-01T00:00:00+01:00")


def test_attribute_languages():
    text = "lat: lon: mean where land over sea (interval: 1 day interval: 2 m comment: rough) time: maximum within years (sampled)"
    got = attrs.parse_cell_methods(text)
    assert got[0] == {"axes": ["lat", "lon"], "method": "mean", "where": "land", "over": "sea", "intervals": [(1.0, "day"), (2.0, "m")], "comment": "rough"}
    assert got[1] == {"axes": ["time"], "method": "maximum", "within": "years", "comment": "sampled"}
    assert attrs.parse_cell_methods(attrs.format_cell_methods(got)) == got
    assert attrs.parse_key_values("a: x y b: z") == {"a": ["x", "y"], "b": ["z"]}
    assert attrs.parse_coordinate_interpolation("lat: lon: i1 t: i2") == [(["lat", "lon"], "i1"), (["t"], "i2")]
    with pytest.raises(ValueError):
        attrs.parse_cell_methods("mean")


def test_catalogue(spark):
    own = [
        Construct("a", "domain_axis", size=6, ncdim="z"),
        Construct("b", "dimension_coordinate", ("a",), {"standard_name": "depth", "units": "m", "axis": "Z"}, ncvar="d"),
        Construct("c", "cell_method", ("a",), method="range"),
        Construct("e", "auxiliary_coordinate", ("a",), {"long_name": "layer", "comment": "x"}),
    ]
    rows = catalog.catalogue(spark, own)
    s = catalog.Selection(rows)
    assert s.filter(catalog.by_identity("depth")).key() == "b"
    with pytest.raises(ValueError):
        s.filter(catalog.by_naxes(1)).key()
    assert combine.unique_constructs([own[1], own[2], own[1]]) == [own[1], own[2]]
    names = ["key", "naxes", "identity", "identities"]
    assert sorted(catalog.named(rows.drop(*names[1:])).select(names).collect()) == sorted(rows.select(names).collect())


def test_fragments():
    m = fragments.manifest([[2, 3], [4]], ["a.nc", "s3://b/c.nc"], ["x"], base="/d")
    assert m[1] == {"start": [2, 0], "stop": [5, 4], "uri": "s3://b/c.nc", "identifier": "x"} and m[0]["uri"] == "/d/a.nc"


def test_netcdf(spark, tmp_path):
    path = str(tmp_path / "t.nc")
    x = np.array([[1, 2, -99], [4, 50, 6]], np.int16)
    netcdf3.write_file(path, {"y": 2, "x": 3}, {"t": (("y", "x"), x, {"_FillValue": -99, "scale_factor": 0.5, "add_offset": 10.0, "valid_max": 20, "units": "K"})}, {"title": "a"})
    h = netcdf3.read_header(path)
    assert h.attributes == {"title": "a"} and h.dimensions == [("y", 2), ("x", 3)]
    c = netcdf3.read(spark, path, "t", cells="2")
    assert c.units == "K"
    same(back(c), np.ma.array(x * 0.5 + 10, mask=(x == -99) | (x > 20)))
    assert netcdf3.read(spark, path, "t", mask="false", unpack="false").df.where("value = -99").count() == 1


def test_bi_quadratic_meets_its_sides(spark):
    """On the sides it is the quadratic interpolation of the side, on the sphere and in degrees."""
    c = [tuple(map(F.lit, x)) for x in ((10.0, 20.0), (12.0, 31.0), (19.0, 22.0), (21.0, 34.0))]
    sides = {k: (F.lit(0.01 * i), F.lit(-0.02 * i)) for i, k in enumerate(("ab", "cd", "ac", "bd", "z"))}
    for sphere in (True, False):
        cartesian = F.lit(sphere)
        for p, q, side, s1, s2 in ((0, 1, "ab", 0.3, 0.0), (2, 3, "cd", 0.3, 1.0), (0, 2, "ac", 0.0, 0.3), (1, 3, "bd", 1.0, 0.3)):
            got = tiepoints.bi_quadratic_lat_lon(tuple(c), sides, F.lit(s1), F.lit(s2), cartesian)
            want = tiepoints.quadratic_lat_lon(*c[p], *c[q], *sides[side], F.lit(0.3), cartesian)
            r = spark.range(1).select(*got, *want).first()
            assert abs(r[0] - r[2]) < 1e-9 and abs(r[1] - r[3]) < 1e-9
