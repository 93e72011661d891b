"""Matching of axes, references in groups, linked meshes, quantisation."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.functions import codecs
from gridspark.model import Cells, Construct, Field
from gridspark.operators import combine, groups, matching, mesh, ragged, tiepoints

quick = settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def cells(spark, x, axes, units=None):
    x = np.asarray(x)
    kind = {"i": "long", "f": "double", "U": "string"}[x.dtype.kind]
    rows = [(*map(int, k), x[k].item()) for k in np.ndindex(x.shape)]
    return Cells(spark.createDataFrame(rows, ", ".join(f"{a} long" for a in axes) + f", value {kind}"), tuple(axes), x.shape, units=units)


def aux(spark, key, axes, x, name="x", bounds=None):
    return Construct(key, "auxiliary_coordinate", tuple(axes), {"long_name": name}, data=cells(spark, x, axes), bounds=bounds)


def test_greedy_choices_are_undone(spark):
    """Both first constructs are equal in themselves, but only one way round agrees with what lies on two axes."""
    same, grid = [1.0, 2.0, 4.0], np.arange(9.0).reshape(3, 3)
    a = Field(cells(spark, grid, "pq"), (aux(spark, "a0", "p", same), aux(spark, "a1", "q", same), aux(spark, "a2", "pq", grid)))
    b = Field(cells(spark, grid.T, "sr"), (aux(spark, "b0", "s", same), aux(spark, "b1", "r", same), aux(spark, "b2", "sr", grid.T)))
    got = matching.matched(a, b)
    assert got.axes == {"p": "r", "q": "s"} and got.keys == {"a0": "b1", "a1": "b0", "a2": "b2"}
    assert sorted(map(tuple, matching.renamed(b.data, got.axes).df.select("p", "q", "value").collect())) == sorted((i, j, grid[i, j]) for i in range(3) for j in range(3))
    # Two axes never map to one.
    c = Field(cells(spark, grid.T, "sr"), (aux(spark, "b0", "s", same), aux(spark, "b1", "s", same), aux(spark, "b2", "sr", grid.T)))
    assert matching.matched(a, c) is None


@pytest.mark.parametrize("swap", [False, True])
def test_three_equal_axes(spark, swap):
    x = np.arange(8.0).reshape(2, 2, 2)
    a = Field(cells(spark, x, "pqr"), (aux(spark, "a", "pqr", x, "cube"), aux(spark, "e", "pq", x[0], "face")))
    axes = "tus" if swap else "stu"
    b = Field(cells(spark, x, axes), (aux(spark, "f", axes[:2], x[0], "face"), aux(spark, "b", axes, x, "cube")))
    assert matching.matched(a, b).axes == dict(zip("pqr", axes))


def test_tolerance_masks_bounds_and_kinds(spark):
    one = lambda x, **k: Field(cells(spark, [0.0, 0.0], "p"), (aux(spark, "a", "p", x, **k),))
    a = one([1.0, 2.0])
    assert matching.matched(a, one([1.0, 2.0 + 4e-16])) and not matching.matched(a, one([1.0, 2.001]))
    assert matching.matched(a, one([1.0, 2.001]), atol=0.01) and not matching.matched(a, one([1.0, 2.0 + 4e-16]), 0, 0)
    assert not matching.matched(a, one([1, 2])) and matching.matched(a, one([1, 2]), ignore_type=True)
    assert not matching.matched(one([1.0, np.nan]), one([1.0, np.nan])) and matching.matched(one([0.0, 1.0]), one([-0.0, 1.0]))
    assert not matching.matched(a, one([1.0, 2.0], name="y"))
    edges = lambda d: spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 2.0 + d])], "p long, bounds array<double>")
    assert not matching.matched(a, one([1.0, 2.0], bounds=edges(0)))
    assert matching.matched(one([1.0, 2.0], bounds=edges(0)), one([1.0, 2.0], bounds=edges(0))) and not matching.matched(one([1.0, 2.0], bounds=edges(0)), one([1.0, 2.0], bounds=edges(0.5)))
    text = lambda x: Field(cells(spark, [0.0, 0.0], "p"), (aux(spark, "a", "p", x),))
    assert matching.matched(text(["u", "v"]), text(["u", "v"])) and not matching.matched(text(["u", "v"]), text(["u", "w"]))


def test_cell_methods_and_bare_axes(spark):
    data = cells(spark, np.zeros((2, 3)), "pq")
    method = lambda *axes: Construct("m", "cell_method", axes, method="mean")
    size = lambda key, n: Construct(key, "domain_axis", size=n)
    a = Field(data, (size("p", 2), size("q", 3), size("z", 1), method("q")))
    other = cells(spark, np.zeros((2, 3)), "st")
    assert matching.matched(a, Field(other, (size("s", 2), size("t", 3), size("w", 1), method("t")))).axes == {"p": "s", "q": "t", "z": "w"}
    assert matching.matched(a, Field(other, (size("s", 2), size("t", 3), size("w", 1), method("s")))) is None
    assert matching.matched(a, Field(other, (size("s", 2), size("t", 3), method("t")))) is None


def test_jobs_do_not_grow_with_constructs(spark, monkeypatch):
    """All prints come from one job and all comparisons from another."""
    from pyspark.sql.classic.dataframe import DataFrame

    x, calls = np.arange(4.0), []
    for n in (2, 6):
        a = Field(cells(spark, x, "p"), tuple(aux(spark, f"a{k}", "p", x + k) for k in range(n)))
        b = Field(cells(spark, x, "q"), tuple(aux(spark, f"b{k}", "q", x + (n - 1 - k) + 1e-9) for k in range(n)))
        with monkeypatch.context() as m:
            collect = DataFrame.collect
            m.setattr(DataFrame, "collect", lambda self: calls.append(n) or collect(self))
            assert matching.matched(a, b, atol=1e-6).keys == {f"a{k}": f"b{n - 1 - k}" for k in range(n)}
        assert calls.count(n) == 2


def test_references_in_groups(spark):
    names = lambda rows: spark.createDataFrame(rows, "path string, name string")
    variables = names([("/", "x"), ("/a", "x"), ("/a/b/c", "x"), ("/a", "y"), ("/a/b", "z"), ("/a/b/d", "z"), ("/p", "w"), ("/q", "w"), ("/a/e", "k"), ("/f/g", "k"), ("/", "t")])
    want = [
        ("/a/b", "x", "/a", "proximal"), ("/a", "y", "/a", "proximal"), ("/", "z", "/a/b", "lateral"), ("/", "w", None, None), ("/a/b", "/p/w", "/p", "absolute"), ("/a/b", "../y", "/a", "relative"),
        ("/a/b", "c/x", "/a/b/c", "relative"), ("/", "../x", None, None), ("/a/b", "../../p/./w", "/p", "relative"), ("/a/b", "none", None, None), ("/a/b", "k", None, None), ("/a/b", "t", "/", "proximal"),
    ]
    out = groups.resolved(names([x[:2] for x in want]), variables)
    assert sorted(map(str, map(tuple, out.select("path", "name", "found_in", "how").collect()))) == sorted(map(str, want))
    # With dimensions, the search goes up to the local apex and then down from it.
    dims = names([("/a", "k"), ("/a", "t")])
    got = {(r["path"], r["name"]): (r["found_in"], r["how"]) for r in groups.resolved(names([("/a/b", "k"), ("/a/b", "t"), ("/a/b", "k")]), variables, dims).collect()}
    assert got == {("/a/b", "k"): ("/a/e", "lateral"), ("/a/b", "t"): (None, None)}
    assert groups.resolved(names([("/a/b", "k"), ("/a/b", "k")]), variables, dims).count() == 2


def test_linked_meshes(spark):
    rows = [("f", "face", [0, 1, 2, 3]), ("f", "face", [3, 2, 5, 4]), ("e", "edge", [2, 3]), ("g", "face", [0, 1, 2, 3, None])]
    rows += [("e", "edge", x) for x in ([1, 0], [1, 2], [0, 3], [2, 5], [5, 4], [4, 3], [4, 5])]
    rows += [("p", "point", x) for x in ([0, 1, 3], [1, 0, 2], [2, 1, 3, 5], [3, 0, 2, 4], [4, 3, 5], [5, 2, 4])]
    rows += [("other faces", "face", [0, 1, 2, 5, 4, 3]), ("other faces", "edge", [2, 3]), ("lone", "point", [7, None]), ("h", "face", [1, 0, 3, 2])]
    out = mesh.linked(spark.createDataFrame(rows, "domain string, kind string, nodes array<int>"))
    assert {r["domain"]: r["mesh"] for r in out.collect()} == {"f": "e", "e": "e", "p": "e", "g": "g", "h": "g", "other faces": "other faces", "lone": "lone"}


def test_empty_columns(spark):
    df = spark.createDataFrame([(0, [None, 1, None, 2, None]), (1, [None, 3, None, None, None])], "cell long, nodes array<int>")
    assert [r["nodes"] for r in mesh.without_empty_columns(df).orderBy("cell").collect()] == [[1, None, 2], [3, None, None]]
    assert [r["nodes"] for r in mesh.without_empty_columns(df.withColumn("nodes", F.array(F.lit(None).cast("int")))).collect()] == [[], []]


@quick
@given(st.lists(st.floats(-1e12, 1e12).filter(lambda x: abs(x) > 1e-12), min_size=1, max_size=30), st.integers(1, 7))
def test_quantisation_bounds(spark, values, digits):
    """Half a unit of the last digit that is kept bounds the errors of granular rounding; those of grooming stay below a unit and alternate."""
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k long, x double")
    for k, x, g, b in df.select("k", "x", codecs.quantised(F.col("x"), "granular_bitround", digits).alias("g"), codecs.quantised(F.col("x"), "bitgroom", digits, position=F.col("k")).alias("b")).collect():
        unit = 10.0 ** (np.floor(np.log10(abs(x))) + 1 - digits)
        assert abs(g - x) <= 0.5 * unit * (1 + 1e-9) and abs(b - x) <= unit
        assert abs(b) <= abs(x) if k % 2 == 0 else abs(b) >= abs(x)


def test_quantisation_of_special_values(spark):
    df = spark.createDataFrame([(0, 0.0), (1, None), (2, float("nan")), (3, float("inf")), (4, 1.0), (5, 1.0)], "k long, x double")
    for name in ("bitround", "granular_bitround", "bitgroom", "digitround"):
        got = [r[0] for r in df.orderBy("k").select(codecs.quantised(F.col("x"), name, 3, position=F.col("k"))).collect()]
        assert got[0] == 0 and got[1] is None and np.isnan(got[2])
    assert codecs.LIMITS["float"] == (7, 23)
    with pytest.raises(ValueError, match="position"):
        codecs.quantised(F.lit(1.0), "bitgroom", 3)
    with pytest.raises(ValueError, match="unknown"):
        codecs.quantised(F.lit(1.0), "none", 3)


def test_bounds_and_rings_end_to_end(spark):
    def field(rows, units):
        df = spark.createDataFrame(rows, "x long, bounds array<double>, ring array<int>")
        return Field(cells(spark, [1.0] * len(rows), "x", units), (Construct("x", "domain_axis", size=len(rows)), Construct("d", "auxiliary_coordinate", ("x",), data=cells(spark, [1.0] * len(rows), "x", units), bounds=df)))

    out = combine.concatenate_fields([field([(0, [1.0, 2.0], [0])], "m"), field([(0, [1.0, 2.0, 3.0], [0, 1]), (1, [4.0], [0])], "km")], "x")
    got = [(r["bounds"], r["ring"]) for r in out.constructs[1].bounds.orderBy("x").collect()]
    assert got == [([1, 2, None], [0, None]), ([1000, 2000, 3000], [0, 1]), ([4000, None, None], [0, None])]
    bare = Field(out.data, (out.constructs[0], Construct("d", "auxiliary_coordinate", ("x",), data=out.constructs[1].data)))
    assert combine.concatenate_fields([out, bare], "x").constructs[1].bounds is None


def test_two_levels_with_gaps(spark):
    """An empty profile between others stays, one at the end and an instance without any go."""
    v = np.ma.masked_all((3, 3, 2), float)
    v[0, 0, 0], v[0, 2, 1], v[2, 1, 0] = 1, 2, 3
    rows = [(*map(int, k), None if v.mask[k] else float(v[k])) for k in np.ndindex(v.shape)]
    c = Cells(spark.createDataFrame(rows, "c long, p long, e long, value double"), ("c", "p", "e"), v.shape)
    samples, profiles = ragged.compress_indexed_contiguous(c, "p", "e")
    assert sorted(map(tuple, profiles.collect())) == [(0, 0, 1), (1, 0, 0), (2, 0, 2), (3, 2, 0), (4, 2, 1)]
    assert sorted(map(tuple, samples.collect())) == [(0, 1.0), (1, None), (2, 2.0), (3, 3.0)]


def test_corners_are_shared(spark):
    rows = [(p, q, float(p * 100 + q)) for p in (0, 3, 4, 6) for q in (0, 2, 5)]
    out = tiepoints.bounds_2d(spark.createDataFrame(rows, "p long, q long, value double"), "p", "q")
    got = {(r["i"], r["j"]): r["bounds"] for r in out.collect()}
    assert set(got) == {(i, j) for i in range(7) for j in range(6)}
    for (i, j), b in got.items():
        if (i, j + 1) in got:
            assert np.allclose([b[1], b[2]], [got[i, j + 1][0], got[i, j + 1][3]])
        if (i + 1, j) in got and i != 3:  # a new continuous area begins at 4
            assert np.allclose([b[3], b[2]], [got[i + 1, j][0], got[i + 1, j][1]])
