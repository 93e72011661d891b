"""Fields written to classic files and put together again."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import io
from gridspark.functions import attrs, references, time
from gridspark.model import Cells, Construct, Domain, Field
from gridspark.operators import masking, matching
from gridspark.plans import conformance, report
from gridspark.plans import queries as plans
from gridspark.sources import dataset, netcdf3, zarr3


def cells(spark, rows, axes, shape, kind="double", **more):
    return Cells(spark.createDataFrame(rows, ", ".join([*(f"{a} long" for a in axes), f"value {kind}"])), axes, shape, **more)


def made(spark):
    data = cells(spark, [(i, j, None if (i, j) == (1, 1) else 10 * i + j) for i in range(3) for j in range(2)], ("y", "x"), (3, 2), "int", units="K", fill=-1)
    edges = spark.createDataFrame([(i, [i - 0.5, i + 0.5] if i < 2 else [1.5, 2.0, 2.5]) for i in range(3)], "y long, bounds array<double>")
    return Field(
        data,
        (
            Construct("y", "domain_axis", size=3, ncdim="lat"),
            Construct("x", "domain_axis", size=2, ncdim="lon"),
            Construct("d0", "dimension_coordinate", ("y",), {"standard_name": "latitude"}, data=cells(spark, [(i, float(i)) for i in range(3)], ("y",), (3,), units="degrees_north"), bounds=edges),
            Construct("a0", "auxiliary_coordinate", ("x",), {"long_name": "name"}, ncvar="name", data=cells(spark, [(0, "é1"), (1, "longer")], ("x",), (2,), "string")),
            Construct("m0", "cell_measure", ("y", "x"), {}, ncvar="area", measure="area", data=cells(spark, [(i, j, i + j + 0.5) for i in range(3) for j in range(2)], ("y", "x"), (3, 2), units="m")),
            Construct("f0", "field_ancillary", ("y",), {"long_name": "flag"}, ncvar="flag", data=cells(spark, [(i, i) for i in range(3)], ("y",), (3,), "tinyint")),
            Construct("c0", "cell_method", ("y",), method="mean"),
        ),
        {"standard_name": "air_temperature", "valid_max": 15},
    )


def values(c):
    return sorted(map(tuple, c.df.select(*c.axes, c.value).collect()))


@pytest.mark.parametrize("external", [False, True])
def test_roundtrip(spark, tmp_path, external):
    f, path, other = made(spark), f"file://{tmp_path}/a.nc", f"file://{tmp_path}/b.nc" if external else None
    assert dataset.write([f], path, other)["air_temperature"] == 2  # 20 and 21 are beyond valid_max
    (got,) = dataset.read(spark, [path], [other] if external else None)
    assert got.data.axes == ("lat", "lon") and got.data.units == "K" and got.properties["standard_name"] == "air_temperature"
    assert values(got.data) == [(i, j, None if (i, j) == (1, 1) or i == 2 else 10 * i + j) for i in range(3) for j in range(2)]
    by = {c.ncvar or c.key: c for c in got.constructs}
    assert by["lat"].type == "domain_axis" or by["lat"].type == "dimension_coordinate"
    lat = next(c for c in got.constructs if c.type == "dimension_coordinate")
    assert values(lat.data) == [(0, 0.0), (1, 1.0), (2, 2.0)] and lat.identity() == "latitude" and lat.data.units == "degrees_north"
    assert sorted(map(tuple, lat.bounds.select("lat", F.to_json(F.struct("bounds"))).collect()))[2] == (2, '{"bounds":[1.5,2.0,2.5]}')
    assert [json.loads(r[0])["bounds"] for r in lat.bounds.orderBy("lat").select(F.to_json(F.struct("bounds"), {"ignoreNullFields": "false"})).collect()][0] == [-0.5, 0.5, None]
    assert by["name"].type == "auxiliary_coordinate" and values(by["name"].data) == [(0, "é1"), (1, "longer")]
    assert by["area"].measure == "area" and by["area"].type == "cell_measure" and values(by["area"].data)[5] == (2, 1, 3.5)
    assert by["flag"].type == "field_ancillary" and values(by["flag"].data) == [(0, 0), (1, 1), (2, 2)]
    assert by["cellmethod0"].method == "mean" and by["cellmethod0"].axes == ("lat",)
    if external:
        (alone,) = dataset.read(spark, [path])
        assert not any(c.type == "cell_measure" for c in alone.constructs)


def test_extra_fields_and_shared_parts(spark, tmp_path):
    f = made(spark)
    g = Field(f.data, f.constructs[:4], {"standard_name": "air_temperature"})
    path = f"file://{tmp_path}/a.nc"
    dataset.write([f, g], path)
    h = netcdf3.read_header(f"{tmp_path}/a.nc")
    assert set(h.variables) == {"lat", "lat_bounds", "name", "area", "flag", "air_temperature", "air_temperature_1"}
    assert len(dataset.read(spark, [path])) == 2
    assert [x.properties.get("long_name") or x.properties.get("standard_name") for x in dataset.read(spark, [path], extra=("ancillary_variables",))] == ["air_temperature", "air_temperature", "flag"]


def test_references(spark):
    """What each role finds, and what it does not."""
    rows = [
        ("a", "t", "float", ["z", "x"], {"coordinates": "lat  lost", "cell_measures": "area: out volume: gone", "ancillary_variables": "q", "grid_mapping": "crs: x lat"}, {"external_variables": "out elsewhere"}),
        ("a", "z", "double", ["z"], {"bounds": "zb", "formula_terms": "a: ta b: tb orog: o"}, {}),
        ("a", "zb", "double", ["z", "two"], {}, {}),
        ("a", "x", "double", ["x", "n"], {}, {}),  # not a coordinate variable
        ("a", "lat", "double", ["x"], {}, {}),
        ("a", "q", "float", ["other"], {}, {}),  # does not apply to t
        ("a", "ta", "double", ["z"], {}, {}),
        ("a", "o", "double", ["y"], {}, {}),
        ("a", "crs", "int", [], {}, {}),
        ("b", "t", "float", ["z"], {"coordinates": "lat"}, {}),
    ]
    schema = "dataset string, variable string, type string, dimensions array<string>, attributes map<string,string>, globals map<string,string>"
    variables = spark.createDataFrame(rows, schema)
    external = spark.createDataFrame([("e", "out", "double", ["x"], {}, {}), ("e", "elsewhere", "double", ["x"], {}, {}), ("f", "elsewhere", "double", ["x"], {}, {})], schema)
    refs = dataset.references(variables, external)
    got = {(r["dataset"], r["variable"], r["role"], r["term"], r["target"]): (r["state"], r["found_in"]) for r in refs.collect()}
    assert got == {
        ("a", "t", "dimension", None, "z"): ("found", "a"), ("a", "z", "dimension", None, "z"): ("found", "a"), ("a", "zb", "dimension", None, "z"): ("found", "a"), ("a", "ta", "dimension", None, "z"): ("found", "a"),
        ("a", "t", "coordinates", None, "lat"): ("found", "a"), ("a", "t", "coordinates", None, "lost"): ("missing", None), ("a", "t", "cell_measures", "area", "out"): ("external", "e"),
        ("a", "t", "cell_measures", "volume", "gone"): ("missing", None), ("a", "t", "ancillary_variables", None, "q"): ("found", "a"), ("a", "t", "grid_mapping", None, "crs"): ("found", "a"),
        ("a", "z", "bounds", None, "zb"): ("found", "a"), ("a", "z", "formula_terms", "a", "ta"): ("found", "a"), ("a", "z", "formula_terms", "b", "tb"): ("missing", None), ("a", "z", "formula_terms", "orog", "o"): ("found", "a"),
        ("b", "t", "coordinates", None, "lat"): ("missing", None),
    }
    fields = dataset.data_variables(variables, refs)
    assert sorted(map(tuple, fields.select("dataset", "variable").collect())) == [("a", "t"), ("a", "x"), ("b", "t")]
    found = dataset.constructs(variables, refs, fields).where("field = 't'").collect()
    assert {(r["kind"], r["term"], r["variable"], r["found_in"], r["bounds"]) for r in found} == {
        ("dimension_coordinate", None, "z", "a", "zb"), ("auxiliary_coordinate", None, "lat", "a", None), ("cell_measure", "area", "out", "e", None),
        ("coordinate_reference", None, "crs", "a", None), ("domain_ancillary", "a", "ta", "a", None),
    }


def test_coordinate_references(spark, tmp_path):
    """Grid mappings with their coordinates, and formulas with their terms, there and back."""
    f = made(spark)
    name = lambda c, **k: Construct(c.key, c.type, c.axes, {**c.properties, **k}, c.ncvar, data=c.data, bounds=c.bounds)
    lon = Construct("a1", "auxiliary_coordinate", ("x",), {"standard_name": "longitude"}, ncvar="longitude", data=cells(spark, [(0, 1.0), (1, 2.0)], ("x",), (2,)))
    height = Construct("z0", "auxiliary_coordinate", ("x",), {"standard_name": "atmosphere_hybrid_height_coordinate", "computed_standard_name": "altitude"}, ncvar="level", data=cells(spark, [(0, 1.0), (1, 2.0)], ("x",), (2,)))
    orog = Construct("t0", "domain_ancillary", ("y",), {"long_name": "surface"}, ncvar="orog", data=cells(spark, [(i, i + 0.5) for i in range(3)], ("y",), (3,)))
    crs = Construct("r0", "coordinate_reference", (), {"grid_mapping_name": "latitude_longitude", "earth_radius": 6371000.0}, ncvar="crs", coordinates=("d0", "a1"))
    formula = Construct("r1", "coordinate_reference", (), {"standard_name": "atmosphere_hybrid_height_coordinate"}, coordinates=("z0",), terms={"orog": "t0"})
    field = Field(f.data, (*f.constructs[:3], name(lon), height, orog, crs, formula), {"standard_name": "air_temperature"})
    path = f"file://{tmp_path}/a.nc"
    dataset.write([field, field], path)
    assert set(netcdf3.read_header(f"{tmp_path}/a.nc").variables) == {"lat", "lat_bounds", "longitude", "level", "orog", "crs", "air_temperature", "air_temperature_1"}
    for got in dataset.read(spark, [path]):
        by = {c.key: c for c in got.constructs}
        mapping, own = by["reference_crs"], by["formula_level"]
        assert {by[k].ncvar for k in mapping.coordinates} == {"lat", "longitude"} and mapping.properties["earth_radius"] == "6371000.0"
        assert own.terms == {"orog": "orog"} and own.coordinates == ("level",) and own.properties["computed_standard_name"] == "altitude"
        assert by["orog"].type == "domain_ancillary" and values(by["orog"].data)[2] == (2, 2.5)
        assert "grid_mapping_name:latitude_longitude" in mapping.identities()
    # A mapping that lists nothing goes with coordinates of the standard names for it.
    x, y, c = (("x",), np.zeros(2), {"standard_name": "longitude"}), (("y",), np.zeros(3), {"standard_name": "grid_latitude"}), ((), np.array(0, "i4"), {"grid_mapping_name": "rotated_latitude_longitude"})
    netcdf3.write_file(f"{tmp_path}/b.nc", {"y": 3, "x": 2}, {"y": y, "lon": x, "crs": c, "t": (("y", "x"), np.zeros((3, 2)), {"coordinates": "lon", "grid_mapping": "crs"})})
    (got,) = dataset.read(spark, [f"{tmp_path}/b.nc"])
    assert set(next(c for c in got.constructs if c.type == "coordinate_reference").coordinates) == {"axis_y", "lon"}
    assert references.parted({"earth_radius": 1, "grid_mapping_name": "x"}) == ({"earth_radius": 1}, {"grid_mapping_name": "x"})
    # References count where fields are compared.
    assert matching.matched(field, field) and not matching.matched(field, Field(field.data, (*field.constructs[:-2], formula)))
    other = Construct("r1", "coordinate_reference", (), {"standard_name": "atmosphere_hybrid_height_coordinate"}, coordinates=("z0",), terms={"b": "t0"})
    assert not matching.matched(field, Field(field.data, (*field.constructs[:-1], other)))


@pytest.mark.parametrize("kind", ["contiguous", "indexed", "indexed_contiguous"])
def test_samples_end_to_end(spark, tmp_path, kind):
    """Instances without samples, gaps inside, and arrays that are missing at different places."""
    deep = kind == "indexed_contiguous"
    axes, shape = (("s", "p", "e"), (3, 2, 3)) if deep else (("s", "e"), (4, 3))
    x = np.ma.masked_all(shape, float)
    y = np.ma.masked_all(shape, float)
    if deep:
        x[0, 1, 0], y[0, 1, 1], x[2, 0, 2] = 1, 2, 3
    else:
        x[0, 0], y[0, 2], x[2, 1], y[3, 0] = 1, 2, 3, 4
    array = lambda v: cells(spark, [(*map(int, k), None if v.mask[k] else float(v[k])) for k in np.ndindex(shape)], axes, shape)
    name = Construct("n", "auxiliary_coordinate", ("s",), {"long_name": "station"}, ncvar="station", data=cells(spark, [(k, k * 10) for k in range(shape[0])], ("s",), (shape[0],), "int"))
    f = Field(array(x), (Construct("y", "auxiliary_coordinate", axes, {"long_name": "y"}, ncvar="y", data=array(y)), name), {"long_name": "x"})
    path = f"file://{tmp_path}/a.nc"
    dataset.write([f], path, compress=kind)
    (got,) = dataset.read(spark, [path])
    assert got.data.axes == (("s", "p_row_place", "element") if deep else ("s", "element"))
    want = {(0, 1, 0): (1, None), (0, 1, 1): (None, 2), (2, 0, 0): (None, None), (2, 0, 1): (None, None), (2, 0, 2): (3, None)} if deep else {(0, 0): (1, None), (0, 1): (None, None), (0, 2): (None, 2), (2, 0): (None, None), (2, 1): (3, None), (3, 0): (None, 4)}
    other = got.construct("long_name=y").data
    assert {k[:-1]: k[-1] for k in values(got.data)} == {k: v[0] for k, v in want.items()} and {k[:-1]: k[-1] for k in values(other)} == {k: v[1] for k, v in want.items()}
    assert values(got.construct("long_name=station").data) == [(k, k * 10) for k in range(shape[0])]
    assert got.data.shape == ((3, 2, 3) if deep else (4, 3))
    with pytest.raises(ValueError, match="does not fit"):
        dataset.write([Field(cells(spark, [(0, 1.0)], ("q",), (1,)))], path, compress=kind)


def test_gathered_variables(spark, tmp_path):
    x = np.array([5.0, 6.0, 7.0])
    netcdf3.write_file(f"{tmp_path}/a.nc", {"y": 2, "x": 3, "land": 3}, {"land": (("land",), np.array([1, 3, 5], "i4"), {"compress": "y x"}), "t": (("land",), x, {"coordinates": "lat"}), "lat": (("y",), np.array([10.0, 20.0]), {})})
    (got,) = dataset.read(spark, [f"{tmp_path}/a.nc"])
    assert got.data.axes == ("y", "x") and got.data.shape == (2, 3)
    assert values(got.data) == [(0, 1, 5.0), (1, 0, 6.0), (1, 2, 7.0)] and values(got.construct("ncvar%lat").data) == [(0, 10.0), (1, 20.0)]


def test_meshes(spark, tmp_path):
    """Two fields of one mesh and one of another: shared topology, ids ranked, coordinates from nodes, connectivity, edges."""
    nodes = [[10, 20, 50, 40], [20, 30, 60, 50], [50, 60, 70]]
    xy = {10: (0.0, 0.0), 20: (1.0, 0.0), 30: (2.0, 0.0), 40: (0.0, 1.0), 50: (1.0, 1.0), 60: (2.0, 1.0), 70: (1.5, 2.0)}
    table = lambda rows, kind: spark.createDataFrame(rows, f"c long, value {kind}")
    on = lambda rows, kind: Cells(table(list(enumerate(rows)), kind), ("c",), (len(rows),))
    edges = lambda d: spark.createDataFrame([(k, [xy[i][d] for i in f]) for k, f in enumerate(nodes)], "c long, bounds array<double>")
    named = lambda name, **k: Construct(name, "auxiliary_coordinate", ("c",), {"standard_name": name}, ncvar=name, **k)
    faces = Field(on([1.0, 2.0, 3.0], "double"), (Construct("t", "domain_topology", ("c",), cell="face", data=on(nodes, "array<long>")), named("longitude", bounds=edges(0), data=on([0.5, 1.5, 1.5], "double")), named("latitude", bounds=edges(1))), {"long_name": "faces"})
    order = [40, 10, 20, 30, 70, 60, 50]
    near = {10: [20, 40], 20: [10, 30, 50], 30: [20, 60], 40: [10, 50], 50: [20, 40, 60, 70], 60: [30, 50, 70], 70: [50, 60]}
    points = Field(on([float(i) for i in order], "double"), (Construct("t", "domain_topology", ("c",), cell="point", data=on([[i, *near[i]] for i in order], "array<long>")), named("longitude", data=on([xy[i][0] for i in order], "double")), named("latitude", data=on([xy[i][1] for i in order], "double"))), {"long_name": "points"})
    alone = Field(on([9.0, 8.0], "double"), (Construct("t", "domain_topology", ("c",), cell="edge", data=on([[1, 2], [2, 3]], "array<long>")),), {"long_name": "edges"})
    path = f"file://{tmp_path}/a.nc"
    dataset.write([points, alone, faces], path)
    h = netcdf3.read_header(f"{tmp_path}/a.nc")
    assert sum(v.attributes.get("cf_role") == "mesh_topology" for v in h.variables.values()) == 2 and sum("face_node_connectivity" == v.attributes.get("cf_role") for v in h.variables.values()) == 1
    got = {f.properties["long_name"]: f for f in dataset.read(spark, [path])}
    f = got["faces"]
    assert [r["value"] for r in f.construct("cell:face").data.df.orderBy(f.data.axes[0]).collect()] == [[0, 1, 4, 3], [1, 2, 5, 4], [4, 5, 6]]
    assert [r["bounds"][:3] for r in f.construct("longitude").bounds.orderBy(f.data.axes[0]).collect()] == [[0, 1, 1], [1, 2, 2], [1, 2, 1.5]]
    assert values(f.construct("longitude").data) == [(0, 0.5), (1, 1.5), (2, 1.5)] and f.construct("latitude").data is None
    p = got["points"]
    assert values(p.data) == [(k, float(i)) for k, i in enumerate(sorted(order))] and values(p.construct("latitude").data) == [(k, xy[i][1]) for k, i in enumerate(sorted(order))]
    ranks = {i: k for k, i in enumerate(sorted(order))}
    assert {r["value"][0]: sorted(r["value"][1:]) for r in p.construct("cell:point").data.df.collect()} == {ranks[i]: sorted(ranks[j] for j in near[i]) for i in order}
    e = got["edges"]
    assert [r["value"] for r in e.construct("cell:edge").data.df.orderBy(e.data.axes[0]).collect()] == [[0, 1], [1, 2]]


def test_aggregation_variables(spark, tmp_path):
    """Data in fragments beside the file, constants, and a fragment that is missing."""
    f = made(spark)
    path = f"file://{tmp_path}/a.nc"
    data = Cells(f.data.df.where("y <> 1"), f.data.axes, f.data.shape, units="K", fill=-1)
    dataset.write([Field(data, f.constructs[:4], {"standard_name": "air_temperature"})], path, aggregate=1)
    assert sorted(p.name for p in (tmp_path / "a.nc.fragments").iterdir()) == ["air_temperature-000000.nc", "air_temperature-000002.nc"]
    (got,) = dataset.read(spark, [path])
    assert values(got.data) == [(0, 0, 0), (0, 1, 1), (1, 0, None), (1, 1, None), (2, 0, 20), (2, 1, 21)] and got.data.units == "K" and got.data.shape == (3, 2)
    assert got.construct("latitude").bounds is not None and got.data.df.schema["value"].dataType.simpleString() == "int"
    assert got.data.df.where("lat = 2").count() == 2
    names = {"m": (("j", "f"), np.array([[2, 3], [4, -1]], "i4"), {"_FillValue": np.int32(-1)}), "u": (("g", "o"), np.array([[7.5], [-9.0]]), {"_FillValue": np.float64(-9.0)})}
    netcdf3.write_file(f"{tmp_path}/b.nc", {"y": 5, "x": 4, "j": 2, "f": 2, "g": 2, "o": 1}, {**names, "t": ((), np.array(0.0), {"aggregated_dimensions": "y x", "aggregated_data": "map: m unique_values: u"})})
    (got,) = dataset.read(spark, [f"{tmp_path}/b.nc"])
    assert [r[2] for r in values(got.data)] == [7.5] * 8 + [None] * 12


def test_domains(spark, tmp_path):
    f = made(spark)
    d = f.domain
    assert not {c.type for c in d.constructs} & {"cell_method", "field_ancillary"} and d.sizes == {"y": 3, "x": 2}
    path = f"file://{tmp_path}/a.nc"
    dataset.write([f, d], path)
    (got,) = dataset.read(spark, [path], domain=True)
    assert got.sizes == {"lat": 3, "lon": 2} and sorted(c.type for c in got.constructs) == ["auxiliary_coordinate", "cell_measure", "dimension_coordinate", "domain_axis", "domain_axis"]
    assert len(dataset.read(spark, [path])) == 1
    assert Domain.of([c for c in d.constructs if c.type != "domain_axis"]).sizes == {"y": 3, "x": 2}
    with pytest.raises(ValueError, match="cells along"):
        Domain.of([Construct("x", "domain_axis", size=9), *d.constructs[3:]])
    with pytest.raises(ValueError, match="a domain has no"):
        Domain.of(f.constructs)
    within = Construct("c", "cell_method", ("t",), {"within": "years"}, method="mean")
    assert Field(f.data, (within, *f.constructs)).climatological_axes() == {"t"}


def test_reading_of_all_formats(spark, tmp_path):
    f = made(spark)
    io.write([f], f"file://{tmp_path}/a.nc", external=f"file://{tmp_path}/measures.nc")
    io.write([f], f"file://{tmp_path}/c", "container")
    io.write([Field(f.data)], f"file://{tmp_path}/z", "zarr", chunks=(2, 2), data_type="int32")
    got = io.read(spark, str(tmp_path / "a.nc"), str(tmp_path / "[cz]"), external=[f"file://{tmp_path}/measures.nc"])
    assert [len(g.constructs) for g in got] == [7, 7, 2] and all(g.data.shape == (3, 2) for g in got)
    assert len(io.read(spark, str(tmp_path / "a.nc"), names=("air_temperature",))) == 1 and io.read(spark, str(tmp_path / "a.nc"), names=("none",)) == []
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n")
    with pytest.raises(ValueError, match="netcdf4"):
        io.read(spark, str(tmp_path / "x.nc"))
    with pytest.raises(ValueError, match="no format"):
        io.write([f], "x", "other")


def test_reference_times_of_dates(spark):
    df = spark.createDataFrame([(1, None), (2, "2000-12-03T12:00"), (3, "2000-12-05")], "k int, t string")
    out, units = time.to_reftime(df, "t", ["k"])
    assert units == "days since 2000-12-03" and [r["t"] for r in out.orderBy("k").collect()] == [None, 0.5, 2.0]
    out, units = time.to_reftime(df.where("k > 1"), "t", ["k"], "hours since 2000-12-03")
    assert [r["t"] for r in out.orderBy("k").collect()] == [12.0, 48.0]
    assert time.to_reftime(df.where("k = 1"), "t", ["k"])[1] == "days since 1970-01-01"


def test_command_line(spark, tmp_path, capsys):
    from gridspark.__main__ import main

    dataset.write([made(spark)], f"file://{tmp_path}/a.nc")
    assert main([]) == 2 and main(["-s", str(tmp_path / "a.nc")]) == 0
    assert "<Field: air_temperature(lat(3), lon(2)) K>" in capsys.readouterr().out
    assert main([str(tmp_path / "a.nc")]) == 0
    out = capsys.readouterr().out
    assert "auxiliary_coordinate long_name=name" in out and "lat: mean" in out


def test_zarr_groups_and_references(spark, tmp_path):
    """A group of arrays, and chunks that lie in other files, become fields like classic files do."""
    import base64
    import json as js

    f = made(spark)
    group = tmp_path / "g"
    zarr3.write(Cells(f.data.df, ("y", "x"), (3, 2), units="K"), f"file://{group}/t", (2, 2), "int32")
    zarr3.write(cells(spark, [(i, i * 1.5) for i in range(3)], ("y",), (3,)), f"file://{group}/y", (2,))
    zarr3.write(cells(spark, [(i, j, i + j * 1.0) for i in range(3) for j in range(2)], ("y", "v"), (3, 2)), f"file://{group}/edges", (2, 1))
    (group / "zarr.json").write_text(js.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"title": "a group"}}))
    meta = js.loads((group / "y" / "zarr.json").read_text())
    (group / "y" / "zarr.json").write_text(js.dumps({**meta, "attributes": {"bounds": "edges", "standard_name": "latitude"}}))
    (got,) = io.read(spark, str(group))
    assert values(got.data) == values(f.data) and got.properties["title"] == "a group" and got.data.units == "K"
    lat = got.construct("latitude")
    assert values(lat.data) == [(0, 0.0), (1, 1.5), (2, 3.0)] and {r["y"]: r["bounds"] for r in lat.bounds.collect()} == {0: [0, 1], 1: [1, 2], 2: [2, 3]}
    # The bytes of a classic file, named chunk by chunk; one chunk stands in the references themselves, one is missing.
    netcdf3.write_file(f"{tmp_path}/a.nc", {"n": 4}, {"v": (("n",), np.arange(4, dtype="f8"), {})})
    begin = netcdf3.read_header(f"{tmp_path}/a.nc").variables["v"].begin
    array = js.dumps({"zarr_format": 2, "shape": [7], "chunks": [2], "dtype": ">f8", "compressor": None, "filters": None, "order": "C", "fill_value": -1.0})
    refs = {".zattrs": '{"title": "refs"}', "v/.zarray": array, "v/.zattrs": '{"_ARRAY_DIMENSIONS": ["n"], "long_name": "v"}', "v/0": ["a.nc", begin, 16], "v/1": [str(tmp_path / "a.nc"), begin + 16, 16], "v/2": "base64:" + base64.b64encode(np.array([9.0, 8.0], ">f8").tobytes()).decode()}
    (tmp_path / "k.json").write_text(js.dumps({"version": 1, "refs": refs}))
    (got,) = io.read(spark, str(tmp_path / "k.json"))
    assert values(got.data) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 9.0), (5, 8.0), (6, None)] and got.properties["title"] == "refs"


@pytest.mark.parametrize("alone", [False, True])
def test_unlimited_axes(spark, tmp_path, alone):
    """Records of several variables are interleaved, those of one are not padded; more can come."""

    def part(at, n):
        data = cells(spark, [(i, j, at + i + j * 0.5) for i in range(n) for j in range(3)], ("t", "x"), (n, 3))
        more = (
            Construct("d", "dimension_coordinate", ("t",), {"long_name": "time"}, data=cells(spark, [(i, at + i) for i in range(n)], ("t",), (n,), "int"), bounds=spark.createDataFrame([(i, [at + i + 0.0, at + i + 1.0]) for i in range(n)], "t long, bounds array<double>")),
            Construct("s", "auxiliary_coordinate", ("t",), {"long_name": "flag"}, ncvar="flag", data=cells(spark, [(i, (at + i) % 100) for i in range(n)], ("t",), (n,), "tinyint")),
        )
        x = Construct("x0", "dimension_coordinate", ("x",), data=cells(spark, [(j, j * 1.0) for j in range(3)], ("x",), (3,)))
        bytes_ = cells(spark, [(i, j, (at + i + j) % 100) for i in range(n) for j in range(3)], ("t", "x"), (n, 3), "tinyint")
        return Field(bytes_ if alone else data, () if alone else (*more, x), {"long_name": "values"})

    path = f"file://{tmp_path}/a.nc"
    dataset.write([part(0, 4)], path, unlimited="t")
    h = netcdf3.read_header(f"{tmp_path}/a.nc")
    assert h.records == 4 and dict(h.dimensions)["t"] == 0 and (not alone or h.record_size == 3)
    assert dataset.append(part(4, 2), path, "t") == 6
    (got,) = dataset.read(spark, [path])
    assert got.data.shape == (6, 3) and values(got.data) == values(part(0, 6).data)
    if not alone:
        t = got.construct("long_name=time")
        assert values(t.data) == [(i, i) for i in range(6)] and {r["t"]: r["bounds"] for r in t.bounds.collect()} == {i: [i, i + 1] for i in range(6)}
        assert values(got.construct("long_name=flag").data) == [(i, i) for i in range(6)] and got.data.df.where("t = 5").count() == 3
        with pytest.raises(ValueError, match="no more of"):
            dataset.append(Field(part(6, 1).data, (), {"long_name": "values"}), path, "t")
    other = f"file://{tmp_path}/b.nc"
    dataset.write([part(0, 4)], other)
    with pytest.raises(ValueError, match="does not go on"):
        dataset.append(part(4, 2), other, "t")


def test_scalar_coordinates(spark, tmp_path):
    f = made(spark)
    z = Construct("z", "dimension_coordinate", ("h",), {"standard_name": "height"}, ncvar="height", data=cells(spark, [(0, 2.0)], ("h",), (1,), units="m"), bounds=spark.createDataFrame([(0, [1.0, 3.0])], "h long, bounds array<double>"))
    path = f"file://{tmp_path}/a.nc"
    dataset.write([Field(f.data, (*f.constructs[:3], Construct("h", "domain_axis", size=1), z), {"standard_name": "air_temperature"})], path)
    h = netcdf3.read_header(f"{tmp_path}/a.nc")
    assert h.variables["height"].dimensions == [] and "height" in h.variables["air_temperature"].attributes["coordinates"]
    (got,) = dataset.read(spark, [path])
    height = got.construct("height")
    assert height.type == "dimension_coordinate" and height.axes == ("height",) and values(height.data) == [(0, 2.0)] and height.bounds.first()["bounds"] == [1, 3]
    assert got.data.axes == ("lat", "lon") and next(c for c in got.constructs if c.key == "height").size == 1


def test_small_parts(spark):
    f = made(spark)
    x = masking.apply_masking_field(Field(f.data, (f.constructs[2], Construct("v", "auxiliary_coordinate", ("x",), {"valid_range": (0, 1), "missing_value": 0.5}, data=cells(spark, [(0, 0.5), (1, 3.0)], ("x",), (2,)))), {"valid_min": 1, "valid_max": 11}))
    assert [r[2] for r in values(x.data)] == [None, 1, 10, None, None, None] and values(x.constructs[1].data) == [(0, None), (1, None)]
    assert attrs.sorted_method({"axes": ["y", "a"], "method": "mean", "intervals": [(1.0, "m"), (2.0, "s")]}) == {"axes": ["a", "y"], "method": "mean", "intervals": [(2.0, "s"), (1.0, "m")]}
    assert report.deterministic_name(f.data) == report.deterministic_name(f.data) != report.deterministic_name(f.constructs[2].data)


def test_variables_are_never_broadcast(spark):
    """Estimates of exploded tables are too small, whatever the size of the catalogue."""
    for name in ("conformance_datasets", "dataset_references"):
        df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        text = df._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in text.splitlines() if "BroadcastHashJoin" in x]
        assert len(joins) == (0 if name == "conformance_datasets" else 1), joins  # external variables, two small tables


def test_report_of_meshes_named_oddly(spark):
    schema = "dataset string, variable string, type string, dimensions array<string>, attributes map<string,string>, globals map<string,string>"
    rows = [
        ("a", "m", "int", [], {"cf_role": "mesh_topology", "node_coordinates": "x", "face_node_connectivity": "f"}, {}),
        ("a", "x", "double", ["n"], {}, {}),
        ("a", "f", "int", ["k", "three"], {}, {}),
        ("a", "good", "double", ["k"], {"mesh": "m", "location": "face"}, {}),
        ("a", "none", "double", ["k"], {"mesh": " ", "location": "face"}, {}),
        ("a", "bare", "double", ["k"], {"mesh": "m"}, {}),
        ("a", "list", "int", ["k", "n"], {"compress": "n lost"}, {}),
    ]
    variables = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in conformance.datasets(variables, dataset.references(variables)).collect()}
    assert got == {("a", "none", "mesh", " is no mesh"), ("a", "bare", "mesh", "no location given"), ("a", "list", "compress", "no dimension lost"), ("a", "list", "compress", "a list has one dimension")}


def test_samples_are_placed_once_for_all_variables(spark, tmp_path, monkeypatch):
    """Counts of what is stored, and places of what is read, are written once, however many variables lie on the samples."""
    from gridspark.sources import compression

    seen = []
    monkeypatch.setattr(compression, "written", lambda df, what, own=compression.written: (seen.append(what), own(df, what))[1])
    for kind, axes in (("contiguous", ("i", "e")), ("indexed", ("i", "e")), ("indexed_contiguous", ("i", "p", "e"))):
        rows = [(*([0, 2, 3][k % 3], k % 2, k // 3)[:: 1 if len(axes) == 3 else 2], None if k == 4 else float(k)) for k in range(12)]
        data = cells(spark, rows, axes, (4, 2, 4)[:: 1 if len(axes) == 3 else 2][: len(axes)] if len(axes) == 3 else (4, 4))
        more = tuple(Construct(k, "auxiliary_coordinate", axes, {"long_name": k}, ncvar=k, data=data) for k in ("one", "two"))
        seen.clear()
        dataset.write([Field(data, more, {"long_name": "x"})], str(tmp_path / f"{kind}.nc"), compress=kind)
        (f,) = dataset.read(spark, [str(tmp_path / f"{kind}.nc")])
        assert seen.count("places") == 1 and seen.count("last") == 1
        got = {tuple(r) for r in f.data.df.where("value is not null").collect()}
        assert got == {r for r in rows if r[-1] is not None}
        assert {tuple(r) for r in f.construct("long_name=two").data.df.where("value is not null").collect()} == got
