"""Cells are numbered without one task that holds them all."""

from gridspark.operators import mesh, ordering


def test_connectivity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 16)
    links = spark.createDataFrame([(7 * k, [7 * k + 7, 7 * k - 7, 3, None]) for k in range(100)], "cell long, neighbours array<long>").repartition(5)
    out = mesh.normalised_connectivity(links, "cell", "neighbours", 1)
    assert {r[0]: r[1] for r in out.collect()} == {k + 1: [x + 1 for x in (k - 1, k + 1) if 0 <= x < 100] for k in range(100)}
    assert "dense_rank" not in out._jdf.queryExecution().analyzed().toString()


def test_normalised_by_given_ranks(spark):
    """Ranks that are known are not made again, and NULL padding stays."""
    cells = spark.createDataFrame([(0, [30, None, 10]), (1, []), (2, [20])], "cell int, nodes array<long>")
    ranks = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "id long, node long")
    out = mesh.normalised(cells, "cell", "nodes", 1, ranks=ranks)
    assert {r[0]: r[1] for r in out.collect()} == {0: [3, None, 1], 1: [], 2: [2]}
    assert "Window" not in out._jdf.queryExecution().analyzed().toString()


def test_corners_are_rounded_in_generated_code(spark):
    from gridspark.plans import queries

    plan = queries.QUERIES["tie_bounds_2d"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "lambda" not in plan


def test_lists_go_on_over_batches(spark):
    """Rows of a key come in several batches, some keys fill them, and values may be missing."""
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, p, None if p % 3 == 0 else p // 2) for k in range(20) for p in range(k)]
        df = spark.createDataFrame(rows[::-1], "k long, p int, v long").repartition(3)
        got = {r["k"]: r["v"] for r in ordering.lists(df, "k", ["p"], ["v"]).collect()}
        assert got == {k: [v for j, _, v in rows if j == k] for k in range(1, 20)}
        got = ordering.lists(df.where("v is not null"), "k", ["v"], ["v"], distinct=True).collect()
        assert len(got) == 18 and {r["k"]: r["v"] for r in got} == {k: sorted({v for j, _, v in rows if j == k and v is not None}) for k in range(2, 20)}
        words = spark.createDataFrame([("b", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, p int, v string")
        assert {r["k"]: r["v"] for r in ordering.lists(words, "k", ["p"], ["v"]).collect()} == {"a": ["y"], "b": [None, "x"]}
        assert ordering.lists(df.where("k < 0"), "k", ["p"], ["v"]).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_neighbours_meet_in_one_shuffle(spark):
    faces = spark.createDataFrame([([1, 2, None, 3],), ([3, 2, 4],), ([5],), ([6, 6, 7],), ([],)], "nodes array<long>")
    out = mesh.points_from_faces(faces)
    assert {r["node"]: r["neighbours"] for r in out.collect()} == {1: [2, 3], 2: [1, 3, 4], 3: [1, 2, 4], 4: [2, 3], 6: [7], 7: [6]}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert mesh.points_from_faces(faces)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fingerprints_of_odd_rows(spark):
    """Faces without nodes, with one and with repeats; edges and points of one node; NULL in place of a list."""
    rows = [("a", "face", [1, 2, 3]), ("a", "face", []), ("b", "face", [3, 1, 2]), ("b", "face", None), ("c", "face", [1, 2, 3]), ("d", "edge", [2, 1]), ("d", "edge", [3, 2]), ("d", "edge", [1, 3]), ("e", "edge", [4]), ("f", "point", [5]), ("g", "point", [1, 2, 3, None]), ("g", "point", [2, 3])]
    out = mesh.linked(spark.createDataFrame(rows, "domain string, kind string, nodes array<long>"))
    assert {r["domain"]: r["mesh"] for r in out.collect()} == {"a": "a", "b": "a", "c": "c", "d": "a", "e": "e", "f": "f", "g": "a"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_bounds_of_all_coordinates_from_one_join(spark, tmp_path):
    """Bounds by both coordinates of the nodes are one table in storage, whatever variables are on the faces."""
    import numpy as np

    from gridspark.sources import dataset, netcdf3

    mesh_of = {"cf_role": "mesh_topology", "topology_dimension": np.int32(2), "node_coordinates": "x y", "face_node_connectivity": "corners"}
    on = {"mesh": "m", "location": "face"}
    arrays = {"m": ((), np.array(0, "i4"), mesh_of), "corners": (("f", "c"), np.array([[0, 1, 2, 3], [1, 2, 4, -1]], "i4"), {"_FillValue": np.int32(-1), "start_index": np.int32(0)}), "x": (("n",), np.arange(5.0), {"standard_name": "longitude"}), "y": (("n",), np.arange(5.0) * 10, {"standard_name": "latitude"})}
    netcdf3.write_file(f"{tmp_path}/a.nc", {"f": 2, "c": 4, "n": 5}, {**arrays, "t": (("f",), np.array([1.0, 2.0]), on), "u": (("f",), np.array([3.0, 4.0]), on)})
    edges = [f.construct(k).bounds for f in dataset.read(spark, [f"{tmp_path}/a.nc"]) for k in ("longitude", "latitude")]
    assert [sorted((r["f"], r["bounds"]) for r in b.collect()) for b in edges] == 2 * [[(0, [0, 1, 2, 3]), (1, [1, 2, 4])], [(0, [0, 10, 20, 30]), (1, [10, 20, 40])]]
    files = {tuple(sorted(b.inputFiles())) for b in edges}
    assert len(files) == 1 and files != {()} and all(x.endswith(".parquet") for x in files.pop())
