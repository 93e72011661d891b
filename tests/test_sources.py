"""Array formats and aggregation datasets: what is read, and what is not opened."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.model import Cells
from gridspark.operators import fragments
from gridspark.sources import aggregation, netcdf3, zarr3

from .test_arrays import GONE, X, back, made, same


def as_masked(x, gone):
    return np.ma.array(x, mask=gone)


def test_only_wanted_fragments_are_opened(spark, tmp_path):
    """Files that filters rule out may be gone."""
    c = Cells(spark.range(400).selectExpr("id div 4 as i", "id % 4 as j", "cast(id as double) as value"), ("i", "j"), (100, 4))
    entries = netcdf3.write_fragments(c, f"file://{tmp_path}/f", rows=10)
    assert len(entries) == 10
    for k in (0, 1, 2, 6, 7, 8, 9):
        os.remove(f"{tmp_path}/f/value-{k:06d}.nc")
    whole = aggregation.read(spark, entries, c.axes, c.shape).df
    got = whole.where("i >= 35 and i < 55 and j = 2")
    assert sorted(map(tuple, got.collect())) == [(i, 2, i * 4.0 + 2) for i in range(35, 55)]
    assert [r[0] for r in whole.where("i in (31, 44) and j > 2 and i is not null").select("value").orderBy("value").collect()] == [127.0, 179.0]
    assert whole.where("i > 59 and i < 50").count() == 0
    with pytest.raises(Exception, match="No such file"):
        whole.where("i > 50").count()


def test_ten_thousand_fragments(spark):
    """Many small fragments are few partitions, and are planned in seconds."""
    entries = fragments.manifest([[3] * 10000], unique_values=list(range(10000)))
    began = time.perf_counter()
    c = aggregation.read(spark, entries, ("i",), (30000,), cells=6000)
    assert c.df.agg(F.sum("value")).first()[0] == 3 * sum(range(10000))
    assert time.perf_counter() - began < 30
    assert c.df.select(F.spark_partition_id()).distinct().count() == 5
    assert c.df.where("i >= 29990").agg(F.count("*"), F.min("value")).first() == (10, 9996)


def test_fragments_of_several_kinds(spark, tmp_path):
    x = np.arange(12, dtype="i4").reshape(3, 4)
    netcdf3.write_file(f"{tmp_path}/a.nc", {"p": 4}, {"v": (("p",), x[0] * 0.001, {"units": "km", "_FillValue": np.float64(0.002)})})
    zarr3.write(made(spark, x[1:2], np.zeros((1, 4), bool)), f"file://{tmp_path}/z", (1, 3), "int16")
    (tmp_path / "m.json").write_text("")
    entries = [
        {"start": [0, 0], "stop": [1, 4], "uri": f"{tmp_path}/a.nc", "identifier": "v"},
        {"start": [1, 0], "stop": [2, 4], "uri": f"{tmp_path}/z", "units": "m"},
        {"start": [2, 0], "stop": [3, 2], "value": None},
        {"start": [2, 2], "stop": [3, 4], "value": 7},
    ]
    import json

    (tmp_path / "m.json").write_text(json.dumps(entries))
    for given in (entries, f"file://{tmp_path}/m.json"):
        got = back(aggregation.read(spark, given, ("y", "x"), (3, 4), "m"))
        assert np.ma.allclose(got, as_masked([[0, 1, 2, 3], [4, 5, 6, 7], [0, 0, 7, 7]], [[0, 0, 1, 0], [0] * 4, [1, 1, 0, 0]]))
        assert (got.mask == [[0, 0, 1, 0], [0] * 4, [1, 1, 0, 0]]).all()
    wrong = [{**entries[0], "stop": [1, 3]}]
    with pytest.raises(Exception, match="has the shape"):
        aggregation.read(spark, wrong, ("y", "x"), (1, 3)).df.count()
    assert aggregation.read(spark, [], ("y",), (0,)).df.count() == 0


@pytest.mark.parametrize(("shards", "version"), [(None, 3), ((2, 4, 6), 3), ((4, 4, 6), 3), (None, 2)])
@pytest.mark.parametrize("data_type", ["int64", "float32"])
def test_zarr(spark, tmp_path, shards, version, data_type):
    big = X + (2**53 if data_type == "int64" else 0)
    gone = GONE | (np.arange(60).reshape(X.shape) < 20)  # whole chunks are missing
    path = f"file://{tmp_path}/z"
    zarr3.write(made(spark, big, gone), path, (2, 2, 3), data_type, shards=shards, version=version)
    c = zarr3.read(spark, path)
    assert c.df.count() == 60 and c.axes == ("a", "b", "c")
    got = {tuple(r)[:3]: r[3] for r in c.df.collect()}
    assert all(got[k] == (None if gone[k] else big[k]) for k in np.ndindex(X.shape))
    assert sorted(map(tuple, c.df.where("a = 2 and c > 3").select("b", "value").collect())) == sorted((b, got[2, b, 4]) for b in range(4))


def test_shards_hold_only_what_is_there(spark, tmp_path):
    """The layout of a shard: chunks end to end, then offset and size of each, then a checksum; a wrong one is told."""
    x = np.arange(16).reshape(4, 4)
    path = f"{tmp_path}/z"
    zarr3.write(made(spark, x, x < 8), f"file://{path}", (2, 2), "int32", shards=(4, 4))
    raw = open(f"{path}/c/0/0", "rb").read()
    index = np.frombuffer(raw[-68:-4], "<u8").reshape(2, 2, 2)
    assert (index[0] == zarr3.ABSENT).all() and index[1, 0, 0] == 0 and index[1, 1, 0] == index[1, 0, 1] and len(raw) == index[1, 1].sum() + 68
    assert zarr3.crc32c(b"123456789") == 0xE3069283
    with open(f"{path}/c/0/0", "r+b") as f:
        f.seek(-1, 2)
        f.write(bytes([raw[-1] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        zarr3.read(spark, f"file://{path}").df.count()
    with pytest.raises(ValueError, match="multiples"):
        zarr3.write(made(spark, x), f"file://{tmp_path}/y", (3, 2), shards=(4, 4))


def test_classic_files_in_parallel(spark, tmp_path):
    """Tasks write stretches at their places; types stay, also whole numbers beyond 2^53, and the job that writes sees what is out of range."""
    path = f"file://{tmp_path}/a.nc"
    big = made(spark, X + 2**60, GONE)
    small = made(spark, X % 5)
    small = small.select(small.v.cast("tinyint"))
    dims = {"a": 3, "b": 4, "c": 5}
    h = netcdf3.create(path, dims, {"big": (("a", "b", "c"), "i8", {"units": "1"}), "small": (("a", "b", "c"), "i1", {}), "one": ((), "f8", {})}, {"title": "t"})
    assert h.version == 5
    assert netcdf3.put(big, path, h, "big", rows=2) == 0
    assert netcdf3.put(small, path, h, "small", rows=1, limits=(1, 3)) == int(((X % 5 < 1) | (X % 5 > 3)).sum())
    netcdf3.put(Cells(spark.range(1).selectExpr("2.5D as value"), (), ()), path, h, "one")
    got = {tuple(r)[:3]: r[3] for r in netcdf3.read(spark, path, "big").df.collect()}
    assert all(got[k] == (None if GONE[k] else X[k] + 2**60) for k in np.ndindex(X.shape))
    c = netcdf3.read(spark, path, "small", cells="7")
    assert c.df.schema["value"].dataType.simpleString() == "tinyint"
    same(back(c), np.ma.array(X % 5))
    assert netcdf3.read(spark, path, "one").df.first()[0] == 2.5
    assert c.df.where("a = 1 and c < 2").count() == 8


def test_missing_stretches_hold_fill_values(spark, tmp_path):
    path = f"file://{tmp_path}/a.nc"
    h = netcdf3.create(path, {"x": 6}, {"v": (("x",), "i4", {"_FillValue": np.int32(-9)})})
    netcdf3.put(Cells(spark.createDataFrame([(4, 1)], "x long, value int"), ("x",), (6,)), path, h, "v", rows=2)
    assert [r[0] for r in netcdf3.read(spark, path, "v", mask="false").df.orderBy("x").select("value").collect()] == [-9, -9, -9, -9, 1, -9]
