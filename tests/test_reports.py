import json

import pytest

from gridspark.model import Cells, Construct, Field
from gridspark.plans import report
from gridspark.sources import container, discover, netcdf3


def made(spark):
    d = Cells(spark.range(6).selectExpr("id as i", "id * 2 as value"), ("i",), (6,), units="K")
    return Field(d, (Construct("i", "domain_axis", size=6, ncdim="x"), Construct("cellmethod0", "cell_method", ("i",), method="mean")), {"standard_name": "air_temperature"})


def test_texts(spark):
    f = made(spark)
    assert report.one_line(f) == "<Field: air_temperature(i(6)) K>"
    text = report.dump(f)
    assert "axis x(6)" in text and "i: mean" in text and "[0, ..., 10]" in text
    with report.configured(display_data=False):
        assert "..." not in report.dump(f)
    scope = {"df": f.data.df}
    exec(report.creation_commands(f), scope)
    assert scope["field"] == f
    assert report.environment(spark)["spark"] == spark.version


def test_discovery(spark, tmp_path):
    netcdf3.write_file(str(tmp_path / "a.nc"), {"x": 1}, {})
    (tmp_path / "b.cdl").write_text("netcdf b {\n}\n")
    (tmp_path / "k.json").write_text(json.dumps({"refs": {}}))
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "zarr.json").write_text("{}")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    netcdf3.write_file(str(tmp_path / "deep" / "er" / "c.nc"), {"x": 1}, {})
    container.save(made(spark), f"file://{tmp_path}/field")
    got = [(p.rsplit("/", 1)[1], k) for p, k in discover.datasets(str(tmp_path))]
    assert got == [("a.nc", "netcdf3"), ("b.cdl", "cdl"), ("field", "container"), ("k.json", "kerchunk"), ("z", "zarr")]
    assert ("c.nc", "netcdf3") in [(p.rsplit("/", 1)[1], k) for p, k in discover.datasets(str(tmp_path), recursive=True, kinds=("netcdf3",))]
    with pytest.raises(FileNotFoundError):
        discover.datasets(str(tmp_path / "*.none"))
