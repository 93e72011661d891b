"""Queries that take the whole table, whatever its size: against their SQL on one of 701 vectors, and by their number of rows."""

import duckdb
import pytest

from gridspark.operators import ordering
from gridspark.plans import queries as plans

from .test_queries import table

VECTORS = 701
#: Rows out for each vector.
STORAGE = {"netcdf_fragments": 64, "zarr_chunks": 64, "zarr_shards": 64, "zarr_version2": 64, "container_roundtrip": 64, "container_append": 128}
#: None where missing cells at the end of a vector go.
ENCODINGS = {"ragged_compress": None, "ragged_compress_indexed": None, "ragged_contiguous": None, "ragged_roundtrip": 64, "aggregated_fragments": None, "fragments_pruned": None}
ARRAYS = {"assign_scalar": 64, "assign_mask": 64, "assign_broadcast": 64, "reshape_3d": 64, "pad_missing": 69, "concat_axis": 64, "concat_units": 64}
WHOLE = {**STORAGE, **ENCODINGS, **ARRAYS}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where(f"vec_id < {VECTORS}").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_vectors(spark, data, name, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 100)  # prefix sums go over several blocks
    df = plans.QUERIES[name](spark, data)
    got = table(df.columns, df.collect())
    assert WHOLE[name] is None or len(got[1]) == WHOLE[name] * VECTORS
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet/*.parquet'")
    q = db.execute(plans.SQL[name])
    assert got == table([d[0] for d in q.description], q.fetchall())
