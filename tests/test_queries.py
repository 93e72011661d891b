"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridspark.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    if isinstance(x, dict):
        return str(sorted((str(k), cell(v)) for k, v in x.items()))
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, DATA)
    got = table(df.columns, df.collect())
    assert name in plans.SQL
    q = db.execute(plans.SQL[name])
    assert got == table([d[0] for d in q.description], q.fetchall())


def test_no_cross_product_in_plans(spark):
    for name in ("assign_broadcast", "ragged_contiguous", "subspace_list", "edges_from_faces"):
        plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan
