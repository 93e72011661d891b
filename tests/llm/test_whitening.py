"""Whitening against numpy, and the steps of its solver on hard matrices."""

import numpy as np
import pytest

from gridspark.llm.whitening import bidiagonal, directions, singular_values, whiten, whole

SCHEMA = "vec_id long, embedding array<float>, component int, whitened string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 5, "own") for i, v in rows], SCHEMA).repartition(parts)


def solved(m):
    a, b, v = bidiagonal(m)
    s = singular_values(a, b)
    return s, v @ directions(a, b, s)


HARD = {
    "random": lambda r, d: r.normal(size=(d, d)),
    "graded": lambda r, d: r.normal(size=(d, d)) * 10.0 ** -np.arange(d)[None],
    "equal": lambda r, d: np.eye(d) * 3,
    "two clusters": lambda r, d: np.linalg.qr(r.normal(size=(d, d)))[0] @ np.diag([5.0] * (d // 2) + [1.0] * (d - d // 2)) @ np.linalg.qr(r.normal(size=(d, d)))[0],
    "close": lambda r, d: np.linalg.qr(r.normal(size=(d, d)))[0] @ np.diag(1 + 1e-9 * np.arange(d)) @ np.linalg.qr(r.normal(size=(d, d)))[0],
    "low rank": lambda r, d: r.normal(size=(d, max(1, d // 3))) @ r.normal(size=(max(1, d // 3), d)),
    "zero columns": lambda r, d: r.normal(size=(d, d)) * (np.arange(d) % 3 > 0),
    "nothing": lambda r, d: np.zeros((d, d)),
}


@pytest.mark.parametrize("kind", sorted(HARD))
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_solver(kind, d):
    m = np.linalg.qr(HARD[kind](np.random.default_rng(d), d), "r")
    s, v = solved(m)
    want = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(s, want, rtol=1e-10, atol=1e-13 * max(want[0], 1e-300))
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-9
    # The directions diagonalise m'm: m v has orthogonal columns as long as the singular values.
    w = m @ v
    assert np.abs(w.T @ w - np.diag(s**2)).max() <= 1e-11 * max(want[0] ** 2, 1e-300)


@pytest.mark.parametrize("levels", [[5.0, 1.0], [7.0, 2.0, 0.01], [1.0, 1e-1, 1e-2, 1e-3, 1e-4, 1e-5]])
def test_clusters_whatever_the_rounding(levels):
    """Parts joined by little more than rounding; of 40 such matrices some lacked vectors on any machine."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        turns = [np.linalg.qr(rng.normal(size=(40, 40)))[0] for _ in range(2)]
        m = np.linalg.qr(turns[0] @ np.diag(rng.choice(levels, 40)) @ turns[1], "r")
        s, v = solved(m)
        w = m @ v
        assert np.abs(v.T @ v - np.eye(40)).max() < 1e-9
        assert np.abs(w.T @ w - np.diag(s**2)).max() <= 1e-11 * s[0] ** 2


def test_small_values_are_accurate():
    """A bidiagonal matrix fixes its least singular value to full relative accuracy."""
    a, b = np.array([1.0, 1e-6, 1e-12, 1e-18]), np.array([0.5, 1e-7, 1e-13])
    product = np.prod(singular_values(a, b))
    assert abs(product / np.prod(a) - 1) < 1e-12


@pytest.mark.parametrize("parts", [1, 40])
def test_whiten(spark, parts):
    rng = np.random.default_rng(1)
    e = (rng.normal(size=(300, 6)) * [3, 1, 0.5, 2, 0.7, 0.2] + 4).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(e.tolist())] + [(900, None), (901, [1, None, 3, 4, 5, 6]), (902, [float("nan")] * 6), (903, [float("inf")] + [0] * 5), (904, []), (905, [1, 2]), (1, e[1].tolist()), (None, e[2].tolist())]
    out = whiten(whole(frame(spark, rows, parts)), components=4, block=7).toPandas()
    x = np.floor(64 * np.append(e, e[1:3], 0).astype(float)) + 1000000
    n = len(x)
    assert len(out) == 4 * n and set(out["n"]) == {n} and out["identity_error"].max() < 1e-9 and out["identity_error"].nunique() == 1
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    y = (c @ vectors / np.sqrt(values))[:, ::-1]
    one = out[out["vec_id"] == 17].sort_values("component")
    assert np.allclose(np.abs(one["whitened"]), np.abs(y[17, :4]), rtol=1e-9)
    assert np.allclose(one["explained"], values[::-1][:4] / values.sum(), rtol=1e-9)
    assert set(one["deviation"]) == {int(((n * x[17].astype(int) - x.astype(int).sum(0)) ** 2).sum())}
    assert out["vec_id"].isna().sum() == 4 and (out["vec_id"] == 1).sum() == 8


def test_degenerate(spark):
    w = lambda rows, **k: whiten(whole(frame(spark, rows)), **k)
    assert w([]).count() == 0 and w([(1, None)]).count() == 0 and w([(1, [1, 2])]).count() == 0 and w([(1, [1, 2]), (2, [1, 2])]).count() == 0
    assert w([]).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = w([(i, [i, 5, -i]) for i in range(9)]).collect()  # one direction
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    huge = w([(i, [i * 1e15, 0]) for i in range(4)]).collect()  # deviations beyond a long
    assert {r["deviation"] for r in huge} == {None} and max(r["identity_error"] for r in huge) < 1e-9
    assert w([(i, [i % 2, i % 3]) for i in range(6)] + [(6, [1]), (7, [1])]).count() == 12  # the width most rows have
