"""Whitening of embeddings by singular values of their centred rows: blockwise QR, bidiagonalisation, qd iterations, twisted factorisations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

EPS = np.finfo(float).eps
#: Residuals of vectors up to this part of the squared value are small: gaps are a thousandth at least.
FINE = 1e-12


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V with r = U B V', by Householder reflections from the left and the right in turn."""
    r = r.astype(float).copy()
    d = r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0)
        if len(x) < 2 or not size or not np.abs(x[1:]).max():
            return None
        u = x / size
        u[0] += np.copysign(np.sqrt(u @ u), u[0])
        return u / np.sqrt(u @ u)

    for k in range(d):
        if (u := reflector(r[k:, k])) is not None:
            r[k:, k:] -= 2 * np.outer(u, u @ r[k:, k:])
        if k + 1 < d and (u := reflector(r[k, k + 1 :])) is not None:
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One differential qd step with a shift; None where the shift lies above the least eigenvalue."""
    n = len(q)
    to_q, to_e = np.empty(n), np.empty(n - 1)
    d = least = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        to_q[i] = d + e[i]
        t = q[i + 1] / to_q[i] if to_q[i] else np.inf
        if not np.isfinite(t):
            return None
        to_e[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    to_q[n - 1] = d
    return (to_q, to_e, least) if d >= 0 else None


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Singular values of the bidiagonal matrix (a, b), falling, each to high relative accuracy, by dqds.

    The arrays hold squares and no step subtracts but the shift. Shifts are tried from the bold to the safe one, the
    reciprocal of the trace of the inverse, which is never above the least eigenvalue. A negligible last entry
    is split off with the shifts so far; one in the middle parts the problem in two."""
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if not scale:
        return np.zeros(len(a))
    found: list[float] = []
    work = [((a / scale) ** 2, (b / scale) ** 2, 0.0)]
    while work:
        q, e, done = work.pop()
        least = None
        while len(q):
            if len(q) == 1:
                found.append(done + q[0])
                break
            small = e <= (10 * EPS) ** 2 * (done + np.minimum(q[:-1], q[1:]))
            if (q[:-1] == 0).any() and not small.any():
                # A zero on the diagonal: one step without a shift moves it to the end.
                k = int(np.flatnonzero(q[:-1] == 0)[0])
                q, e = _chased(q, e, k)
                continue
            if small[-1]:
                found.append(done + q[-1])
                q, e, least = q[:-1], e[:-1], None
                continue
            if small.any():
                k = int(np.flatnonzero(small)[-1])
                work.append((q[: k + 1], e[:k], done))
                q, e, least = q[k + 1 :], e[k + 1 :], None
                continue
            safe = 0.0
            if q.min() > 0:
                row = 1 / q[-1]
                total = row
                for i in range(len(q) - 2, -1, -1):
                    row = (1 + e[i] * row) / q[i]
                    total += row
                safe = max(0.0, (1 - 4 * len(q) * EPS) / total) if np.isfinite(total) else 0.0
            for shift in [safe, 0.0] if least is None else [0.99 * least, 0.75 * least, safe, 0.0]:
                step = _dqds(q, e, shift)
                if step:
                    q, e, least = step
                    done += shift
                    break
            else:
                raise ArithmeticError("qd step without a shift failed")
    return scale * np.sqrt(np.sort(np.maximum(found, 0))[::-1])


def _chased(q: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same singular values with entry k of e zero, where entry k of q is: rotations from the left carry it along row k to the end."""
    a, b = np.sqrt(q), np.sqrt(e)
    f, b[k] = b[k], 0.0
    for j in range(k + 1, len(a)):
        h = np.hypot(a[j], f)
        c, s = (a[j] / h, f / h) if h else (1.0, 0.0)
        a[j] = h
        if j < len(b):
            f, b[j] = -s * b[j], c * b[j]
    return a**2, b**2


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> Iterator[tuple[np.ndarray, float]]:
    """Unit right singular vectors of the bidiagonal (a, b) for a singular value, and their residuals, by twisted factorisations of B'B - value^2.

    A stationary transform from the top and a progressive one from the bottom meet at one entry; from there one
    multiplication an entry gives the vector up and down. The first has the least pivot where they meet and is the
    best. All are columns of the inverse, so for a value that others are close to they span the space of all of these,
    as far as their residuals are small: a column with a large one holds vectors of other values too."""
    n, lam = len(a), value * value
    q, e = a * a, b * b
    tiny = np.finfo(float).tiny / EPS
    tri = q.copy()
    tri[1:] += e
    off = a[:-1] * b
    top, low = np.empty(n), np.empty(n)  # pivots of L D L' and U D U'
    down, up = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    s, p = np.empty(n), np.empty(n)
    s[0] = -lam
    for i in range(n - 1):  # stationary: D+_i = q_i + s_i
        top[i] = q[i] + s[i]
        if abs(top[i]) < tiny:
            top[i] = -tiny
        down[i] = off[i] / top[i]
        s[i + 1] = e[i] * s[i] / top[i] - lam
    top[n - 1] = q[n - 1] + s[n - 1]
    p[n - 1] = q[n - 1] - lam
    for i in range(n - 2, -1, -1):  # progressive: D-_{i+1} = e_i + p_{i+1}
        low[i + 1] = e[i] + p[i + 1]
        if abs(low[i + 1]) < tiny:
            low[i + 1] = -tiny
        up[i] = off[i] / low[i + 1]
        p[i] = p[i + 1] * q[i] / low[i + 1] - lam
    low[0] = p[0]
    gamma = s + p + lam
    for r in np.argsort(np.abs(gamma), kind="stable"):
        z = np.zeros(n)
        z[r] = 1
        for i in range(r - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -up[i] * z[i]
        if np.isfinite(z).all():
            z /= np.abs(z).max()
            z /= np.sqrt(z @ z)
            yield z, abs(gamma[r] * z[r])


def directions(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal (a, b) as columns, by falling value.

    The bidiagonal falls apart at zeros of b, and each part gives its own vectors. Values of a part that are closer than a
    thousandth share a subspace, in which twisted vectors are made orthogonal and then turned to fit B. Where none is left
    that way whose residual is small (parts joined by little more than rounding), what they lack is all that is orthogonal to the
    vectors found; B tells the values in it apart."""
    n = len(a)
    z = np.zeros((n, n))
    top = values[0] if n else 0
    cut = np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]) + np.abs(a[1:]), top)) + 1
    parts = [np.arange(x, y) for x, y in zip(np.append(0, cut), np.append(cut, n))]
    if len(parts) > 1:
        own = [(v, k, i) for k, p in enumerate(parts) for i, v in enumerate(singular_values(a[p], b[p[:-1]]))]
        for at, (_, k, i) in enumerate(sorted(own, key=lambda x: -x[0])):
            p = parts[k]
            if i == 0:
                part = directions(a[p], b[p[:-1]], singular_values(a[p], b[p[:-1]])) if len(p) > 1 else np.ones((1, 1))
                parts[k] = (p, part)
            p, part = parts[k]
            z[p, at] = part[:, i]
        return z
    full = np.diag(a) + np.diag(b, 1)
    start, groups, lacking = 0, [], []
    while start < n:
        stop = start + 1
        while stop < n and values[stop - 1] - values[stop] < 1e-3 * values[stop - 1]:
            stop += 1
        for k in range(start, stop):
            least = np.inf
            for x, residual in twisted(a, b, values[k]):
                for _ in range(2):
                    x = x - z[:, start:k] @ (z[:, start:k].T @ x)
                size = np.sqrt(x @ x)
                residual = (residual + n * EPS * values[k] ** 2) / size if size else np.inf  # of what is left, rounding included
                if residual < least or not z[:, k].any():
                    least, z[:, k] = residual, x / (size or 1)
                if size > 0.1 and least <= FINE * values[k] ** 2:
                    break
            if stop - start > 1 and not least <= FINE * values[k] ** 2:
                z[:, k] = 0
                lacking.append(k)
        groups.append(np.arange(start, stop))
        start = stop
    if lacking:
        rest = np.linalg.qr(np.delete(z, lacking, 1), "complete")[0][:, n - len(lacking) :]
        z[:, lacking] = rest @ np.linalg.svd(full @ rest)[2].T
    for group in groups:
        if len(group) > 1:
            w = full @ z[:, group]
            _, turn = np.linalg.eigh(w.T @ w)
            z[:, group] = z[:, group] @ turn[:, ::-1]
    return z
    return z


def merged(df: DataFrame, key: str, merge: Callable[[list[dict]], dict], fan: int = 16) -> dict | None:
    """One row a task merged by `merge`, `fan` at a time, in rounds until one is left; that row. `key` is the number of the task."""
    df = stored(df, "tasks")
    n = df.agg(F.coalesce(F.max(key) + 1, F.lit(0))).first()[0]
    while n > 1:
        n = -(-n // fan)

        def one(t: pa.Table) -> pa.Table:
            rows = sorted(t.to_pylist(), key=lambda r: r[key])
            return pa.Table.from_pylist([merge(rows) | {key: rows[0][key] // fan}], schema=t.schema)

        before, df = df, stored(df.groupBy(F.floor(F.col(key) / fan).alias("group")).applyInArrow(one, df.schema), "merged")
        forget(before)
    row = df.first()
    forget(df)
    return row.asDict() if row else None


def whole(vectors: DataFrame, column: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x array<long>): floor(scale * c) + offset of each entry c, as double; rows that are null, empty, or hold null, non-finite or entries of which x would be 2^60 and more, are left out."""
    # Entries that do not count are null already here, as Spark may work out x before it filters.
    y = F.transform(F.transform(column, lambda c: c.cast("double") * scale), lambda c: F.when(F.abs(c) < 2.0**60, F.floor(c)))
    fine = (F.size(column) > 0) & F.forall(y, lambda c: c.isNotNull())
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(y, lambda c: c + offset).alias("x"))


def _rows(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy().reshape(b.num_rows, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n in doubles, from whole numbers: n times it is exact where it fits."""
    mean, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], float)
    return (x - mean).astype(float) - rest / n


def whiten(vectors: DataFrame, components: int = 32, block: int = 8192) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: every vector (vec_id, x array<long>) on the leading principal components, scaled to variance 1.

    Rows are centred as whole numbers. Each task reduces blocks of `block` of its centred rows to one triangle by QR,
    triangles are merged in rounds of a fixed fan-in, and the last, as wide as a vector, is bidiagonalised on the driver;
    dqds gives its singular values and twisted factorisations the directions. A second pass measures the covariance of
    what was whitened, a third returns it.

    Vectors of another width than most rows have (of equally frequent widths the largest) take no part. Components
    without variance, to double precision, are no directions and get no rows: equal vectors give no rows at all.
    deviation is null where it fits no long. Repeated ids and null ids are rows like others. Without vectors there are no
    rows. Signs are such that each direction's largest entry is positive."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    widths = vectors.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if not widths:
        return vectors.sparkSession.createDataFrame([], schema)
    width, n = widths["width"], widths["count"]
    vectors = vectors.where(F.size("x") == width)
    # Sums fit a decimal however many rows there are.
    summed = vectors.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted((r["i"], r["s"]) for r in summed)]

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        held, size = [r], 0
        for b in batches:
            held.append(_centred(_rows(b, width), n, sums))
            size += b.num_rows
            if size >= block:
                held, size = [np.linalg.qr(np.concatenate(held), "r")], 0
        r = np.linalg.qr(np.concatenate(held), "r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "r": [r.ravel()]}, pa.schema([("task", pa.int64()), ("r", pa.list_(pa.float64()))]))

    def joined(rows: list[dict]) -> dict:
        return {"r": np.linalg.qr(np.concatenate([np.reshape(r["r"], (-1, width)) for r in rows]), "r").ravel().tolist()}

    r = np.reshape(merged(vectors.mapInArrow(triangle, "task long, r array<double>"), "task", joined)["r"], (-1, width))
    a, b, v = bidiagonal(np.concatenate([r, np.zeros((width - len(r), width))]))
    values = singular_values(a, b)
    rank = int((values > 8 * width * EPS * values[0]).sum()) if values[0] > 0 else 0
    rank = min(rank, n - 1)
    take = min(components, rank)
    if not take:
        return vectors.sparkSession.createDataFrame([], schema)
    z = (v @ directions(a, b, values))[:, :take]
    z = z * np.sign(z[np.abs(z).argmax(0), np.arange(take)])
    variance = values**2 / n
    to, explained = z / np.sqrt(variance[:take]), variance[:take] / variance.sum()

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows, total, g = 0, np.zeros(take), np.zeros((take, take))
        for b in batches:
            y = _centred(_rows(b, width), n, sums) @ to
            rows, total, g = _joined_gram((rows, total, g), (len(y), y.sum(0), (y - y.mean(0)).T @ (y - y.mean(0)))) if len(y) else (rows, total, g)
        if rows:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "rows": [rows], "total": [total], "g": [g.ravel()]}, pa.schema([("task", pa.int64()), ("rows", pa.int64()), ("total", pa.list_(pa.float64())), ("g", pa.list_(pa.float64()))]))

    def joined_gram(rows: list[dict]) -> dict:
        out = (0, np.zeros(take), np.zeros((take, take)))
        for x in rows:
            out = _joined_gram(out, (x["rows"], np.array(x["total"]), np.reshape(x["g"], (take, take))))
        return {"rows": out[0], "total": out[1].tolist(), "g": out[2].ravel().tolist()}

    g = merged(vectors.mapInArrow(gram, "task long, rows long, total array<double>, g array<double>"), "task", joined_gram)
    error = float(np.abs(np.reshape(g["g"], (take, take)) / n - np.eye(take)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b, width)
            y = _centred(x, n, sums) @ to
            near = np.array([float(s) for s in sums]) / n
            if np.abs(x - near).max(initial=0) * n < 2.0**62 and ((x - near) ** 2).sum(1).max(initial=0) * float(n) ** 2 < 2.0**62 and np.abs(x).max(initial=0) * float(n) < 2.0**62:
                apart = n * x - np.array(sums, np.int64)
                deviation = pa.array((apart * apart).sum(1), pa.int64())
            else:
                exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            again = np.repeat(np.arange(b.num_rows), take)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, take + 1), b.num_rows), pa.int32()), pa.array(np.full(len(again), n), pa.int64()), deviation.take(pa.array(again))]
                + [pa.array(y.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(len(again), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, schema)


def _joined_gram(one: tuple, two: tuple) -> tuple:
    """Rows, sums and centred products of two sets of rows together."""
    if not one[0]:
        return two
    apart = two[1] / two[0] - one[1] / one[0]
    rows = one[0] + two[0]
    return rows, one[1] + two[1], one[2] + two[2] + np.outer(apart, apart) * (one[0] * two[0] / rows)
