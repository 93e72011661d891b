"""Exact top-k search by inner product: a Voronoi kNN join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component; without vectors that are null or hold null or non-finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(col: pa.Array | pd.Series, width: int) -> np.ndarray:
    return np.array(col.to_pylist() if isinstance(col, pa.Array) else list(col), float).reshape(len(col), width)


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Vectors of the sample far apart from each other: the farthest point first."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(most, len(sample)):
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def voronoi_top_k(data: DataFrame, queries: Column, k: int = 5, pivots: int | None = None, block: int = 4096, samples: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of data (vec_id, v) that `queries` selects, the k other rows of highest inner product, ties to the smaller id.

    Pivots are vectors of a bounded sample, far apart from each other; without `pivots` half the root of the rows,
    64 to 512. Every vector goes to the cell of its nearest pivot. Summaries, a few numbers for each cell, give the
    distance bounds: the radius of a cell of data bounds every score of a query group from above by
    pivot_q . pivot_d + r_q |pivot_d| + r_d |pivot_q| + r_q r_d, and the distances of the k + 1
    vectors nearest to a pivot bound the k-th score of a group from below. A group of queries is copied only to
    the cells of which the upper bound reaches its lower bound. Cells are split in blocks of about `block` rows, and
    the queries that reach a cell in blocks of as many, both by a hash of the id, so a cell that holds a third of all
    rows or queries is no single task. Each pair of blocks is solved with one matrix product per batch and gives k rows a
    query; a window takes the best k of them.

    Vectors are compared with those of their own width. Pivots are chosen for each width the sample has; the cell of any
    other width has the origin as its pivot. Repeated ids count as rows of their own, a query is never its own neighbour by
    id; rows without id take no part. Without data or queries there are no rows."""
    spark = data.sparkSession
    data = data.where("vec_id is not null")
    picked = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(samples).select("v").toPandas()["v"]  # `samples` rows at most
    if not len(picked):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    most = pivots or int(np.clip(data.count() ** 0.5 / 2, 64, 512))
    by_width: dict[int, list] = {}
    for x in picked:
        by_width.setdefault(len(x), []).append(x)
    # Widths share the pivots by their part of the sample.
    own = {w: _pivots(np.array(x, float), max(1, most * len(x) // len(picked))) for w, x in by_width.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("v").value_lengths().to_numpy()
            for width in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == width))
                x, pivot = _matrix(part.column("v"), width), own.get(width, np.zeros((1, width)))
                d = np.sqrt(np.maximum(((x**2).sum(1)[:, None] - 2 * x @ pivot.T + (pivot**2).sum(1)[None]), 0))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), width), pa.int32()), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])], [*part.schema.names, "width", "cell", "d"])

    placed = data.select("vec_id", "v", F.coalesce(queries, F.lit(False)).alias("q")).mapInArrow(assign, "vec_id long, v array<double>, q boolean, width int, cell int, d double")
    placed = stored(placed, "placed")
    # The summaries: one row for each cell, and k + 1 more for its nearest vectors.
    near = placed.withColumn("i", F.row_number().over(Window.partitionBy("width", "cell").orderBy("d"))).where(F.col("i") <= k + 1).groupBy("width", "cell").agg(F.array_sort(F.collect_list("d")).alias("near"))
    cells = placed.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("d").alias("r"), F.max(F.when(F.col("q"), F.col("d"))).alias("rq"), F.count_if("q").alias("asked")).join(near, ["width", "cell"]).collect()
    plan = [row for width in {r["width"] for r in cells} for row in _wanted([r for r in cells if r["width"] == width], own.get(width, np.zeros((1, width))), k, block)]
    # At most as many pairs as cells have, one number for each cell; both are bounded by the pivots and the widths.
    plan = F.broadcast(spark.createDataFrame(plan or [(-1, -1, -1, 1, 1)], "width int, cell int, to int, blocks int, parts int"))
    sizes = F.broadcast(plan.groupBy("width", F.col("to").alias("cell")).agg(F.first("blocks").alias("blocks"), F.first("parts").alias("parts")))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = placed.where("q").join(plan, ["width", "cell"]).select(F.col("width").alias("width"), F.col("to").alias("cell"), every(F.col("blocks")).alias("block"), dealt(F.col("parts"), 1).alias("part"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    there = placed.join(sizes, ["width", "cell"]).select("width", "cell", dealt(F.col("blocks"), 2).alias("block"), every(F.col("parts")).alias("part"), "vec_id", "v")

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            width = int(x["width"].iloc[0])
            x = x.sort_values("vec_id")
            ids, m = x["vec_id"].to_numpy(), _matrix(x["v"], width)
            for at in range(0, len(q), 256):
                own = q["query_id"].to_numpy()[at : at + 256]
                s = _matrix(q["qv"].iloc[at : at + 256], width) @ m.T  # sums of whole numbers below 2**53 are exact
                s[own[:, None] == ids[None]] = -np.inf
                # Stable order by falling score leaves ties with the smaller id first.
                cut = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                for i in range(len(s)):
                    best = np.flatnonzero((s[i] >= cut[i]) & (s[i] > -np.inf))
                    best = best[np.argsort(-s[i][best], kind="stable")[:k]]
                    out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[best], "score": s[i][best].astype("int64")}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})

    keys = ["width", "cell", "block", "part"]
    found = asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _wanted(cells: list, pivot: np.ndarray, k: int, block: int) -> list[tuple[int, int, int, int, int]]:
    """(width, cell of queries, cell of data, its blocks, blocks of the queries that reach it) of the pairs of cells of one width that the bounds allow."""
    norm, dots, slack = np.sqrt((pivot**2).sum(1)), pivot @ pivot.T, 1e-6
    number = np.array([x["cell"] for x in cells])
    radius = np.array([x["r"] for x in cells]) * (1 + slack) + slack
    of = np.repeat(number, [len(x["near"]) for x in cells])
    d = np.array([y for x in cells for y in x["near"]])
    pairs: list[tuple[int, int]] = []
    reached = dict.fromkeys(number.tolist(), 0)
    for q in cells:
        if q["rq"] is None:
            continue
        a, reach = q["cell"], q["rq"] * (1 + slack) + slack
        # Any query of the group with one of the nearest vectors of a cell scores at least this.
        least = np.sort(dots[a, of] - reach * norm[of] - d * norm[a] - reach * d)[::-1]
        least = least[k] if len(least) > k else -np.inf  # one of them can be the query itself
        best = dots[a, number] + reach * norm[number] + radius * norm[a] + reach * radius
        for c in number[best >= least - slack * abs(least)].tolist():
            pairs.append((a, c))
            reached[c] += q["asked"]
    blocks = {x["cell"]: max(1, -(-x["n"] // block)) for x in cells}
    return [(cells[0]["width"], a, c, blocks[c], max(1, -(-reached[c] // block))) for a, c in pairs]
