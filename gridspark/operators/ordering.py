"""Places in a global order without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

BLOCK = 1 << 16


def dense_places(df: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """df with `name`: how many rows have a smaller `key`, a whole number below `size` that no two rows share.

    Rows fall in blocks of the key's range. Each block is ordered by itself; the blocks' counts, one row for
    each, are summed up in the same way and joined back."""
    block = F.expr(f"`{key}` div {BLOCK}")
    df = df.withColumn("_block", block)
    counts = df.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sums_before(counts)
    inside = df.withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(key)) - 1)
    return inside.join(before, "_block").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_block", "_before", "_at")


def sums_before(counts: DataFrame) -> DataFrame:
    """(_block, _before) of (_block, _n), a row a block: the sum of _n over smaller blocks. One task sees a row for each BLOCK blocks, and these rows are broadcast."""
    parted = counts.withColumn("_top", F.expr(f"_block div {BLOCK}"))
    tops = parted.groupBy("_top").agg(F.sum("_n").alias("_m")).select("_top", (F.sum("_m").over(Window.orderBy("_top")) - F.col("_m")).alias("_above"))
    own = F.sum("_n").over(Window.partitionBy("_top").orderBy("_block")) - F.col("_n")
    return parted.withColumn("_own", own).join(F.broadcast(tops), "_top").select("_block", (F.col("_above") + F.col("_own")).alias("_before"))


def running_start(df: DataFrame, key: str, count: str, name: str = "start") -> DataFrame:
    """df with the sum of `count` over all rows of smaller `key` (an exclusive prefix sum), in levels like dense_places()."""
    df = df.withColumn("_block", F.expr(f"`{key}` div {BLOCK}"))
    totals = df.groupBy("_block").agg(F.sum(count).alias("_n"))
    before = sums_before(totals)
    own = F.sum(count).over(Window.partitionBy("_block").orderBy(key)) - F.col(count)
    return df.withColumn("_own", own).join(before, "_block").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_block", "_before", "_own")


def lists(df: DataFrame, key: str, order: list[str], columns: list[str], distinct: bool = False) -> DataFrame:
    """(key, and of each column the list of its values): the rows of a key, which is never NULL, in the order given. With `distinct`, rows equal to the one before count once.

    Rows are shuffled and sorted once, by the key alone; tasks then order and cut what streams by, and hold the key that goes on and no buffer for others."""
    by = [(x, "ascending") for x in (key, *order)]

    def differs(t: pa.Table, names: list[str]) -> np.ndarray:
        """Of each row, whether it differs from the one before; the first does."""
        out = np.zeros(t.num_rows, bool)
        out[:1] = True
        for x in names:
            c = t.column(x)
            a, b = c.slice(0, len(c) - 1), c.slice(1)
            unlike = pa.compute.fill_null(pa.compute.not_equal(a, b), False)
            out[1:] |= pa.compute.or_(unlike, pa.compute.xor(pa.compute.is_null(a), pa.compute.is_null(b))).to_numpy()
        return out

    def cut(t: pa.Table) -> pa.RecordBatch:
        t = t.take(pa.compute.sort_indices(t, sort_keys=by, null_placement="at_start"))
        if distinct:
            t = t.filter(pa.array(differs(t, [key, *columns])))
        starts = np.flatnonzero(differs(t, [key]))
        ends = pa.array(np.append(starts, t.num_rows), pa.int32())
        values = [pa.ListArray.from_arrays(ends, pa.concat_arrays(t.column(c).chunks)) for c in columns]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(t.column(key).take(pa.array(starts)).chunks), *values], [key, *columns])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the key that goes on
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            same = not held or held[-1].column(key)[-1] == t.column(key)[0]
            if same and t.column(key)[0] == t.column(key)[-1]:  # as it is sorted, of one key
                held.append(t)
                continue
            t = pa.concat_tables([*held, t])
            last = int(np.flatnonzero(differs(t, [key]))[-1])
            if last:
                yield cut(t.slice(0, last))
            held = [t.slice(last)]
        if held:
            yield cut(pa.concat_tables(held))

    kinds = df.schema
    schema = StructType([StructField(key, kinds[key].dataType), *(StructField(c, ArrayType(kinds[c].dataType)) for c in columns)])
    names = list(dict.fromkeys([key, *order, *columns]))
    return df.select(*names).repartition(key).sortWithinPartitions(key).mapInArrow(listed, schema)
