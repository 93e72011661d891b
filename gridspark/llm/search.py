"""Ranked lexical search by the Best Position Algorithm on impact lists of bounded shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import forget, slices, stored
from .words import item_blocks, item_words, word_ids


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0]..stop[0], start[1]..stop[1], ... in one array."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


class Shard:
    """Impact lists of one bounded set of documents, and the way from a document to its places in all lists."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.ptr, self.term, self.impact = ptr, term, impact
        order = np.lexsort((-impact, term))
        self.lists = np.searchsorted(term[order], np.arange(terms + 1))
        self.doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[order]
        self.falling = impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.times = np.zeros(terms, np.int64)
        self.reads = 0

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int = 0, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold all of the k best with a score above 0 and not below `floor`, ties at the end included.

        Each round reads on in every list from its best position, up to which all places have been seen by sorted
        or by direct access. A document that turns up is scored at once: direct accesses give its share, and mark its
        place, in each list. No unseen document scores more than the sum of what stands next to the best
        positions; when that is strictly below the k-th score, or 0, none of them can enter."""
        here = self.lists[terms] < self.lists[terms + 1]
        terms, times = terms[here], times[here]
        best, end = self.lists[terms].copy(), self.lists[terms + 1]
        seen, done = np.zeros(len(self.term), bool), np.zeros(len(self.ptr) - 1, bool)
        docs, scores, kth = np.empty(0, np.int64), np.empty(0, np.int64), max(floor, 0)
        self.times[terms] = times
        while True:
            open_ = best < end
            bound = int((times[open_] * self.falling[best[open_]]).sum())
            if not bound or bound < kth:
                break
            places = _ranges(best[open_], np.minimum(best[open_] + step, end[open_]))
            found = np.unique(self.doc[places[~seen[places]]])
            found = found[~done[found]]
            done[found] = True
            entries = _ranges(self.ptr[found], self.ptr[found + 1])
            share = self.times[self.term[entries]]
            seen[self.place[entries[share > 0]]] = True
            sums = np.append(0, np.cumsum(share * self.impact[entries]))
            ends = np.cumsum(self.ptr[found + 1] - self.ptr[found])
            score = sums[ends] - sums[np.append(0, ends[:-1])] if len(ends) else sums[:0]
            docs, scores = np.append(docs, found), np.append(scores, score)
            if len(scores) > k:
                kth = max(kth, int(np.partition(scores, -k)[-k]))
            elif len(scores) == k:
                kth = max(kth, int(scores.min()))
            own = (scores >= kth) & (scores > 0)
            docs, scores = docs[own], scores[own]
            for i in np.flatnonzero(open_):
                ahead = seen[best[i] : end[i]]
                first = int(ahead.argmin())
                best[i] = end[i] if ahead[first] else best[i] + first
            self.reads += len(places)
            step *= 2
        self.times[terms] = 0
        return docs, scores


def _counted(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, n, terms, tf): words of each document in all, and its counts of those of the vocabulary."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, n = word_ids(b.column("text"), vocabulary)
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), n)
            known = ids >= 0
            key, tf = np.unique(row[known] * size + ids[known], return_counts=True)
            ends = np.searchsorted(key, np.arange(b.num_rows + 1) * size).astype(np.int32)
            as_list = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), as_list(key % max(size, 1), pa.int32()), as_list(tf, pa.int64())], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tf array<long>")


def _lengths(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """m of each document: 25 + 75 n N div L, in whole numbers."""
    if int(n.max(initial=0)) * documents * 75 < 1 << 62:
        return 25 + 75 * n * documents // max(words, 1)
    return np.array([25 + 75 * int(x) * documents // words for x in n], np.int64)


def search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = 1 << 17, entries: int = 1 << 21) -> DataFrame:
    """item_id, rank, doc_id, score: for each item (item_id, text) the k documents (doc_id, text) of highest score above 0, equal scores by rising doc_id.

    Items go in blocks of up to `most` words, one pass over the documents each. A first narrow pass counts the words of
    the block's vocabulary in every document; from it come the weights. Then each task builds impact lists of its
    documents, shard by shard of about `entries` places, and runs the Best Position Algorithm for every item. What the
    k-th best of earlier shards scored is a floor to the later ones. A task yields k rows an item at most, which two
    windows merge, the first by groups of tasks.

    Null texts have no words; a null doc_id comes after all others of its score. Every row is a document of its own, also
    where doc_ids or texts repeat. Rows of one item_id are one item with the terms of all. Other columns are not
    used. Without documents or items there are no rows."""
    schema = StructType([items.schema["item_id"], docs.schema["doc_id"], StructField("score", LongType())])
    out = None
    for block in item_blocks(item_words(items), most):
        terms = block.select("item_id", F.explode("words").alias("term")).groupBy("item_id", "term").count().collect()  # at most `most` rows
        words = sorted({r["term"].encode() for r in terms})
        place = {w: i for i, w in enumerate(words)}
        asked: dict[object, list[tuple[int, int]]] = {}
        for r in terms:
            asked.setdefault(r["item_id"], []).append((place[r["term"].encode()], r["count"]))
        wanted = [(i, *np.array(x, np.int64).T) for i, x in asked.items()]
        part = _ranked(docs, pa.array(words, pa.binary()), wanted, k, entries, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(docs: DataFrame, vocabulary: pa.Array, wanted: list, k: int, entries: int, schema: StructType) -> DataFrame:
    index = stored(_counted(docs, vocabulary), "impacts")
    n_docs, n_words = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a word of the vocabulary
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    kinds = to_arrow_schema(schema)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Shard]]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> tuple[pa.Array, Shard]:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, n, lists, tf = (t.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tf"))
            ptr = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            term, tf = lists.flatten().to_numpy(), tf.flatten().to_numpy()
            m = np.repeat(_lengths(n.to_numpy(), n_docs, n_words), np.diff(ptr))
            return ids, Shard(ptr, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), len(vocabulary))

        for b in batches:
            held.append(b)
            size += len(b.column("terms").flatten()) + b.num_rows
            if size >= entries:
                yield made()
                held, size = [], 0
        if held:
            yield made()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple]] = [[] for _ in wanted]  # (-score, doc_id is null, doc_id)
        for ids, shard in shards(batches):
            for q, (_, terms, times) in enumerate(wanted):
                floor = -top[q][-1][0] if len(top[q]) == k else 0
                found, scores = shard.best(terms, times, k, floor)
                if len(found):
                    new = [(-int(s), x is None, x) for s, x in zip(scores, ids.take(pa.array(found)).to_pylist())]
                    top[q] = sorted([*top[q], *new], key=lambda x: (x[:2], 0 if x[1] else x[2]))[:k]
        rows = [(wanted[q][0], x[2], -x[0]) for q, own in enumerate(top) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.types[i]) for i in range(3)], schema.names)

    found = stored(index.mapInArrow(solve, schema).withColumn("part", F.spark_partition_id() % 256), "found")
    forget(index)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
