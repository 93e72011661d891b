"""N-gram Jaccard join: a grouped prefix join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, TO_LOWER, components, flat, forget, free_name, mix, prefix_hash, row_tag, slices, span_hash, stored, xx128

_ROLE = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes of text that a task looks at together; arrays of 64-bit numbers are made of each byte.
SLICE = 1 << 19
#: Documents that may hold a shingle before it counts as crowded.
LIST = 32
#: Entries of a list from which on it is looked at again before the second round.
LONG = 64
#: Shingles that share a cell of the table of crowdedness, unless it would have more than 2**MOST_BITS cells.
LOAD, MOST_BITS, _BLOCK = 16, 26, 1 << 14
#: Cells that a task counts before it passes them on, about 8 bytes each.
SEEN = 1 << 22
PARITY = [f"b{k}" for k in range(8)]


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `words` words; of all its words, if fewer."""
    docs = len(ends) - 1
    if not len(data):
        return [np.empty(0, np.uint64)] * docs
    space = IS_SPACE[data]
    row = np.repeat(np.arange(docs), np.diff(ends))
    edge = np.r_[True, row[1:] != row[:-1]]
    start = np.flatnonzero(~space & (edge | np.r_[True, space[:-1]]))
    stop = np.flatnonzero(~space & (np.r_[edge[1:], True] | np.r_[space[1:], True])) + 1
    h = span_hash(prefix_hash(TO_LOWER[data]), start, stop)
    count = np.bincount(row[start], minlength=docs)
    at = np.r_[0, np.cumsum(count)]
    full = len(h) - words + 1
    joined = np.zeros(max(full, 0), np.uint64)
    for k in range(words):
        joined += mix(h[k : k + len(joined)] + _ROLE[k]) * _ROLE[k + 32]
    joined = mix(joined)
    out = []
    for d in range(docs):
        n = count[d]
        if n >= words:
            x = np.sort(joined[at[d] : at[d] + n - words + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif n:
            w = h[at[d] : at[d] + n]
            out.append(mix(np.array([np.sum(mix(w + _ROLE[:n]) * _ROLE[32 : 32 + n]) + np.uint64(n)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    """Two sets with a Jaccard index of `percent` share one of their first n - ceil(n * percent / 100) + 1 in any common order."""
    return n - -(-n * percent // 100) + 1


def reachable(p: np.ndarray, q: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m shingles with these prefixes can be linked: all they share up to the end of the prefix
    that ends first is in both prefixes, and of that set only the rest can follow."""
    k = len(np.intersect1d(p, q, assume_unique=True))
    rest = n - len(p) if p[-1] <= q[-1] else m - len(q)
    both = min(k + rest, n, m)
    return 100 * both >= percent * (n + m - both)


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two whole sets have a Jaccard index of `percent`."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def _arrays(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))


def parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """For each set 512 bits, in eight columns: whether an odd number of its hashes falls in each of 512 cells. Where two sets differ in k bits, at least k hashes are in one of them only."""
    odd = [np.packbits((np.bincount((x & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)) for x in sets]
    bits = np.frombuffer(b"".join(x.tobytes() for x in odd), "<i8").reshape(-1, len(PARITY))
    return [pa.array(bits[:, k].copy()) for k in range(len(PARITY))]


def described(docs: DataFrame, words: int, taken, columns: str, parity: bool = False) -> DataFrame:
    """(*columns, n, s1, s2, tokens) of every row of docs: the size of its set, a 128-bit digest of it, and what taken(set) gives for its hashes; parities() too, if asked for."""
    names = [c.split()[0] for c in columns.split(", ")]
    more = PARITY if parity else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            sets = shingle_sets(*flat(b.column("text")), words)
            tokens = _arrays([taken(x) if len(x) else x for x in sets])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *_digests(sets), tokens, *(parities(sets) if more else [])], [*names, "n", "s1", "s2", "tokens", *more])

    return docs.select(*names, "text").mapInArrow(run, ", ".join([columns, "n long, s1 long, s2 long, tokens array<long>", *(f"{c} long" for c in more)]))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), "<i8").reshape(-1, 2)
    return [pa.array([len(x) for x in sets], pa.int64()), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy())]


def surveyed(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows of two kinds: (doc_id, tag, n, s1, s2) of every row of docs, and (block, at, held) for 2**14 of the 2**bits
    cells of the hashes, saying how many shingles of a task's documents fall in each (255 at most); a block of few has only those at `at`."""
    names = ["doc_id", "tag", "n", "s1", "s2", "block", "at", "held"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary()]

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Rows of the cells seen since the last time."""
        cells, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        cells, counts = cells[first], np.minimum(np.add.reduceat(counts, first), 255).astype(np.uint8)
        edges = np.flatnonzero(np.r_[True, cells[1:] // _BLOCK != cells[:-1] // _BLOCK, True])
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            at = cells[lo:hi] % _BLOCK
            whole = np.zeros(_BLOCK, np.uint8)
            whole[at] = counts[lo:hi]
            rows.append((int(cells[lo]) // _BLOCK, at.astype("<u2").tobytes(), counts[lo:hi].tobytes()) if 3 * len(at) < _BLOCK else (int(cells[lo]) // _BLOCK, None, whole.tobytes()))
            if len(rows) == 64 or hi == len(cells):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), k) for k in kinds[:5]), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds[5:]))], names)
                rows = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only cells that occur are held, SEEN at most; counts of one cell may come in several rows.
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in slices(batches, SLICE):
            sets = shingle_sets(*flat(b.column("text")), words)
            cells, counts = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
            held.append((cells.astype(np.uint32), counts.astype(np.uint32)))
            size += len(cells)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tag"), *_digests(sets), *(pa.nulls(b.num_rows, k) for k in kinds[5:])], names)
            if size > SEEN:
                yield from counted(held)
                held, size = [], 0
        if size:
            yield from counted(held)

    return docs.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag long, n long, s1 long, s2 long, block int, at binary, held binary")


def crowding(blocks: DataFrame, bits: int, mean: float) -> np.ndarray:
    """For each cell how crowded it is: 0 up to about its share of all shingles, then one more for each doubling of the excess. 2**bits bytes."""
    odd = max(LIST, 4 * mean**0.5)

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in rows:
            for k, at, held in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("held").to_pylist()):
                x = sums.setdefault(k, np.zeros(_BLOCK, np.int64))
                x[slice(None) if at is None else np.frombuffer(at, "<u2").astype(np.int64)] += np.frombuffer(held, np.uint8)
        level = [np.clip(np.ceil(np.log2(np.maximum(x - mean, 1) / odd)), 0, 15).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["block", "level"])

    out = np.zeros((-(-(1 << bits) // _BLOCK), _BLOCK), np.uint8)
    for r in blocks.select("block", "at", "held").repartition("block").mapInArrow(add, "block int, level binary").collect():
        out[r["block"]] = np.frombuffer(r["level"], np.uint8)
    return out.ravel()


def linked(docs: DataFrame, words: int = 5, percent: int = 80, tags: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text); with tags also row_tag() of its text.

    1. Shingles are put in one order: by how crowded their cell is (a table counted over all documents and broadcast, of
       2**MOST_BITS bytes at most), then by hash. Any order is right; this one keeps lists short.
       Documents of one set form a class, and classes of equal prefix and size a group. One of a group stands for it
       in the index of prefix shingles.
    2. In each list of the index, the first group is paired with all others: as many pairs as entries. A pair stays
       if its sizes are near enough and, were this the first shingle both hold, enough could follow in both: a linked
       pair passes in the list of the first shingle that it shares. Pairs of groups are expanded to their classes,
       and pass if their prefixes and then their whole sets allow it.
    3. Only links between classes not yet connected matter, so a second round compares, in each list that still holds
       several components, the classes of different ones. The join compares all of them, M * M / 2 at most for M
       classes of a list, but gives only pairs that sizes, places and 512 bits of each set allow. Lists are short but
       for classes that consist of crowded shingles, near copies for the most part: before that round, classes of
       long lists meet a few random others, so that most are connected.
    4. Components of the links are those of the documents.

    Sets are compared by 64-bit hashes of shingles. Texts without words are linked with nothing. A row without doc_id
    is linked with nothing and has no component. Rows that share a doc_id are told apart by their texts."""
    docs = docs.select("doc_id", row_tag().alias("tag"), "text")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.log2(1 + size / 6 / LOAD), 14, MOST_BITS))  # words of six bytes
    survey = stored(surveyed(docs, words, bits), "survey")
    base = stored(survey.where("n is not null").select("doc_id", "tag", "n", "s1", "s2"), "sets")
    # c: the number of a class; doc: its smallest doc_id
    classes = base.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    shingles = base.agg(F.sum("n")).first()[0] or 0
    held = spark.sparkContext.broadcast(crowding(survey.where("block is not null"), bits, shingles / (1 << bits)))  # 2**MOST_BITS bytes at most
    forget(survey)

    def prefix(x: np.ndarray) -> np.ndarray:
        """The prefix as sortable tokens: four bits of crowdedness before 58 of the hash."""
        x = (held.value[(x >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (x >> np.uint64(6))
        x.sort()
        return x[: prefix_size(len(x), percent)]

    same = ["s1", "s2", "doc"]
    fronts = described(docs, words, prefix, "doc_id long, tag long", True).where("n > 0").withColumnRenamed("doc_id", "doc").join(classes.hint("merge"), same)
    fronts = stored(fronts.dropDuplicates(same).select("c", "n", "tokens", *PARITY), "prefixes")
    # g: one class of a group
    front = [x.alias(k) for x, k in zip(xx128("tokens"), ("p1", "p2"))]
    groups = stored(fronts.groupBy(*front, "n").agg(F.min("c").alias("g"), F.count("*").alias("size")), "groups")
    member = stored(fronts.select("c", "n", *front, *PARITY).join(groups.hint("merge"), ["p1", "p2", "n"]).select("c", "g", "n", "size", *PARITY), "members")

    index = stored(fronts.join(groups.select(F.col("g").alias("c"), "size").hint("merge"), "c").select(F.col("c").alias("g"), "n", "size", F.posexplode("tokens").alias("pos", "token")), "index")
    heads = index.groupBy("token").agg(F.sum("size").alias("entries"), F.min(F.struct("g", "pos", "n")).alias("first"), F.max("g").alias("last")).where("first.g < last")
    heads = heads.select("token", "entries", F.col("first.g").alias("first"), F.col("first.pos").alias("pos0"), F.col("first.n").alias("n0"))
    lists = stored(index.join(stored(heads, "lists").hint("merge"), "token").select("token", "g", "n", "pos", "first", "pos0", "n0", "entries"), "index")
    forget(index, groups)
    # Of two sets, what both hold from their first common shingle on is no more than what is left of either.
    near = f"100 * least(n, n0) >= {percent} * greatest(n, n0) and {100 + percent} * least(n - pos, n0 - pos0) >= {percent} * (n + n0)"
    pairs = (
        lists.where("g <> first").where(near)
        .select("first", "g")
        .distinct()
        .join(member.select("c", "g"), "g")
        .select(F.col("first").alias("a"), F.col("c").alias("b"))
        .unionByName(member.where("size > 1 and c <> g").select(F.col("g").alias("a"), F.col("c").alias("b")))
    )
    pairs = stored(pairs, "pairs")

    def passing(pairs: DataFrame, of: DataFrame, test) -> DataFrame:
        """The pairs of which the test holds, given the tokens of both in `of` (c, n, tokens)."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y, n, m = b.column("x"), b.column("y"), b.column("nx").to_pylist(), b.column("ny").to_pylist()
                keep = [test(x[k].values.to_numpy(), y[k].values.to_numpy(), n[k], m[k]) for k in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        side = lambda i, t, n: of.select(F.col("c").alias(i), F.col("tokens").alias(t), F.col("n").alias(n))
        both = pairs.join(side("a", "x", "nx").hint("merge"), "a").join(side("b", "y", "ny").hint("merge"), "b")
        return stored(both.select("a", "b", "x", "y", "nx", "ny").mapInArrow(compare, "a long, b long"), "pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        fit = passing(pairs, fronts, lambda p, q, n, m: reachable(p, q, n, m, percent))
        ids = fit.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        ids = stored(classes.join(ids.hint("merge"), "c").select("c", F.col("doc").alias("doc_id"), F.col("s1").alias("of1"), F.col("s2").alias("of2")), "ids")
        texts = docs.join(ids.hint("merge"), "doc_id")
        # rows of one doc_id can have other texts, and rows can be repeated
        whole = described(texts, words, lambda x: x, "c long, of1 long, of2 long").where("s1 = of1 and s2 = of2")
        few = stored(whole.select("c", "n", "tokens").dropDuplicates(["c"]), "sets")
        out = passing(fit, few, lambda p, q, n, m: similar(p, q, percent))
        forget(fit, ids, few)
        return out

    links = links_of(pairs)

    def apart(links: DataFrame) -> DataFrame:
        """(token, first, entries, c, n, pos, k): the classes, with their components, in each list that holds several."""
        parts = components(links)
        named = stored(member.join(parts.select(F.col("node").alias("c"), F.col("component").alias("k")).hint("merge"), "c", "left").withColumn("k", F.coalesce("k", "c")), "named")
        entries = (
            lists.where("entries > 2")
            .select("token", "g", "pos", "first", "entries")
            .join(named.hint("merge"), "g")
            .select("token", "first", "entries", "c", "n", "pos", "k", *PARITY)
            # a group of several classes is one more list, named by the group
            .unionByName(named.where("size > 1").select((-1 - F.col("g")).alias("token"), F.col("g").alias("first"), F.col("size").alias("entries"), "c", "n", F.lit(0).alias("pos"), "k", *PARITY))
        )
        several = stored(entries.groupBy("token").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least < most").select("token"), "lists")
        out = stored(entries.join(several.hint("merge"), "token", "left_semi"), "entries")
        forget(parts, named, several)
        return out

    entries = apart(links)
    # Long lists of near copies: each class meets a few others in a random order of its own for each list, dealt
    # over parts of about 512, until what is left outside is little. This only finds links early.
    order = Window.partitionBy("token", F.pmod(F.xxhash64("c"), F.ceil(F.col("entries") / 512))).orderBy(F.xxhash64("c", "token"))
    some = entries.where(f"entries >= {LONG}")
    for k in range(1, 4):
        some = some.withColumn(f"m{k}", F.lead(F.struct("c", "n", "pos", "k"), k).over(order))
    some = some.select("c", "n", "pos", "k", F.explode(F.array("m1", "m2", "m3")).alias("m")).where("m is not null and m.k <> k").select(F.least("c", "m.c").alias("a"), F.greatest("c", "m.c").alias("b"), "n", "pos", F.col("m.n").alias("n0"), F.col("m.pos").alias("pos0"))
    some = stored(some.where(near).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not some.isEmpty():
        links = stored(links.unionByName(links_of(some)), "links")
        forget(entries)
        entries = apart(links)
    x = entries.select("token", F.col("c").alias("a"), F.col("n").alias("n0"), F.col("pos").alias("pos0"), F.col("k").alias("ka"), *(F.col(c).alias(f"of_{c}") for c in PARITY))
    y = entries.select("token", F.col("c").alias("b"), "n", "pos", F.col("k").alias("kb"), *PARITY)
    # What is in one of the sets only is no more than the index allows: see parities().
    alike = f"{100 + percent} * ({' + '.join(f'bit_count({c} ^ of_{c})' for c in PARITY)}) <= {100 - percent} * (n + n0)"
    more = x.join(y.hint("merge"), "token").where(f"ka < kb and {near} and {alike}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")  # pairs of the round between are verified again, if still apart
    forget(lists, member, pairs, some)
    if not more.isEmpty():
        links = stored(links.unionByName(links_of(more)), "links")
    forget(fronts, entries, more)
    parts = components(links)
    forget(links)
    parts = classes.join(parts.select(F.col("node").alias("c"), F.col("component").alias("k")).hint("merge"), "c", "left").withColumn("k", F.coalesce("k", "c"))
    label = parts.groupBy("k").agg(F.min("doc").alias("component"))
    of = parts.join(label.hint("merge"), "k").select("s1", "s2", "component")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return base.join(of.hint("merge"), ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), *["tag"] * tags)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which no linked document has a smaller doc_id: one of each component, and every row without words or id.

    Of rows that agree in doc_id and text, one stays, whatever their other columns say."""
    tag = free_name(docs, "tag")
    gone = linked(docs, words, percent, tags=True).where("doc_id <> component_id").select("doc_id", F.col("tag").alias(tag)).distinct()
    left = docs.withColumn(tag, row_tag()).join(gone.hint("merge"), ["doc_id", tag], "left_anti")
    place = free_name(left, "place")
    # Dealt and sorted by the keys of the join, so this adds no shuffle.
    again = left.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", tag).orderBy(tag)))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return again.where((F.col(place) == 1) | alone).select(*docs.columns)
