"""Repeated passages from an enhanced suffix array, dealt out by sampled anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, flat, forget, free_name, prefix_hash, row_tag, slices, span_hash, stored

_PLACE = np.uint64(22)  # bits of a place in a slice
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def anchors_of(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """For every window of `least` bytes in one text, its anchor: the gram of the smallest hash, the leftmost of equals.

    Equal windows have their anchors at the same place. Returns for each run of windows with one anchor: text
    number, first window's start, anchor's start, end of the last window, hash of the anchor."""
    n, wide = len(data), least - gram + 1
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if n < least:
        return none
    hashes = span_hash(prefix_hash(data), slice(0, n - gram + 1), slice(gram, n + 1))
    key = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
    # Sliding minimum: of the rest of a block and of the beginning of the next.
    padded = np.full(-(-len(key) // wide) * wide, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - least + 1
    place = (np.minimum(after[:windows], before[wide - 1 : wide - 1 + windows]) & np.uint64((1 << 22) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:windows]
    start = np.arange(windows)
    valid = start + least <= ends[text + 1]
    text, start, place = text[valid], start[valid], place[valid]
    if not len(start):
        return none
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(start)] - 1
    return text[first], start[first], place[first], start[last] + least, hashes[place[first]]


def _agree(m: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading bytes rows i and j share."""
    unequal = m[i] != m[j]
    return np.minimum(np.where(unequal.any(1), unequal.argmax(1), m.shape[1]), np.minimum(most[i], most[j]))


def intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The LCP intervals (length, first, last) of a suffix array by a stack scan, children before parents; lcp[i] is of suffixes i and i + 1."""
    out, stack = [], [(0, 0)]
    for i, x in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            out.append((length, first, i))
        if x and (not stack or stack[-1][0] < x):
            stack.append((x, first))
    return out


def maximal(right: np.ndarray, rights: np.ndarray, left: np.ndarray, lefts: np.ndarray, least: int) -> list[tuple[int, int, np.ndarray]]:
    """The groups of maximal repeats of `least` bytes and more in one bucket: (bytes before the anchor, bytes from it on, members).

    Suffixes begin at the anchors. The interval tree over their common prefixes is walked from the leaves. The
    members of an interval share its prefix and no more; sorted by what precedes them, they have an interval tree of
    their own over the common left extensions, and each of its intervals is a group that no byte to the left or to
    the right extends. Longer extensions come first."""
    n = len(right)
    out: list[tuple[int, int, np.ndarray]] = []
    order = np.array(sorted(range(n), key=lambda i: right[i, : rights[i]].tobytes()))
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=lambda i: left[i, : lefts[i]].tobytes())] = np.arange(n)
    lcp = _agree(right, order[:-1], order[1:], rights)
    for length, first, last in intervals(lcp.tolist()):
        members = order[first : last + 1]
        if length + lefts[members].max() < least:
            continue
        members = members[np.argsort(rank[members])]
        shared = _agree(left, members[:-1], members[1:], lefts)
        out.extend((back, length, members[i : j + 1]) for back, i, j in intervals(shared.tolist()) if back and back + length >= least)
        if length >= least and not shared.all():
            out.append((0, length, members))
    return out


def outermost(reach: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of stretches (bytes before the anchor, bytes from it on) those that no other covers."""
    out: list[tuple[int, int]] = []
    for back, ahead in sorted(reach, reverse=True):
        if not out or ahead > out[-1][1]:
            out.append((back, ahead))
    return out


def _solve(least: int, gram: int, every: bool):
    """Streams rows sorted by bucket and yields the members of the groups of maximal repeats: classes, and how far they reach around their anchors.

    Of each group with `every`; else only the stretches of each class of one that no other group's cover."""
    names = ["h", "g", "k", "c1", "c2", "doc_id", "tag", "n", "start", "stop", "back", "ahead"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held.extend(zip(*(b.column(c).to_pylist() for c in ("h", "g", "doc_id", "tag", "pos", "a", "n", "c1", "c2", "text"))))
            if len(held) >= 4096:
                cut = next((k for k in range(len(held) - 1, 0, -1) if held[k][:2] != held[k - 1][:2]), 0)  # the last bucket may go on
                if cut:
                    yield _groups(held[:cut])
                    held = held[cut:]
        if held:
            yield _groups(held)

    def _groups(rows: list[tuple]) -> pa.RecordBatch:
        bounds = [0, *(k for k in range(1, len(rows)) if rows[k][:2] != rows[k - 1][:2]), len(rows)]
        at, wide, text = np.array([r[5] for r in rows]), least - gram + 1, [r[9] for r in rows]
        right = np.frombuffer(b"".join(t[a:].ljust(least, b"\0")[:least] for t, a in zip(text, at)), np.uint8).reshape(len(rows), least)
        left = np.frombuffer(b"".join(t[:a][::-1].ljust(wide, b"\0")[:wide] for t, a in zip(text, at)), np.uint8).reshape(len(rows), wide)
        rights, lefts = np.minimum([len(t) for t in text] - at, least), np.minimum(at, wide)
        b, out = np.array(bounds), []
        pairs = b[:-1][np.diff(b) == 2]
        ahead, back = _agree(right, pairs, pairs + 1, rights), _agree(left, pairs, pairs + 1, lefts)
        found = [(0, int(back[k]), int(ahead[k]), (pairs[k], pairs[k] + 1)) for k in np.flatnonzero(ahead + back >= least)]
        for lo, hi in zip(b[:-1], b[1:]):
            if hi - lo > 2:
                found.extend((k, x, y, lo + of) for k, (x, y, of) in enumerate(maximal(right[lo:hi], rights[lo:hi], left[lo:hi], lefts[lo:hi], least)))
        if every:
            # A class that lies whole in a group of several classes is no group of its own: k of -2 says so.
            inside = {int(i) for _, x, y, members in found for i in members if x == lefts[i] and y == rights[i]}
            found += [(-2, int(lefts[i]), int(rights[i]), (i,)) for i in inside]
        else:
            reach: dict[int, list[tuple[int, int]]] = {}
            for _, x, y, members in found:
                for i in members:
                    if rows[i][6] == 1:
                        reach.setdefault(int(i), []).append((x, y))
            found = [(0, x, y, (i,)) for i, own in reach.items() for x, y in outermost(own)]
        for k, x, y, members in found:
            for i in members:
                h, g, id, tag, pos, a, n, c1, c2, _ = rows[i]
                out.append((h, g, k, c1, c2, id, tag, n, pos + a - x, pos + a + y, x, y))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(12)], names)

    return run


SPAN = ["doc_id", "tag", "start", "stop"]
GROUP = "h long, g long, k long, c1 long, c2 long, doc_id long, tag long, n long, start long, stop long, back long, ahead long"


def _split(crowded: DataFrame, least: int, most: int, steps: tuple[int, ...]) -> tuple[DataFrame | None, DataFrame | None]:
    """Buckets of more than `most` suffixes: (groups of windows, buckets that have become small).

    A bucket is split by the common bytes of ever narrower strips of its windows: all windows of `step` neighbouring
    starts share least - step + 1 bytes, and equal windows have equal strips. Strips found once are done, small
    buckets go to the suffix array. At step 1 a strip is a window: found twice, it repeats, however many hold
    it, and windows of one hash are the group. Only hashes are counted, pre-aggregated in each task; no bucket is gathered."""
    groups = small = None
    place = ["doc_id", "tag", "pos"]
    now = crowded.select(*place, "a", "n", "c1", "c2", "text", F.lit(0).alias("low"), F.col("a").alias("high"))
    for step in steps:

        def strips(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            names = [*place, "a", "n", "c1", "c2", "low", "high"]
            for b in batches:
                out: list[tuple] = []
                for *own, text in zip(*(b.column(c).to_pylist() for c in (*names, "text"))):
                    a, low, high = own[3], max(own[7], least - (len(text) - own[3])), own[8]
                    for j in range(low // step, high // step + 1):
                        lo, hi = max(low, j * step), min(high, j * step + step - 1)
                        core = text[a - min(lo, j * step) if j * step <= a else 0 : a - (j * step + step - 1) + least]
                        if lo <= hi:
                            out.append((*own[:7], lo, hi, *np.frombuffer(xxhash.xxh3_128_digest(core, j), "<i8").tolist()))
                columns = list(zip(*out)) or [()] * 11
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k in (3, 7, 8) else pa.int64()) for k, c in enumerate(columns)], [*names, "h", "g"])

        cut = stored(now.mapInArrow(strips, "doc_id long, tag long, pos long, a int, n long, c1 long, c2 long, low int, high int, h long, g long"), "strips")
        sizes = stored(cut.groupBy("h", "g").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("total > 1"), "strips")
        shared = cut.join(sizes.hint("merge"), ["h", "g"])
        if step == 1:
            groups = shared.select(
                "h", "g", F.lit(0).cast("long").alias("k"), "c1", "c2", "doc_id", "tag", "n", (F.col("pos") + F.col("a") - F.col("low")).alias("start"),
                (F.col("pos") + F.col("a") - F.col("low") + least).alias("stop"), F.col("low").cast("long").alias("back"), (F.lit(least) - F.col("low")).cast("long").alias("ahead"),
            )
            break
        shared = stored(shared, "strips")
        source = crowded.select(*place, "text")
        few = shared.where((F.col("m") <= most) & (F.col("m") > 1)).join(source, place)
        sub = few.select(
            "h", "g", "doc_id", "tag", (F.col("pos") + F.col("a") - F.col("high")).alias("pos"), F.col("high").alias("a"), "n", "c1", "c2",
            F.substring("text", F.col("a") - F.col("high") + 1, F.col("high") - F.col("low") + least).alias("text"),
        )
        small = sub if small is None else small.unionByName(sub)
        now = shared.where(F.col("m") > most).join(source, place).select(*place, "a", "n", "c1", "c2", "text", "low", "high")
        if now.isEmpty():
            break
    return groups, small


def _search(docs: DataFrame, least: int, gram: int, most: int, steps: tuple[int, ...], every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept, settled): members of the groups of maximal repeats, by class; all anchors seen more than once, with their class, and with `every` also those that a batch of rows has of one class besides the first; what repeats within one batch."""
    docs = docs.select("doc_id", row_tag().alias("tag"), "text").where("doc_id is not null")
    columns = ["doc_id", "tag", "pos", "a", "size", "h", "c1", "c2", "n"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, ends = flat(b.column("text"))
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            for at in range(0, max(1, len(data)), 1 << 21):  # a text longer than that has a slice of its own
                part = data[at : at + (1 << 21) + least - 1] if b.num_rows == 1 else data
                text, start, place, stop, h = anchors_of(part, ends if b.num_rows > 1 else np.array([0, len(part)]), least, gram)
                view = memoryview(np.ascontiguousarray(part))
                around = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(start.tolist(), stop.tolist())]), "<i8").reshape(-1, 2)
                # Of a class seen again in this slice (long runs of one word are nothing else) one goes on, with
                # their number; what they cover is settled.
                _, one, of, n = np.unique(around.view("i8,i8").ravel(), return_index=True, return_inverse=True, return_counts=True)
                seen = np.flatnonzero(n[of] > 1)
                more = np.setdiff1d(seen, one)
                out = [(text[one], start[one], place[one] - start[one], stop[one] - start[one], h[one].view(np.int64), around[one, 0], around[one, 1], n)]
                if len(seen):
                    new = np.r_[True, (text[seen][1:] != text[seen][:-1]) | (start[seen][1:] > stop[seen][:-1])]
                    first = np.flatnonzero(new)
                    last = np.r_[first[1:], len(seen)] - 1
                    zero = np.zeros(len(first), np.int64)
                    out.append((text[seen][first], start[seen][first], zero, stop[seen][last] - start[seen][first], zero, zero, zero, zero))
                if every and len(more):  # n is negative: they do not count again
                    out.append((text[more], start[more], place[more] - start[more], stop[more] - start[more], h[more].view(np.int64), around[more, 0], around[more, 1], np.full(len(more), -1)))
                for t, s, a, size, key, c1, c2, count in out:
                    arrays = [ids[t].astype(np.int64), tags[t].astype(np.int64), s - ends[t] + at, a.astype(np.int32), size.astype(np.int32), key, c1.copy(), c2.copy(), count]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], columns)
                if b.num_rows > 1:
                    break

    anchors = stored(docs.mapInArrow(find, "doc_id long, tag long, pos long, a int, size int, h long, c1 long, c2 long, n long"), "anchors")
    settled = stored(anchors.where("n = 0").select("doc_id", "tag", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("stop")), "spans")
    again = stored(anchors.where("n > 0").groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h"), "anchors")
    kept = stored(anchors.where("n <> 0").join(again.hint("merge"), "h"), "anchors")
    forget(anchors, again)
    classes = stored(kept.where("n > 0").groupBy("h", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "tag", "pos", "a", "size")).alias("one")), "classes")
    open_ = stored(classes.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("fewest")).where("m > 1 and fewest = 1").select("h", "m"), "classes")
    wanted = classes.join(open_.hint("merge"), "h").select("one.*", "h", "c1", "c2", "n", "m")
    wanted = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("h", "c1", "c2", "pos", "a", "size", "n", "m")).alias("w"))  # no more than the text has anchors

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            out: list[tuple] = []
            for id, tag, text, w in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text"), b.column("w").to_pylist()):
                text = text.as_py().encode()
                out.extend((x["h"], 0, id, tag, x["pos"], x["a"], x["n"], x["c1"], x["c2"], x["m"], text[x["pos"] : x["pos"] + x["size"]]) for x in w)
            columns = list(zip(*out)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.binary() if k == 10 else pa.int64()) for k, c in enumerate(columns)], names)

    bucket = "h long, g long, doc_id long, tag long, pos long, a int, n long, c1 long, c2 long, m long, text binary"
    names = [x.split()[0] for x in bucket.split(", ")]
    around = stored(docs.join(wanted.hint("merge"), ["doc_id", "tag"]).mapInArrow(fetch, bucket), "around")
    solved = lambda rows: rows.repartition("h", "g").sortWithinPartitions("h", "g").mapInArrow(_solve(least, gram, every), GROUP)
    groups = solved(around.where(F.col("m") <= most).drop("m"))
    crowded = around.where(F.col("m") > most)
    if not crowded.isEmpty():
        windows, small = _split(crowded, least, most, steps)
        if small is not None:
            groups = groups.unionByName(solved(small))
        if windows is not None:
            groups = groups.unionByName(windows)
    # Suffixes that are equal as far as they reach are one leaf of the tree: a class of two and more is a group.
    leaves = classes.where("n > 1").select("h", F.lit(0).cast("long").alias("g"), F.lit(-1).cast("long").alias("k"), "c1", "c2", "one.doc_id", "one.tag", "n",
        F.col("one.pos").alias("start"), (F.col("one.pos") + F.col("one.size")).alias("stop"), F.col("one.a").cast("long").alias("back"), (F.col("one.size") - F.col("one.a")).cast("long").alias("ahead"))
    if every:
        groups = stored(groups, "groups")
        leaves = leaves.join(groups.where("k = -2").select("h", "c1", "c2").distinct().hint("merge"), ["h", "c1", "c2"], "left_anti")
        groups = groups.where("k <> -2")
    out = stored(groups.unionByName(leaves), "groups")
    forget(classes, open_, around)
    return out, kept, settled


def repeat_groups(docs: DataFrame, least: int = 400, gram: int = 128, most: int = 500, steps: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """(h, g, k, c1, c2, doc_id, tag, start, length, back): groups of repeats of `least` bytes and more of docs (doc_id, text), one row for each occurrence.

    Rows that agree in h, g, k, length and back (and in c1 and c2, where k is -1) are all occurrences of one repeat, however rows are
    dealt; `back` of its bytes are before its anchor. It is maximal as
    far as windows around its anchor reach, which is `least` bytes on and least - gram + 1 back; longer repeats are a chain of groups that overlap. In buckets of more
    than `most` classes that are split, groups are of the windows of `least` bytes that a part has in common, and one with k of -1 lists the places
    with equal surroundings. See repeated_spans(). Rows that agree in doc_id and
    text give their places once."""
    groups, kept, _ = _search(docs, least, gram, most, steps, True)
    own = kept.select("h", "c1", "c2", F.col("doc_id").alias("d"), F.col("tag").alias("t"), (F.col("pos") + F.col("a")).alias("at"))
    # h of a split bucket is that of a strip, so classes are told by their digest.
    found = groups.join(own.drop("h").hint("merge"), ["c1", "c2"])
    return found.select("h", "g", "k", "c1", "c2", F.col("d").alias("doc_id"), F.col("t").alias("tag"), (F.col("at") - F.col("back")).alias("start"), (F.col("back") + F.col("ahead")).alias("length"), "back").distinct()


def repeated_spans(docs: DataFrame, least: int = 400, gram: int = 128, most: int = 500, steps: tuple[int, ...] = (64, 8, 1)) -> DataFrame:
    """(doc_id, tag, start, stop): the bytes of docs (doc_id, text) covered by strings of `least` bytes that also start elsewhere; spans may overlap.

    1. Every window of `least` bytes has an anchor, its gram of the smallest hash, so equal windows have equal anchors
       at equal places. One anchor stands for about a hundred windows. Anchors found once are done.
    2. Anchors with equal surroundings (a 128-bit hash) form one class, represented by one of them, so thousands of
       copies count once. A class of two and more is a leaf of the tree and repeats as a whole.
    3. Classes of one anchor form a bucket of suffixes. Buckets are dealt out by the anchor's hash; each is sorted, and
       a stack scan over the common prefixes gives the groups of maximal repeats: see maximal(). Matches are of real bytes.
    4. Buckets of more than `most` classes are first split further: see _split().

    Positions are bytes of UTF-8. Matches do not cross texts. Rows without doc_id take no part. Rows that share a
    doc_id are told apart by row_tag() of their text; if that is equal too, they repeat each other. Null text is empty."""
    groups, kept, settled = _search(docs, least, gram, most, steps, False)
    leaf = groups.where("k = -1").select("h", "c1", "c2")
    whole = kept.join(leaf.hint("merge"), ["h", "c1", "c2"]).select("doc_id", "tag", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("stop"))
    # Occurrences of classes of two and more are covered by those of their leaves.
    return groups.where("k >= 0 and n = 1").select(*SPAN).unionByName(whole).unionByName(settled)


def joined_spans(start: list[int], stop: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start, stop)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def cut_characters(text: bytes, gone: list[tuple[int, int]]) -> str:
    """The text without the characters of which all bytes go."""
    out, at = [], 0
    for x, y in gone:
        while x < y and text[x] & 0xC0 == 0x80:
            x += 1
        while y < len(text) and y > x and text[y] & 0xC0 == 0x80:
            y -= 1
        out.append(text[at:x])
        at = y
    return b"".join([*out, text[at:]]).decode()


def with_spans(docs: DataFrame, found: DataFrame, name: str = "spans") -> DataFrame:
    """docs with an array of structs of the columns of found (or null) added, matched by doc_id and row_tag()."""
    tag = free_name(docs, "tag")
    spans = found.groupBy("doc_id", F.col("tag").alias(tag)).agg(F.collect_set(F.struct(*(c for c in found.columns if c not in ("doc_id", "tag")))).alias(name))
    return docs.withColumn(tag, row_tag()).join(spans.hint("merge"), ["doc_id", tag], "left").drop(tag)


def removed(docs: DataFrame, least: int = 400, gram: int = 128, most: int = 500, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, text) of every row; see repeated_spans().

    kept, which need not be valid UTF-8, is the bytes left. text is the text left: a character goes if all its bytes
    do, and so do passages of `words` words that also stand elsewhere, if that is asked for (see repeated_words()).
    A row without doc_id is left whole. Null is empty."""
    found = repeated_spans(docs, least, gram, most).withColumn("words", F.lit(False))
    if words:
        found = found.unionByName(repeated_words(docs, words).withColumn("words", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                text, spans = (text.as_py() or "").encode(), spans or ()
                gone = joined_spans([s["start"] for s in spans if not s["words"]], [s["stop"] for s in spans if not s["words"]])
                at = [0, *(x for s in gone for x in s), len(text)]
                left = cut_characters(text, joined_spans([s["start"] for s in spans], [s["stop"] for s in spans]))
                rows.append((len(text), sum(y - x for x, y in gone), len(gone), b"".join(text[x:y] for x, y in zip(at[::2], at[1::2])), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "text"])

    both = with_spans(docs.select("doc_id", "text"), found)
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string")


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs of bytes without ASCII white space; none goes on into the next text."""
    inside = np.r_[False, ~IS_SPACE[data], False]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    stops = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, stops


def word_anchors(data: np.ndarray, ends: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start of the first word, stop of the last, anchor's hash) for each run of windows of `words` words with one anchor.

    As in anchors_of(), but places are words: the anchor of a window is the `gram` words of the smallest hash among
    those between its first and its last word, so windows that differ in punctuation at their edges share it."""
    starts, stops = words_of(data, ends)
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.int64),)
    n, wide = len(starts), words - 2 - gram + 1
    if n < words:
        return none
    prefix, out = prefix_hash(data), []
    for at in range(0, n - words + 1, 1 << 20):
        a, b = starts[at : at + (1 << 20) + words - 1], stops[at : at + (1 << 20) + words - 1]
        hashes = span_hash(prefix, a[: len(a) - gram + 1], b[gram - 1 :])
        key = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
        windows = len(a) - words + 1
        place = np.lib.stride_tricks.sliding_window_view(key[1:], wide)[:windows].min(1)
        place = (place & np.uint64((1 << 22) - 1)).astype(np.int64)
        text = np.searchsorted(ends, a[:windows], "right") - 1
        ok = np.flatnonzero(b[words - 1 :] <= ends[text + 1])
        if len(ok):
            new = np.flatnonzero(np.r_[True, (place[ok][1:] != place[ok][:-1]) | (text[ok][1:] != text[ok][:-1])])
            first, last = ok[new], ok[np.r_[new[1:], len(ok)] - 1]
            out.append((text[first], a[first], b[last + words - 1], hashes[place[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def word_windows(text: bytes, start: int, stop: int, words: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of every `words` words in a row in text[start:stop], with and without punctuation before the first and after the last."""
    part = np.frombuffer(text, np.uint8)[start:stop]
    starts, stops = words_of(part, np.array([0, len(part)]))
    own = [(a + start, b + start) for a, b in zip(starts.tolist(), stops.tolist())]
    for (a, first), (last, b) in zip(own, own[words - 1 :]):
        low, high = first - len(text[a:first].lstrip(_PUNCTUATION)), last + len(text[last:b].rstrip(_PUNCTUATION))
        for x in {a, low if low < first else a}:
            for y in {b, high if high > last else b}:
                yield x, y


def repeated_words(docs: DataFrame, words: int = 51, gram: int = 16) -> DataFrame:
    """(doc_id, tag, start, stop): the bytes of docs (doc_id, text) covered by `words` words in a row that also stand elsewhere, however few bytes they have; spans may overlap.

    Words are runs without ASCII white space. Equal passages agree in every byte from their first word to their
    last, but for punctuation at either end, which belongs to them where both have it. Anchors found once are
    done, and anchors with equal surroundings are one class, as in repeated_spans(). Of the windows around one anchor
    of each class, where several classes share it, 128-bit hashes are counted, pre-aggregated in each task."""
    docs = docs.select("doc_id", row_tag().alias("tag"), "text").where("doc_id is not null")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, ends = flat(b.column("text"))
            text, start, stop, h = word_anchors(data, ends, words, gram)
            view = memoryview(np.ascontiguousarray(data))
            around = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i:j]) for i, j in zip(start.tolist(), stop.tolist())]), "<i8").reshape(-1, 2)
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False)[text].astype(np.int64) for c in ("doc_id", "tag"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, tags, start - ends[text], stop - ends[text], h, around[:, 0].copy(), around[:, 1].copy())], [*SPAN, "h", "c1", "c2"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 18):
            rows: dict[tuple, None] = {}
            for id, tag, text, runs in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text"), b.column("w").to_pylist()):
                text = text.as_py().encode()
                for r in runs:
                    for x, y in word_windows(text, r["start"], r["stop"], words):
                        rows[id, tag, x, y, *np.frombuffer(xxhash.xxh3_128_digest(text[x:y]), "<i8").tolist()] = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], [*SPAN, "c1", "c2"])

    anchors = stored(docs.mapInArrow(find, "doc_id long, tag long, start long, stop long, h long, c1 long, c2 long"), "anchors")
    again = stored(anchors.groupBy("h").agg(F.count("*").alias("total")).where("total > 1").select("h"), "anchors")
    kept = stored(anchors.join(again.hint("merge"), "h"), "anchors")
    forget(anchors, again)
    classes = stored(kept.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*SPAN)).alias("one")), "classes")
    whole = kept.join(classes.where("n > 1").select("h", "c1", "c2").hint("merge"), ["h", "c1", "c2"]).select(*SPAN)
    several = classes.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("fewest")).where("m > 1 and fewest = 1").select("h")
    wanted = classes.join(several.hint("merge"), "h").groupBy("one.doc_id", "one.tag").agg(F.collect_set(F.struct("one.start", "one.stop")).alias("w"))  # no more than the text has anchors
    all_ = stored(docs.join(wanted.hint("merge"), ["doc_id", "tag"]).mapInArrow(windows, "doc_id long, tag long, start long, stop long, c1 long, c2 long"), "windows")
    twice = stored(all_.groupBy("c1", "c2").agg(F.count("*").alias("total")).where("total > 1").select("c1", "c2"), "windows")
    found = stored(all_.join(twice.hint("merge"), ["c1", "c2"]).select(*SPAN).unionByName(whole), "spans")
    forget(kept, classes, all_, twice)
    return found


def without_repeats(docs: DataFrame, least: int = 400, gram: int = 128, most: int = 500, words: int | None = None) -> DataFrame:
    """docs, with text cut by its passages of `least` bytes and more, and of `words` words and more if that is given, that
    also stand elsewhere. A character goes if all its bytes do, so the text stays valid. Null stays null."""
    found = repeated_spans(docs, least, gram, most)
    if words:
        found = found.unionByName(repeated_words(docs, words))
    names, extra = docs.columns, free_name(docs, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = []
            for value, spans in zip(b.column("text"), b.column(extra).to_pylist()):
                value = value.as_py()
                texts.append(cut_characters(value.encode(), joined_spans([s["start"] for s in spans], [s["stop"] for s in spans])) if spans and value else value)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(c).type) if c == "text" else b.column(c) for c in names], names)

    both = with_spans(docs, found, extra)
    return both.select(*names, extra).mapInArrow(run, docs.schema)
