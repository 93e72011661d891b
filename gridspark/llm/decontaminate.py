"""Benchmark decontamination by a generalised suffix automaton of test items over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import free_name, slices, stored
from .words import item_blocks, item_words, word_ids, word_places

_FOUND = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<first:bigint,words:bigint,at:bigint,size:bigint>>,items:array<string>>"


class Automaton:
    """Suffix automaton of several sequences: a state stands for the runs of words that end at the same places in them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that p reaches by w, holding no run longer than those of p and w; split off where there is none."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = short
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = short
            p = self.link[p]
        return short

    def extend(self, last: int, w: int) -> int:
        """The state of a sequence that ends in `last`, with one more word; a new sequence starts at 0."""
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def step(self, v: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest run that ends with w, from those of the word before."""
        while v >= 0:
            to = self.next[v].get(w)
            if to is not None:
                return to, n + 1
            v = self.link[v]
            n = self.length[v] if v >= 0 else 0
        return 0, 0


class Matcher:
    """The automaton of a block of items with what its states mean: which items have the window that a match ends with."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.sam = sam = Automaton()
        for _, words in items:
            v = 0
            for w in words:
                v = sam.extend(v, w)
        n = len(sam.link)
        # The state that holds the last `window` words of what a state holds.
        self.cover = list(range(n))
        for v in sorted(range(n), key=sam.length.__getitem__):
            if sam.link[v] >= 0 and sam.length[sam.link[v]] >= window:
                self.cover[v] = self.cover[sam.link[v]]
        self.held: dict[int, set] = {}  # items by the state of a whole window
        self.short: dict[int, dict[int, set]] = {}  # items of fewer words by state and length
        for item, words in items:
            v = m = 0
            for w in words:
                v, m = sam.step(v, m, w)
                if m >= window:
                    self.held.setdefault(self.cover[v], set()).add(item)
            if 0 < len(words) < window:
                while sam.length[sam.link[v]] >= len(words):
                    v = sam.link[v]
                self.short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        # The nearest state up the suffix links that ends a short item.
        self.up = [-1] * n
        for v in sorted(range(n), key=sam.length.__getitem__):
            self.up[v] = v if v in self.short else self.up[sam.link[v]] if sam.link[v] >= 0 else -1
        self.least = min([window, *(k for x in self.short.values() for k in x)])
        self.pairs = np.unique(np.array([a << 32 | b for _, x in items for a, b in zip(x, x[1:])], np.int64))

    def runs(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Begins and ends of stretches of words in which a window can lie: each word, or each pair of neighbours, is one of the items'.

        Outside the automaton would be back in its root, with a match of a word or none."""
        if self.least == 1:
            on, more = ids >= 0, 0
            cut = first[(first > 0) & (first < len(ids))]
        else:
            pair = ids[:-1].astype(np.int64) << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
            on, more = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pairs[at] == pair if len(self.pairs) else False), 1
            on[first[(first > 0) & (first < len(ids))] - 1] = False
            cut = np.empty(0, np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2] + more
        if len(cut):  # single words: a stretch also ends where a text does
            cut = cut[on[cut] & on[cut - 1]]
            begin, end = np.sort(np.append(begin, cut)), np.sort(np.append(end, cut))
        long = end - begin >= self.least
        return np.stack([begin[long], end[long]], 1)

    def match(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Where windows lie in a stretch, and the items that have them."""
        v = n = 0
        spans, items, states = [], set(), set()
        sam, window, up = self.sam, self.window, self.up
        for i, w in enumerate(ids):
            v, n = sam.step(v, n, w)
            if n >= window:
                states.add(self.cover[v])
                spans.append((i + 1 - n, i + 1))
            u = up[v]
            while u >= 0:
                for k, own in self.short[u].items():
                    if k <= n:
                        spans.append((i + 1 - k, i + 1))
                        items |= own
                u = up[sam.link[u]] if sam.link[u] >= 0 else -1
        for u in states:
            items |= self.held[u]
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matched(docs: DataFrame, items: DataFrame, window: int = 10, most: int = 1 << 17, into: str = "found") -> DataFrame:
    """docs with a column more, a struct: n_words of the text, n_hit of them inside a window of an item, spans (maximal runs of hit words: number of the first, how many, where they start in the text and how many characters they take) and items (their ids as strings, sorted).

    A window is `window` consecutive words of an item, or all words of an item of fewer. The automaton of the items'
    words is walked along each document's words; a match of `window` words and more ends a window, and so does one
    that reaches all of a short item. Items go in blocks of up to `most` words; long ones are cut in pieces that
    overlap by `window` - 1 words, so that each window lies in one piece. Each block is one narrow pass over whole
    texts; nothing is shuffled.

    Null texts and items have no words. An item_id that is null gives hits, but no id. Rows that repeat ids or texts
    are matched each by itself. Without items nothing is hit."""
    if into in docs.columns:
        raise ValueError(f"there is a column {into}")
    length = max(16 * window, most >> 7)  # words of a piece
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(length - window + 1)), lambda k: F.slice("words", k + 1, length))
    pieces = item_words(items).where(F.size("words") > 0).select(F.col("item_id").cast("string"), F.explode(cut).alias("words"))
    blocks = list(item_blocks(pieces, most))
    for k, block in enumerate(blocks):
        docs = _pass(docs, block.collect(), window, into)  # about `most` words
        if k + 1 < len(blocks):
            docs = stored(docs, "matched")
    return docs


def _pass(docs: DataFrame, items: list, window: int, into: str) -> DataFrame:
    words = sorted({w for r in items for w in r["words"]})
    place = {w: i for i, w in enumerate(words)}
    vocabulary = pa.array([w.encode() for w in words], pa.binary())
    listed = [(r["item_id"], [place[w] for w in r["words"]]) for r in items]
    had = docs.columns.index(into) if into in docs.columns else None
    names = [c for c in docs.columns if c != into]
    schema = StructType([docs.schema[c] for c in names] + [StructField(into, StructType.fromDDL(f"x {_FOUND}")["x"].dataType)])
    kinds = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(listed, window)
        for b in slices(batches):
            col = b.column("text")
            ids, n = word_ids(col, vocabulary)
            first = np.append(0, np.cumsum(n))
            before = b.column(had).to_pylist() if had is not None else [None] * b.num_rows
            spans: dict[int, list[tuple[int, int]]] = {}
            found: dict[int, set] = {}
            runs = matcher.runs(ids, first[:-1]) if len(listed) and len(ids) else np.empty((0, 2), np.int64)
            for row, (x, y) in zip(np.searchsorted(first, runs[:, 0], "right") - 1, runs):
                got, own = matcher.match(ids[x:y].tolist())
                if got:
                    off = int(x - first[row])
                    spans.setdefault(row, []).extend((p + off, q + off) for p, q in got)
                    found.setdefault(row, set()).update(own)
            out = []
            for row in range(b.num_rows):
                old = before[row] or {"spans": [], "items": []}
                own = found.get(row)
                if own is None:
                    out.append(before[row] or {"n_words": int(n[row]), "n_hit": 0, "spans": [], "items": []})
                    continue
                merged = _merged(spans[row] + [(s["first"], s["first"] + s["words"]) for s in old["spans"]])
                text = col[row].as_buffer().to_pybytes()
                start, end = word_places(text)
                chars = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                places = [{"first": p, "words": q - p, "at": int(chars[start[p]]), "size": int(chars[end[q - 1]] - chars[start[p]])} for p, q in merged]
                out.append({"n_words": int(n[row]), "n_hit": sum(q - p for p, q in merged), "spans": places, "items": sorted({*old["items"], *own} - {None})})
            yield pa.RecordBatch.from_arrays([b.column(c).cast(kinds.field(c).type) for c in names] + [pa.array(out, kinds.field(into).type)], schema=kinds)

    return docs.mapInArrow(scan, schema)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, length: int = 10, coverage: float = 0.5) -> DataFrame:
    """docs without what is known from items: spans of hit words of `length` words and more (or that are a whole short item) are cut out of the text; documents of which more than the share `coverage` of words is hit go as a whole.

    A cut takes the characters from the first to the last word of the span. Columns stay as they are; a null text
    stays null."""
    found = free_name(docs, "found")
    seen = matched(docs, items, window, into=found)
    spans = F.filter(f"{found}.spans", lambda s: (s["words"] >= length) | (s["words"] < window))
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size"))), F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size"))))

    def between(s, k):
        """The characters from the end of a span to the start of the next."""
        begin = (s["at"] + s["size"]).cast("int")
        until = F.when(k + 1 < F.size(edges), F.get(edges, k + 1)["at"]).otherwise(F.length("text"))
        return F.col("text").substr(begin + 1, (until - begin).cast("int"))

    kept = F.when(F.size(spans) > 0, F.array_join(F.transform(edges, between), "")).otherwise(F.col("text"))
    return seen.where(F.col(f"{found}.n_hit") <= coverage * F.col(f"{found}.n_words")).select(*[(kept if c == "text" else F.col(c)).alias(c) for c in docs.columns])
