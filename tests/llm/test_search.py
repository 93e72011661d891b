"""Ranked search and decontamination against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm.decontaminate import Automaton, Matcher, decontaminated, matched
from gridspark.llm.search import Shard, search
from gridspark.llm.words import word_ids, word_places

from . import brute

DOCS = "doc_id long, text string, n_words long, found string, item_id long"
ITEMS = "item_id long, text string, doc_id string"
COMMON = "One two THREE four five six seven eight nine ten eleven twelve"
TEXTS = [
    (1, "alpha beta gamma. Beta!"), (2, None), (3, ""), (4, "  \n.. "), (5, f"x y {COMMON} z"), (6, f"x y {COMMON.replace('six', 'sex')} z"), (7, "alpha " * 50), (8, "alpha beta gamma. Beta!"),
    (9, "ALPHA;betä gamma\x00beta"), (9, "delta"), (9, "delta"), (None, "delta epsilon"), (10, f"{COMMON} {COMMON} and {COMMON}"), (11, "one two three four five " * 300), (12, "solo"), (13, "solo-duo duo solo"),
    (14, "nine ten eleven twelve one two three four five six"), (15, "é" * 200 + " alpha"),
]
ASKED = [(0, "alpha beta"), (1, COMMON), (2, None), (3, ""), (4, "solo"), (5, "duo duo solo"), (6, "delta delta epsilon"), (6, "alpha"), (7, f"{COMMON} thirteen {COMMON}"), (8, "unseen words only"), (None, "delta gamma"), (1, "one two three four five one two three four five")]


def frames(spark, docs=TEXTS, items=ASKED, parts=3):
    d = spark.createDataFrame([(i, t, 7, "own", 3) for i, t in docs], DOCS).repartition(parts)
    return d, spark.createDataFrame([(i, t, "own") for i, t in items], ITEMS)


@pytest.mark.parametrize(("parts", "most", "entries"), [(1, 1 << 17, 1 << 21), (4, 1 << 17, 5), (3, 12, 7)])
def test_search(spark, parts, most, entries):
    docs, items = frames(spark, parts=parts)
    got = {}
    for r in search(docs, items, 3, most, entries).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["score"], r["doc_id"]))
        assert r["rank"] == len(got[r["item_id"]])
    assert got == {i: x for i, x in brute.search(TEXTS, ASKED, 3).items() if x}


def test_search_on_nothing(spark):
    docs, items = frames(spark)
    empty, none = docs.limit(0), items.limit(0)
    assert [search(d, i).count() for d, i in ((empty, items), (docs, none), (empty, none))] == [0, 0, 0]
    assert search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]
    assert search(docs.where("doc_id in (2, 3, 4)"), items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=5), min_size=1, max_size=40), st.integers(1, 4), st.integers(0, 30))
def test_best_positions(rows, k, floor):
    rows = [dict(r) for r in rows]
    ptr = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    shard = Shard(ptr, np.array([t for r in rows for t in r], np.int32), np.array([x for r in rows for x in r.values()], np.int64), 6)
    for _ in range(2):  # a second question finds the shard as the first did
        docs, scores = shard.best(np.array([0, 2, 3]), np.array([1, 2, 1]), k, floor, step=1)
        want = sorted(((x, i) for i, r in enumerate(rows) if (x := r.get(0, 0) + 2 * r.get(2, 0) + r.get(3, 0)) > 0), key=lambda x: (-x[0], x[1]))
        got = sorted(zip(scores.tolist(), docs.tolist()), key=lambda x: (-x[0], x[1]))
        assert [x for x in got[:k] if x[0] >= floor] == [x for x in want[:k] if x[0] >= floor]


def test_best_positions_stop_early():
    n = 10000
    impact = np.stack([np.arange(n), np.arange(n)], 1).ravel()  # both lists in one order: the first places decide
    shard = Shard(np.arange(n + 1) * 2, np.tile([0, 1], n), impact, 2)
    docs, _ = shard.best(np.array([0, 1]), np.array([1, 1]), 10)
    assert set(range(n - 10, n)) <= set(docs.tolist()) and shard.reads < 200


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), min_size=1, max_size=6), st.lists(st.integers(-1, 3), max_size=30), st.integers(1, 5))
def test_automaton(items, text, window):
    """Longest matches and windows against all substrings."""
    sam = Automaton()
    for words in items:
        v = 0
        for w in words:
            v = sam.extend(v, w)
    have = {tuple(x[a:b]) for x in items for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    v = n = 0
    for i, w in enumerate(text):
        v, n = sam.step(v, n, w)
        assert n == max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in have), default=0)
    m = Matcher([(str(k), x) for k, x in enumerate(items)], window)
    ids = np.array(text, np.int32)
    hit, found = set(), set()
    for a, b in m.runs(ids, np.array([0])) if len(ids) else []:
        spans, own = m.match(ids[a:b].tolist())
        found |= own
        hit |= {a + p for x, y in spans for p in range(x, y)}
    wanted, owners = set(), set()
    for k, x in enumerate(items):
        for p in range(max(len(x) - window, 0) + 1):
            win = x[p : p + window]
            for q in range(len(text) - len(win) + 1):
                if win and text[q : q + len(win)] == win:
                    wanted |= set(range(q, q + len(win)))
                    owners.add(str(k))
    assert hit == wanted and found == owners


@pytest.mark.parametrize(("parts", "most"), [(1, 1 << 17), (4, 30)])
def test_matched(spark, parts, most):
    docs, items = frames(spark, parts=parts)
    out = matched(docs, items, most=most, into="hits")
    assert out.columns == [*docs.columns, "hits"]
    got = sorted((str(r["doc_id"]), str(r["text"]), r["hits"]["n_words"], r["hits"]["n_hit"], tuple(r["hits"]["items"])) for r in out.collect())
    assert got == sorted((str(i), str(t), n, len(hit), tuple(own)) for (i, n, hit, own), (_, t) in zip(brute.windows(TEXTS, ASKED), TEXTS))
    for r in out.collect():
        for s in r["hits"]["spans"]:
            words = brute.terms(r["text"])[s["first"] : s["first"] + s["words"]]
            assert brute.terms(r["text"][s["at"] : s["at"] + s["size"]]) == words


def test_decontaminated(spark):
    docs, items = frames(spark, [(1, f"Before, {COMMON}; after. " + "other words here " * 9), (2, COMMON), (3, None), (4, "clean text"), (5, "é " + COMMON + "! " + "more of it " * 9 + COMMON)], [(1, COMMON)])
    got = {r["doc_id"]: r["text"] for r in decontaminated(docs, items).collect()}
    assert got == {1: "Before, ; after. " + "other words here " * 9, 3: None, 4: "clean text", 5: "é ! " + "more of it " * 9}
    assert decontaminated(docs, items).columns == docs.columns
    assert decontaminated(docs, items.limit(0)).count() == 5 and decontaminated(docs.limit(0), items).count() == 0
    assert {r["doc_id"] for r in decontaminated(docs, items, coverage=1.0).collect()} == {1, 2, 3, 4, 5}


def test_words_of_long_texts():
    """Words are whole where a text is worked through in stretches."""
    import pyarrow as pa

    texts = ["ab cd " * 40 + "x" * 300 + " ef", None, "", "ab", "cd--EF é1"]
    vocabulary = pa.array([b"ab", b"cd", b"ef", "é1".encode(), b"x" * 300], pa.binary())
    for most in (7, 50, 1 << 20):
        ids, n = word_ids(pa.array(texts), vocabulary, most)
        assert n.tolist() == [82, 0, 0, 1, 3] and ids.tolist() == [0, 1] * 40 + [4, 2] + [0] + [1, 2, 3]
    start, end = word_places("ab, é1".encode())
    assert list(zip(start, end)) == [(0, 2), (4, 7)]


def test_without_items(spark):
    docs, items = frames(spark)
    assert matched(docs.drop("found"), items.limit(0)).where("found.n_hit = 0").count() == len(TEXTS)
    with pytest.raises(ValueError, match="column"):
        matched(docs, items)
