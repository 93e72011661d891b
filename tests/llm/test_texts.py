"""Operators on texts against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import exact_dedup, jaccard, line_dedup, repeats

from . import brute

WORDS = ["alpha", "béta", "Gam", "delta ", "ep", "zé", "theta\t", "42"]


def corpus(seed, n=120):
    random.seed(seed)
    some = lambda k: " ".join(random.choice(WORDS) for _ in range(k))
    base, lines = [some(60) for _ in range(6)], [some(6) for _ in range(5)] + ["A rather common line of text", "  a RATHER common line of text "]
    docs = []
    for i in range(n):
        r = random.random()
        if r < 0.2:
            t = random.choice(base)
        elif r < 0.5:
            b = random.choice(base)
            j, m = sorted((random.randint(0, len(b)), random.randint(0, len(b))))
            t = some(random.randint(0, 9)) + b[j:m] + some(random.randint(0, 9))
        elif r < 0.6:
            w = random.choice(base).split(" ")
            w[random.randint(0, len(w) - 1)] = "new"
            t = "  ".join(w)
        elif r < 0.8:
            t = "\n".join(random.choice(lines) for _ in range(random.randint(1, 6)))
        elif r < 0.85:
            t = "ab " * random.randint(0, 100)
        else:
            t = random.choice([None, "", " ", "\n", "q", some(80), "x" * 3000])
        docs.append((i * 3, t))
    return docs


def frame(spark, docs):
    rows = [(i, t, "x", [1], None) for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, drop string, spans array<int>, n long").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact(spark, seed):
    docs = corpus(seed)
    got = {r[0]: tuple(r[1:]) for r in exact_dedup.exact_duplicates(frame(spark, docs), first=4, grow=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == brute.exact(docs)


def test_exact_rows_without_id(spark):
    got = exact_dedup.exact_duplicates(spark.createDataFrame([(None, "a b"), (7, "a  b"), (7, "a  b"), (3, "c")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, 1, True), (3, 1, True), (7, 2, True), (7, 2, True)]


def test_exact_rows_that_share_an_id(spark):
    docs = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "b"), (5, "z" * 3000), (5, "z" * 2999 + "y"), (6, "z" * 3000)]
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(frame(spark, docs)).collect())
    assert got == [(1, 1, 2, True), (1, 1, 3, True), (2, 1, 2, False), (3, 1, 3, False), (4, 1, 3, False), (5, 5, 1, True), (5, 5, 2, True), (6, 5, 2, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    docs = corpus(seed)
    out = line_dedup.dedup_lines(frame(spark, docs), least=10, counts=True)
    assert out.columns == ["doc_id", "text", "drop", "spans", "n", "n_lines", "n_dropped"]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect()}
    assert got == brute.lines(docs, 10)


def test_runs_stay_few(spark):
    runs = line_dedup.LineRuns(spark, fan=2)
    for k in range(7):  # the largest ids come first
        runs.add(spark.createDataFrame([(k % 3, 0, 1, 9 - k), (9, 9, 1, 9 - k)], "h1 long, h2 long, docs long, last long"))
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    assert sorted(tuple(r) for r in runs.merged().collect()) == [(0, 0, 3, 9), (1, 0, 2, 8), (2, 0, 2, 7), (9, 9, 7, 9)]
    # the anti-join lets one run only say who holds a key last
    assert sum(r.where("h1 = 9 and last is not null").count() for r in runs.runs()) == 1
    runs.close()


def test_lines_of_rows_that_share_an_id(spark):
    common = "a line that is common enough"
    docs = [(1, f"{common}\nx"), (1, "other line that is only here"), (1, f"y\nz\n{common}"), (2, common), (5, f"  {common.upper()}\t"), (None, common), (2, common)]
    got = sorted((r["doc_id"] or -1, r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, docs), counts=True).collect())
    assert got == sorted([(-1, common, 1, 0), (1, "x", 2, 1), (1, "other line that is only here", 1, 0), (1, "y\nz", 3, 1), (2, "", 1, 1), (2, "", 1, 1), (5, f"  {common.upper()}\t", 1, 0)])
    assert line_dedup.dedup_lines(frame(spark, docs[:4]), counts=True).where("n_dropped > 0").count() == 0  # two documents


def test_lines_of_a_long_text(spark):
    lines = [f"line number {k} of a long text" for k in range(100_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[::2])), (3, "\n".join(lines[::4]))]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(frame(spark, docs), counts=True).collect()}
    assert got == {1: (100_000, 25_000), 2: (50_000, 25_000), 3: (25_000, 0)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed):
    docs = corpus(seed, 200)
    got = {r[0]: tuple(r[1:]) for r in jaccard.linked(frame(spark, docs)).collect()}
    assert got == brute.jaccard(docs)


def test_jaccard_many_near_copies(spark):
    random.seed(4)
    base = [f"w{k}" for k in range(100)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randint(0, 99)] = f"n{i}"
        docs.append((i, " ".join(w)))
    assert {r[0]: tuple(r[1:]) for r in jaccard.linked(frame(spark, docs)).collect()} == brute.jaccard(docs)
    kept = {r[0] for r in jaccard.one_of_each(frame(spark, docs)).select("doc_id").collect()}
    assert kept == {c for _, c in brute.jaccard(docs).values()}


@pytest.mark.parametrize(("seed", "most", "least", "gram"), [(1, 2000, 40, 16), (2, 3, 40, 16), (3, 2, 30, 10)])
def test_repeats(spark, seed, most, least, gram):
    docs = corpus(seed)
    want = brute.repeats(docs, least)
    if most < 9:
        spans = repeats.repeated_spans(frame(spark, docs), least, gram, most, steps=(8, 4, 1)).collect()
        got = {i: bytearray(w[0]) for i, w in want.items()}
        for r in spans:
            got[r["doc_id"]][r["start"] : r["stop"]] = b"\1" * (r["stop"] - r["start"])
        assert {i: w[4] for i, w in want.items()} == got
        return
    got = {r[0]: tuple(r[1:]) for r in repeats.removed(frame(spark, docs), least, gram, most).drop("text").withColumn("kept", F.sha2("kept", 256)).collect()}
    assert got == {i: w[:4] for i, w in want.items()}
    cut = repeats.without_repeats(frame(spark, docs), least, gram, most)
    assert cut.columns == ["doc_id", "text", "drop", "spans", "n"]
    for r in cut.collect():
        text = dict(docs)[r["doc_id"]]
        if text is None:
            assert r["text"] is None
        else:
            marks, at, kept = want[r["doc_id"]][4], 0, []
            for c in text:
                size = len(c.encode())
                if not all(marks[at : at + size]):
                    kept.append(c)
                at += size
            assert r["text"] == "".join(kept)


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("most", [500, 3])
def test_repeat_groups(spark, most, parts):
    """Every group lists all occurrences of its bytes, however rows are dealt, and where a byte extends it another group goes on."""
    least, gram = 40, 16
    docs = corpus(4, 60) + [(1000 + k, "the same passage of some words, again and again in four rows of one batch" + " x" * k) for k in range(4)]
    texts = {i: (t or "").encode() for i, t in docs}
    rows = repeats.repeat_groups(frame(spark, docs).repartition(parts), least, gram, most, (8, 4, 1)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["h"], r["g"], r["k"], r["length"], r["back"], *([r["c1"], r["c2"]] if r["k"] < 0 else [])), set()).add((r["doc_id"], r["start"]))
    assert groups
    at: dict = {}
    for (_, _, _, length, *_), places in groups.items():
        for i, x in places:
            at.setdefault(i, []).append((x, x + length))
    reaches = lambda i, low, high: any(x <= low and high <= y for x, y in at[i])
    for (_, _, k, length, _, *_), places in groups.items():
        i, x = min(places)
        w = texts[i][x : x + length]
        found = {(j, p) for j, t in texts.items() for p in range(len(t) - length + 1) if t.startswith(w, p)}
        assert length >= least and places <= found and len(found) > 1
        assert places == found or k < 0 and most == 3  # a bucket that was split
        if k >= 0 and most > 3:
            before = {texts[j][p - 1 : p] if p else None for j, p in places}
            after = {texts[j][p + length : p + length + 1] or None for j, p in places}
            # What goes on is a window with another anchor, and so in a group that overlaps.
            assert len(before) > 1 or None in before or reaches(i, x - 1, x - 1 + least)
            assert len(after) > 1 or None in after or reaches(i, x + length + 1 - least, x + length + 1)
    covered = {i: bytearray(len(t)) for i, t in texts.items()}
    for (_, _, _, length, *_), places in groups.items():
        for i, x in places:
            covered[i][x : x + length] = b"\1" * length
    marks = brute.repeats(docs, least)
    assert all(bytes(covered[i]) == bytes(marks[i][4]) for i in texts)


def test_maximal_groups():
    # "xbcd" three times, "axbcd" twice of them; anchors at "b"
    texts, at = [b"zaxbcdp", b"qaxbcdq", b"ttxbcdr"], np.array([3, 3, 3])
    right = np.array([list(t[a:].ljust(5, b"\0")) for t, a in zip(texts, at)], np.uint8)
    left = np.array([list(t[:a][::-1].ljust(5, b"\0")) for t, a in zip(texts, at)], np.uint8)
    found = repeats.maximal(right, np.array([4, 4, 4]), left, at, 4)
    assert sorted((x, y, sorted(m.tolist())) for x, y, m in found) == [(1, 3, [0, 1, 2]), (2, 3, [0, 1])]


def test_rows_that_share_an_id(spark):
    long = " ".join(f"w{k}" for k in range(200))
    docs = [(1, "tiny"), (1, f"a {long} b"), (2, f"c {long} d"), (3, None), (None, long)]
    df = frame(spark, docs)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in repeats.removed(df).collect())
    cut = len(long) + 2
    assert got == [(-1, len(long), 0), (1, 4, 0), (1, len(long) + 4, cut), (2, len(long) + 4, cut), (3, 0, 0)]
    links = sorted((r[0] or -1, r[1], r[2]) for r in jaccard.linked(df).collect())
    assert links == [(-1, 196, None), (1, 1, 1), (1, 198, 1), (2, 198, 1), (3, 0, 3)]
    assert sorted((r["doc_id"] or -1, r["text"]) for r in jaccard.one_of_each(df).where("text is not null").collect()) == [(-1, long), (1, f"a {long} b"), (1, "tiny")]


def test_lcp_intervals():
    # suffixes: a | ab | abab | b | bab
    assert repeats.intervals([1, 2, 0, 1]) == [(2, 1, 2), (1, 0, 2), (1, 3, 4)]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert jaccard.linked(none).count() == 0
    assert repeats.removed(none).count() == 0
