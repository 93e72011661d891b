"""Passages of more than fifty words go, however few bytes they have."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from gridspark.llm import repeats

from .test_texts import corpus, frame

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def covered(docs, words):
    """Every run of `words` words against every other, with and without punctuation at its ends."""
    at = {}
    for i, text in docs:
        own = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for (a, b), (c, d) in zip(own, own[words - 1 :]):
            low, high = b - len(text[a:b].lstrip(MARKS)), c + len(text[c:d].rstrip(MARKS))
            at |= {(i, x, y): text[x:y] for x in {a, low if low < b else a} for y in {d, high if high > c else d}}
    seen = Counter(at.values())
    marks = {i: bytearray(len(text or "")) for i, text in docs}
    for (i, x, y), passage in at.items():
        if seen[passage] > 1:
            marks[i][x:y] = b"\1" * (y - x)
    return marks


def cut(spark, docs):
    """The pipeline's stages between near duplicates and packing."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    df = frame(spark, docs)
    for _, stage in corpus_pipeline.STAGES[names.index("near_duplicates") + 1 : names.index("packing")]:
        df = stage(spark, df, "")
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_short_words(spark):
    own = lambda c, k: " ".join(f"{c}{j}" for j in range(k))
    random.seed(7)
    letters = lambda k: " ".join(random.choice("abcdefgh") for _ in range(k))
    one, two, fifty = letters(51), letters(55), letters(50)
    assert len(one) == 101 and len(two) < 300
    docs = [(1, f"{own('p', 9)} {one} {own('q', 9)}"), (2, f"{one}, {own('r', 70)}"), (3, f"{own('s', 9)} ({two}) {fifty}"), (4, f"{two}\n{own('t', 9)}"), (5, f"{own('u', 9)} {fifty} {own('v', 9)}"), (6, None)]
    want = {1: f"{own('p', 9)}  {own('q', 9)}", 2: f", {own('r', 70)}", 3: f"{own('s', 9)} () {fifty}", 4: f"\n{own('t', 9)}", 5: docs[4][1], 6: None}
    assert cut(spark, docs) == want


def test_passage_of_many_documents(spark):
    random.seed(8)
    passage = " ".join(random.choice("abcdefgh") for _ in range(53))
    docs = [(i, f"x{i} y{i} {passage} z{i}") for i in range(3000)]
    assert cut(spark, docs) == {i: f"x{i} y{i}  z{i}" for i in range(3000)}


@pytest.mark.parametrize(("seed", "words", "gram"), [(1, 9, 4), (2, 12, 3), (3, 20, 6)])
def test_words_of_a_random_corpus(spark, seed, words, gram):
    docs = [(i, t and t.replace("Gam ", "Gam, ").replace(" 42", " (42)")) for i, t in corpus(seed)]
    want = covered(docs, words)
    marks = {i: bytearray(len(m)) for i, m in want.items()}
    texts = dict(docs)
    for i, _, x, y in repeats.repeated_words(frame(spark, docs), words, gram).collect():
        b = texts[i].encode()
        x, y = len(b[:x].decode()), len(b[:y].decode())
        marks[i][x:y] = b"\1" * (y - x)
    assert any(map(any, want.values())) and marks == want


def test_words_of_no_rows(spark):
    assert repeats.repeated_words(frame(spark, []).limit(0)).count() == 0
