"""Encoding, counts and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridspark.llm import bpe, counts, packing

ALPHABET = ["a", "e", "th", "ing", "'s", "'", "'re", " ", "  ", "\n", "\n\n", "!", "?", "é", "ß", "İ", "Σ", "9", "42", "<|endoftext|>", "<|", "日本", "́", "\xa0", "\t", "😀", "don't", "Å", "word ", "hello "]


def texts(n=150, longest=60):
    random.seed(8)
    out = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, longest))) for _ in range(n)]
    return [(k, t) for k, t in enumerate([*out, None, "", "x" * 900, "ab" * 500 + " " + "c d" * 300, " " * 700, "\n " * 300])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 512), (32, 12), (64, 30)])
def test_chunked_encoding(spark, chunk, overlap):
    rows, path = texts(), P.path("byte_bpe_50k.tiktoken")
    library = bpe.codec(path, P.PATTERN).library
    encoded = bpe.encode(frame(spark, rows), path, P.PATTERN, chunk, overlap)
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["bytes"]).decode()) for r in bpe.decode(encoded, path).collect()}
    assert got == {i: (library.encode_ordinary(t or ""), t or "") for i, t in rows}


def test_encoding_of_empty_tables_and_repeated_rows(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.encode(frame(spark, []), path, P.PATTERN).count() == 0
    assert bpe.encode(frame(spark, [(1, "a b" * 40), (1, "a b" * 40), (None, "c")]), path, P.PATTERN, 32, 8).count() == 3


def test_counts_of_all_prefixes(spark):
    rows, path = texts(80, 14), P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in counts.count_tokens(frame(spark, rows), path).collect()}
    assert got == {i: (len((t or "").encode()), n(t)) for i, t in rows}
    few = [(i, t) for i, t in rows if t is None or len(t) < 80]
    table = {r["doc_id"]: r["counts"] for r in counts.prefix_counts(frame(spark, few), path).collect()}
    assert table == {i: [n((t or "")[:k]) for k in range(len(t or "") + 1)] for i, t in few}
    cut = counts.prefix_counts(frame(spark, few), path).select("doc_id", counts.fitting(3).alias("t"), counts.tokens_before(2).alias("n")).collect()
    for r in cut:
        t = dict(few)[r["doc_id"]] or ""
        assert r["t"] == max((t[:k] for k in range(len(t) + 1) if n(t[:k]) <= 3), key=len) and r["n"] == n(t[:2])


@pytest.mark.parametrize("most", [7, 1 << 10, 4 << 20])
def test_words_are_tabled_together(monkeypatch, most):
    random.seed(9)
    path = P.path("word_bpe_49k.json")
    words = ["".join(random.choice("abdeinorst") for _ in range(random.randint(2, 70))) for _ in range(3000)]
    rows = [t for _, t in texts()] + [" ".join(random.choice([w, w.title() + ",", f"<{w}>", "é" + w]) for w in words[k : k + 5]) for k in range(0, 3000, 5)]
    random.shuffle(rows)
    one_by_one, alone = [], counts.PrefixCounter.token_table
    monkeypatch.setattr(counts.PrefixCounter, "token_table", lambda self, piece, every: one_by_one.append(piece) or alone(self, piece, every))
    n = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in rows], add_special_tokens=False)]
    assert counts.PrefixCounter(path, 500).count(pa.array(["cut off", *rows])[1:], most).tolist() == n
    # only long pieces, and what is short of a table's worth
    assert most < 1 << 20 or sum(len(x) <= counts.WIDE for x in one_by_one) < counts.MANY


def test_pairs_in_a_small_table():
    c = counts.PrefixCounter(P.path("word_bpe_49k.json"))
    pieces = sorted((t.encode() for t in ("internationalisation", "hhhhhhhh", "xqzv", "straße", "日本語", "a", "...!!", "th")), key=len, reverse=True)
    want = [c.token_table("".join(map(c.char.__getitem__, m)), False)[1][-1] for m in pieces]
    for bits in (1, 4, 16):  # pairs take each other's places
        assert counts.Trie(c.vocab, bits).totals(pieces, c.stay).tolist() == want


@pytest.mark.parametrize("window", [8, 100])
def test_packing(spark, window):
    rows, path = texts(), P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    got = packing.pack(frame(spark, rows), path, P.PATTERN, window, with_ids=True).collect()
    seen, room = {i: 0 for i in ids}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["start"] == seen[r["doc_id"]] and bytes(r["ids"]) == piece and r["ids_crc32"] == zlib.crc32(piece) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for k, pieces in room.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or k == max(room) and at < window
    assert sorted(room) == list(range(len(room)))
    assert packing.pack(frame(spark, []), path, P.PATTERN).count() == 0
