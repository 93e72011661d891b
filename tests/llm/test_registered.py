"""The registered queries that SQL does not hold, on whole tables: against libraries, plain versions and labels."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from gridspark.llm import queries

from ..test_queries import DATA
from . import brute


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def answer(spark, name, texts):
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, DATA).collect()}
    assert set(rows) == set(texts)
    return rows


def test_bpe(spark, texts):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in answer(spark, "op2_bpe", texts).items():
        text = texts[i]["text"] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))


def test_packing(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for i, r in texts.items()}
    rows = queries.op4_packing(spark, DATA).collect()
    held, used = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    whole = lambda parts: [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] == [a for a, _ in sorted(parts)]
    assert set(held) == set(ids) and all(whole(x) and sum(n for _, n in x) == len(ids[i]) for i, x in held.items())
    assert all(whole(x) and sum(n for _, n in x) <= 2048 for x in used.values()) and len(used) == -(-sum(map(len, ids.values())) // 2048)


def test_language(spark, texts):
    rows = answer(spark, "op5_language_id", texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    asked = [i for i, r in rows.items() if r["held_out"] and texts[i]["lang"] and any(c.isalpha() for c in texts[i]["text"] or "")]
    assert np.mean([rows[i]["lang_pred"] == texts[i]["lang"] for i in asked]) > 0.9
    assert all(r["lang_pred"] == "und" for i, r in rows.items() if not any(c.isalpha() for c in texts[i]["text"] or ""))


def test_repeats(spark, texts):
    want = brute.repeats([(i, r["text"]) for i, r in texts.items()], 400)
    for i, r in answer(spark, "op6_repeats", texts).items():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[i][:4]


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    for i, r in answer(spark, "op7_token_counts", texts).items():
        text = texts[i]["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_quality(spark, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = answer(spark, "op9_quality", texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    asked = [i for i, r in rows.items() if r["held_out"] and labels.get(i) is not None]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in asked]) > 0.9


def test_whitening(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    x = {i: np.floor(64 * np.array(v, float)).astype(int) + 1000000 for i, v in vectors.items() if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = queries.op12_whitening(spark, DATA).toPandas()
    m = np.stack(list(x.values()))
    n, sums = len(m), m.sum(0)
    assert len(out) == n * min(32, m.shape[1]) and set(out["n"]) == {n} and out["identity_error"].max() < 1e-9
    c = m - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    want = (c @ vectors / np.sqrt(values))[:, ::-1]
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[list(x)].to_numpy()
    sign = np.sign((got * want[:, : got.shape[1]]).sum(0))
    assert np.abs(got - sign * want[:, : got.shape[1]]).max() < 1e-6
    explained = out.drop_duplicates("component").set_index("component")["explained"]
    assert np.allclose(explained.sort_index(), (values[::-1] / values.sum())[: len(explained)], rtol=1e-9)
    deviation = out.drop_duplicates("vec_id").set_index("vec_id")["deviation"]
    assert all(deviation[i] == ((n * v - sums) ** 2).sum() for i, v in x.items())
