"""Learned operators by held-out accuracy, search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import langid, quality, topk

LANGS = {"en": "the of and ing tion er with that".split(), "de": "der die und ung keit sch über zu".split(), "fr": "le la et eaux tion é vous qui".split()}


def documents(spark, n=300):
    random.seed(3)
    rows = []
    for i in range(n):
        lang = random.choice(list(LANGS))
        words = [random.choice(LANGS[lang]) + random.choice(["", "a", "e"]) for _ in range(random.randint(20, 120))]
        good = int(random.random() < 0.8)
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, lang, good))
    rows += [(1000, None, "en", 1), (1001, "", "de", 1), (1002, "12 34 !!", "fr", 1), (1003, "é", None, 1), (1004, "the of and" * 20000, "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").repartition(3)


def test_languages(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in langid.languages(docs, 40).join(docs.select("doc_id", "lang"), "doc_id").collect()}
    test = [r for r in got.values() if r["held_out"] and r["doc_id"] < 1000]
    assert len(test) > 40 and np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1003]["lang_pred"] in LANGS
    nothing = langid.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.languages(docs.limit(0)).count() == 0


def test_nystroem_with_all_landmarks_is_kernel_ridge_regression():
    rng = np.random.default_rng(0)
    p = (rng.random((12, 64)) < 0.3).astype(np.float32)
    langs = ["a", "b", "c"] * 4
    m = langid.krr(p, langs, 12, 0.5, (1,), 6)
    k = langid.kernel(p, p).astype(float)
    y = np.where(np.array(langs)[:, None] == np.array(m.langs), 1.0, -1.0)
    assert np.allclose(m.scores(p), k @ np.linalg.solve(k + 0.5 * np.eye(12), y), atol=1e-4)


def test_quality(spark):
    docs = documents(spark)
    labels = docs.where("doc_id < 1000").select("doc_id", "quality")
    rows = quality.quality(docs, labels).join(docs.select("doc_id", "quality"), "doc_id").collect()
    test = [r for r in rows if r["held_out"] and r["doc_id"] < 1000]
    assert len(rows) == docs.count() and len(test) > 30 and np.mean([r["predicted"] == r["quality"] for r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    model = quality.fit(docs, labels)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}
    assert {r["predicted"] for r in quality.quality(docs, labels.limit(0)).collect()} == {1}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_pairs_decide_the_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    label = (x[:, 0] - x[:, 1] > 0).astype(int)
    m = quality.bradley_terry(x, label)
    assert np.mean((m.score(x) >= 0.3) == label) > 0.97 and m.weights[0] > 0 > m.weights[1]


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    x[50:90] = x[50]  # ties
    x[100:110] *= 30
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)] + [(300, None, 0), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = topk.voronoi_top_k(topk.quantised(df), F.col("vec_id") % 20 == 0, pivots=8, block=block, samples=100).collect()
    v = np.floor(x * 256)
    want = []
    for q in range(0, 200, 20):
        s = v @ v[q]
        order = [i for i in sorted(range(200), key=lambda i: (-s[i], i)) if i != q][:5]
        want += [(q, r, i, int(s[i])) for r, i in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == want
    small = topk.voronoi_top_k(topk.quantised(df.where("vec_id < 3")), F.col("vec_id") == 0, pivots=8)
    assert small.count() == 2
    assert topk.voronoi_top_k(topk.quantised(df.limit(0)), F.lit(True)).count() == 0


@pytest.mark.parametrize(("block", "samples"), [(4, 100), (4096, 5)])
def test_top_k_of_many_widths(spark, block, samples):
    """Vectors meet those of their width, also where the sample has none of it; most of them in one cell, asked by most, are split."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(100 + i, [1.0, 1.0, 1.0]) for i in range(90)]
    rows += [(200 + i, rng.normal(size=2).tolist()) for i in range(7)] + [(300, [2.0] * 9), (301, []), (302, []), (303, None), (None, [1.0, 2.0, 3.0]), (304, [1.0, None]), (305, [float("nan")] * 3), (5, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, cell string").repartition(4)
    got: dict = {}
    for r in topk.voronoi_top_k(topk.quantised(df), F.col("vec_id") % 2 == 0, pivots=6, block=block, samples=samples).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)]
    want = {}
    for i, v in whole:
        if i % 2 == 0:
            found = sorted(((sum(x * y for x, y in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:5]
            if found:
                want[i] = found
    assert got == want and got[302] == [(0, 301)] and 300 not in got
