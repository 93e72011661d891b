"""Each stage on what the one before kept, against the plain versions; and the registered queries against their SQL."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridspark.llm import quality, queries
from gridspark.llm.common import stored

from ..test_queries import DATA, TABLES, db, table  # noqa: F401
from . import brute
from .test_passages import covered

assert TABLES


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    one = stored(stage["quality"](spark, docs, DATA))
    assert one.columns == columns and set(rows(one)) == {r[0] for r in quality.score(docs, model).collect() if r[1] >= 0.3}
    two = stored(stage["line_dedup"](spark, one, DATA))
    assert two.columns == columns and rows(two) == {i: x[2] for i, x in brute.lines(list(rows(one).items())).items()}
    three = stored(stage["near_duplicates"](spark, two, DATA))
    assert three.columns == columns and set(rows(three)) == {c for _, c in brute.jaccard(list(rows(two).items())).values()}
    four = stored(stage["repeated_passages"](spark, three, DATA))
    marks, before, after = brute.repeats(list(rows(three).items()), corpus_pipeline.PASSAGE), rows(three), rows(four)
    words = covered(list(before.items()), corpus_pipeline.WORDS)
    assert four.columns == columns and set(after) == set(before)
    for i, text in before.items():
        at, kept = 0, []
        for k, c in enumerate(text):
            size = len(c.encode())
            if not words[i][k] and not all(marks[i][4][at : at + size]):
                kept.append(c)
            at += size
        assert after[i] == "".join(kept)
    assert four.where("n_chars <> length(text)").count() == 0
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    five = stage["packing"](spark, four, DATA).collect()
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()}
    seen = dict.fromkeys(total, 0)
    for r in five:
        seen[r["doc_id"]] += r["length"]
    assert seen == total and max(r["sequence_id"] for r in five) + 1 == int(np.ceil(sum(total.values()) / 2048))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, db, name):  # noqa: F811
    df = queries.QUERIES[name](spark, DATA)
    got = table(df.columns, df.collect())
    q = db.execute(queries.SQL[name])
    assert got == table([d[0] for d in q.description], q.fetchall())
