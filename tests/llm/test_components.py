"""Connected components against union by relabelling."""

import random

from gridspark.llm.common import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges += [(200 + k, 201 + k) for k in range(12)] + [(400, k) for k in range(380, 399)] + [(7, 7)] + edges[:5]
    of = {x: x for e in edges if e[0] != e[1] for x in e}
    for a, b in edges:
        if a != b:
            least, most = sorted((of[a], of[b]))
            of = {x: least if c == most else c for x, c in of.items()}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == sorted(of.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_rows_are_one_document(spark):
    """A row that repeats id and text goes, so no later stage cuts either copy for the other's sake; rows without words or id stay."""
    from gridspark.llm.jaccard import one_of_each

    t, u = " ".join(f"w{k}" for k in range(300)), " ".join(f"x{k}" for k in range(40))
    rows = [(1, t, "a"), (1, t, "b"), (2, u, "c"), (3, t, "d"), (1, u + " y", "e"), (None, t, "f"), (None, t, "g"), (5, "", "h"), (5, "", "i"), (6, " \n", "j"), (6, " \n", "k"), (7, None, "l"), (7, None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    for parts in (1, 5):
        out = one_of_each(docs.repartition(parts))
        assert out.columns == docs.columns
        got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
        assert got == sorted([(1, t), (1, u + " y"), (0, t), (0, t), (5, ""), (5, ""), (6, " \n"), (6, " \n"), (7, ""), (7, "")])
    assert one_of_each(docs.limit(0)).count() == 0
