"""The registered queries of the numbered operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(documents(spark, sf_dir))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    # text: what is left when passages of more than fifty words go too, however few bytes they have
    out = removed(documents(spark, sf_dir), words=51)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .counts import count_tokens

    out = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests, encode

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, voronoi_top_k

    return voronoi_top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 50 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked

    return linked(documents(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import search

    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten, whole

    return whiten(whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matched

    out = matched(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit, items = F.col("found.n_hit"), F.col("found.items")
    return out.select("doc_id", "found.n_words", "found.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_bpe, op3_top_k, op4_packing, op5_language_id, op6_repeats, op7_token_counts, op8_line_dedup, op9_quality, op10_jaccard)
    + (op11_search, op12_whitening, op13_decontaminate)
}

SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op3_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) WHERE rank <= 5""",
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, c.key IS NOT NULL AND doc_id < last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id""",
    "op10_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.r < b.r GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
near(r, q) AS (SELECT r, r FROM w UNION SELECT near.r, l.y FROM near JOIN (SELECT x, y FROM link UNION ALL SELECT y, x FROM link) l ON l.x = near.q),
least AS (SELECT near.r, min(o.doc_id) AS component_id FROM near JOIN w o ON o.r = near.q GROUP BY near.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w JOIN least USING (r) LEFT JOIN n USING (r)""",
    "op11_search": r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS nd, sum(len(w))::BIGINT AS l FROM low),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM low) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scored AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term), total GROUP BY item_id, r, doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0) WHERE rank <= 10""",
    "op13_decontaminate": r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + 9], ' ') AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS words FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
found AS (SELECT r, k, p, item_id FROM dw JOIN iw USING (k, words)),
hits AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS word FROM (SELECT DISTINCT r, k, p FROM found)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN own USING (r)""",
}
