"""A training corpus from documents: quality, repeated lines, near duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import stored
from gridspark.llm.jaccard import one_of_each
from gridspark.llm.line_dedup import dedup_lines
from gridspark.llm.packing import pack
from gridspark.llm.quality import fit, keep_good
from gridspark.llm.repeats import without_repeats


#: Words of a passage, however short: more than fifty.
WORDS = 51
#: Bytes of a passage, however few words it has.
PASSAGE = 400


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, if there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker scores below its cut go."""
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents and more hold stay in the last of them only."""
    return _counted(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard index of 0.8 on five-word shingles, the one of the smallest doc_id stays."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes and more, and of WORDS words and more, that also stand elsewhere are cut out, in whole characters."""
    return _counted(without_repeats(docs, PASSAGE, words=WORDS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, concatenated and cut into windows of 2048."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The first stage is a learned model, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
