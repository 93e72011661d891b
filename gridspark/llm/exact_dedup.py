"""Exact duplicates by most-significant-digit radix partitioning of whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def squeezed(text: str | Column) -> Column:
    """The text with every run of [\\x20\\x09-\\x0D] as one space; null as empty. Single spaces are not touched, only longer runs."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, first: int = 64, grow: int = 16) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are split by their length, then by successive digits of bytes: `first` bytes, then `grow` times as
    many each round. Only groups of two and more go on to the next digit; a group whose texts have ended is
    final, so equality comes from all bytes, not from a digest. Counting is pre-aggregated, and joining the
    counts back is a plain join of which Spark can split hot keys. Squeezed texts are written once, with a number
    for each row. The join by that number shuffles all texts longer than the first digit once; only those that share length
    and first digit with another go on to the rounds after.

    Null text is empty text. Empty texts form a group like any other. A row without doc_id is kept and alone, and
    counts in no group. Rows that share a doc_id are told apart by their number; those that repeat both id and text
    are members of their group and share its fate. Other columns are ignored; an empty table gives no rows."""
    digit = lambda at, width: F.substring(F.col("t").cast("binary"), at + 1, width)
    base = docs.select("doc_id", squeezed("text").alias("t")).select("doc_id", "t", F.octet_length("t").alias("n"), digit(0, first).alias("d"), F.sha2("t", 256).alias("text_sha256"))
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "radix")
    head = base.where("doc_id is not null").select("row", "doc_id", "n", "d")
    # bin: one row of a group stands for its length and the digits so far
    count = [F.count("*").alias("size"), F.min("doc_id").alias("group"), F.max("row").alias("bin")]
    shared = stored(head.groupBy("n", "d").agg(*count).where("size > 1"), "radix")  # written, so that the next join is one Spark can split
    state = stored(head.join(shared, ["n", "d"]).select("row", "bin", "doc_id", "group", "n", "size"), "radix")
    ended = [state.where(F.col("n") <= first).select("row", "group", "size")]
    going = state.where(F.col("n") > first).select("row", "bin", "doc_id")
    texts = base.select("row", "n", F.substring(F.col("t").cast("binary"), first + 1, 2**31 - 1 - first).alias("t"))
    going = stored(going.join(texts.hint("merge"), "row"), "radix")
    at, width = first, first * grow
    while not going.isEmpty():
        cut = going.withColumn("d", digit(0, width))
        shared = stored(cut.groupBy("bin", "d").agg(*count[:2], F.max("row").alias("next")).where("size > 1"), "radix")
        new = stored(cut.join(shared, ["bin", "d"]).select("row", F.col("next").alias("bin"), "doc_id", "n", "group", "size", F.substring("t", width + 1, 2**31 - 1 - width).alias("t")), "radix")
        forget(going, shared)
        at, width = at + width, width * grow
        ended.append(stored(new.where(F.col("n") <= at).select("row", "group", "size"), "radix"))
        going = new.where(F.col("n") > at).drop("group", "size")
        going.stored_at = new.stored_at
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    kept = F.coalesce("group", "doc_id")
    return (
        base.select("row", "doc_id", "text_sha256")
        .join(found.hint("merge"), "row", "left")
        .select("doc_id", kept.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), kept.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
    )
