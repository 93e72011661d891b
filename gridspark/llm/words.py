"""Words of whole texts as ids of a bounded vocabulary, and blocks of items that bound it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, TO_LOWER, UPPER, flat

#: ASCII digits and letters and every byte of a character beyond ASCII; all else parts words.
IN_WORD = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: The same as a regular expression of characters, for lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def stretches(data: np.ndarray, offsets: np.ndarray, most: int, in_word: np.ndarray = IN_WORD) -> Iterator[tuple[int, int]]:
    """Cuts the bytes of texts into stretches of about `most` that end where no word goes on."""
    lo = 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        if hi < len(data):
            after = offsets[np.searchsorted(offsets, hi)]  # the end of the text that hi lies in
            while hi < after and in_word[data[hi - 1]] and in_word[data[hi]]:
                ahead = np.flatnonzero(~in_word[data[hi : min(hi + 65536, after)]])
                hi = hi + int(ahead[0]) if len(ahead) else min(hi + 65536, after)
        yield lo, int(hi)
        lo = int(hi)


def _starts(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are inside words, and where words start; a word never goes on past the begin of a text."""
    inside = IN_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    start[begins] = inside[begins]
    return inside, np.flatnonzero(start)


def word_ids(col: pa.Array, vocabulary: pa.Array, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's words, in order, the places in the vocabulary (binary, -1 where absent), and how many words each text has.

    Null counts as empty. Works through about `most` bytes at a time; only four bytes a word are kept."""
    data, offsets = flat(col)
    ids, starts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for lo, hi in stretches(data, offsets, most):
        piece = data[lo:hi]
        begins = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        inside, at = _starts(piece, begins)
        if not len(at):
            continue
        letters = TO_LOWER[piece[inside]]
        ends = np.append((np.cumsum(inside, dtype=np.int32) - 1)[at], len(letters)).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        ids.append(pc.fill_null(pc.index_in(own, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32))
        starts.append(at + lo)
    return np.concatenate(ids), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of one text, in bytes."""
    data = np.frombuffer(text, np.uint8)
    inside, start = _starts(data, np.zeros(1, np.int64))
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    return start, np.flatnonzero(end) + 1


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words array<string>): the lower-cased words of each text; null has none."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.select("item_id", F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))


def item_blocks(items: DataFrame, most: int) -> Iterator[DataFrame]:
    """(item_id, words) in blocks dealt by a hash of the id, rows of one id together, each of about most / 2 words and so, with items much shorter than that, below `most`.

    A set of up to `most` words is one block. The blocks bound what one pass over the documents takes along."""
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = 1 if total <= most else -(-2 * total // most)
    for b in range(blocks):
        yield items if blocks == 1 else items.where(F.pmod(F.xxhash64(F.lit("block"), "item_id"), F.lit(blocks)) == b)
