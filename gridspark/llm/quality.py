"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, TO_LOWER, flat, mix, prefix_hash, slices, span_hash

# Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 beyond ASCII, 6 ".", 7 ",", 8-15 other bytes by their value.
_b = np.arange(256)
BYTE_CLASS = np.select(
    [(_b >= 97) & (_b <= 122), (_b >= 65) & (_b <= 90), (_b >= 48) & (_b <= 57), (_b == 32) | (_b == 9), _b == 10, _b >= 128, _b == 46, _b == 44],
    list(range(8)),
    8 + _b % 8,
).astype(np.int64)


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x / np.maximum(n, 1)


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of numbers per text: lengths, word shapes, repetition, and shares of byte-class pairs over the whole text."""
    docs = len(ends) - 1
    n = np.diff(ends)
    row = np.repeat(np.arange(docs), n)
    cls = BYTE_CLASS[data]
    out = []
    pairs = np.zeros((docs, 256))
    if len(data) > 1:
        inside = row[1:] == row[:-1]
        pairs = np.bincount((row[:-1] * 256 + cls[:-1] * 16 + cls[1:])[inside], minlength=docs * 256).reshape(docs, 256).astype(float)
    out.append(np.sqrt(_share(pairs, n[:, None])))
    out.append(np.sqrt(_share(np.bincount(row * 16 + cls, minlength=docs * 16).reshape(docs, 16), n[:, None])))
    # words: maximal runs without ASCII space, in one text
    space = IS_SPACE[data]
    first = np.r_[True, row[1:] != row[:-1]] if len(data) else np.empty(0, bool)
    start = np.flatnonzero(~space & (first | np.r_[True, space[:-1]])) if len(data) else np.empty(0, np.int64)
    last = np.r_[first[1:], True] if len(data) else first
    stop = np.flatnonzero(~space & (last | np.r_[space[1:], True])) + 1 if len(data) else start
    of = row[start]
    words = np.bincount(of, minlength=docs)
    h = span_hash(prefix_hash(TO_LOWER[data]), start, stop)
    key = mix(h ^ mix(of.astype(np.uint64) + np.uint64(1)))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(of[at], minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, of[at], count)
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[1:][again], minlength=docs)
    size = stop - start
    upper = (cls[start] == 1) & (cls[stop - 1] != 0) & (size > 1)
    odd = cls[stop - 1] >= 8
    alone = (size == 1) & (cls[start] >= 8)
    lines = np.bincount(row[data == 10], minlength=docs) + 1
    out.append(
        np.column_stack(
            [
                np.log1p(n), np.log1p(words), _share(np.bincount(of, size, minlength=docs), words), _share(distinct, words), np.log1p(_share(words, distinct)),
                _share(top, words), _share(repeats, words), _share(np.bincount(of[upper], minlength=docs), words), _share(np.bincount(of[odd], minlength=docs), words),
                _share(np.bincount(of[alone], minlength=docs), words), np.log1p(_share(n, lines)), _share(np.bincount(of[size > 20], minlength=docs), words),
            ]
        )
    )
    return np.column_stack(out)


@dataclass
class Ranker:
    """score(x) = sigmoid(slope * (w . standardised x - threshold) + logit(cut))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold) + np.log(self.cut / (1 - self.cut)), -30, 30)))


def bradley_terry(x: np.ndarray, label: np.ndarray, cut: float = 0.3, rivals: int = 12, ridge: float = 2.0, seed: int = 7) -> Ranker:
    """Fits scores so that P(a preferred to b) = sigmoid(w . (x_a - x_b)).

    Each labelled text meets `rivals` random ones of the other label (preference pairs); Newton steps minimise the
    logistic loss of the feature differences. The threshold is the quantile of the training scores at the share of
    label 0, and lies at score `cut`. With one label only, every score is on that label's side."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranker(mean, scale, w, 1.0 if len(bad) else -1.0, 1.0, cut)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    a = np.r_[rng.choice(good, len(bad) * rivals), good]
    b = np.r_[np.repeat(bad, rivals), rng.choice(bad, len(good))]
    d = z[a] - z[b]
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / (len(good) + len(bad)), method="lower"))
    below, above = s[s <= threshold].max(), s[s > threshold].min() if (s > threshold).any() else threshold
    return Ranker(mean, scale, w, float((below + above) / 2), float(4 / max(s.std(), 1e-6)), cut)


def held_out(fold: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % fold == rest


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in slices(batches):
        yield b, features(*flat(b.column("text")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, fold: int = 5, rest: int = 0) -> Ranker:
    """Learns from at most `sample` labelled documents outside the held-out fold, those of the smallest id hashes.

    Labels other than 0 and 1 and null ids are left out; of several labels of one document, one is taken. The
    driver gets their features only: `sample` rows of a few hundred numbers, however large the corpus."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(~held_out(fold, rest)).dropDuplicates(["doc_id"])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x.astype(np.float32)])], ["doc_id", "label", "x"])

    got = chosen.mapInArrow(run, "doc_id long, label int, x binary").toPandas().sort_values("doc_id")
    width = features(np.empty(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, width).astype(float)
    return bradley_terry(x, got["label"].to_numpy())


def score(docs: DataFrame, model: Ranker) -> DataFrame:
    """(doc_id, score) of every row of docs, from its whole text only; null text scores as empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of docs that score at least the cut, with all their columns; scores stay in the tasks, nothing is shuffled."""
    schema, cut = docs.schema, model.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches):
            yield b.filter(pa.array(model.score(x) >= cut))

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; see fit() and score(). A row without doc_id is not held out. Empty tables give no rows; without labels every text is predicted 1."""
    model = fit(docs, labels, sample)
    return score(docs, model).select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= model.cut).cast("int").alias("predicted"))
