"""Language identification with string kernels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TO_LOWER, flat, slices
from .quality import held_out

LETTER = regex.compile(r"\p{L}")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def presence(data: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...], bits: int, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of 0 and 1: which byte n-grams of the given lengths a text holds, hashed to 2**bits columns (the blended spectrum)."""
    docs = len(ends) - 1
    out = np.zeros((docs, 1 << bits), np.float32) if out is None else out[:docs]
    out[:] = 0
    low = TO_LOWER[data].astype(np.uint64)
    row = np.repeat(np.arange(docs, dtype=np.int64), np.diff(ends))
    code = np.zeros(len(data), np.uint64)
    for n in range(1, max(lengths) + 1):
        if len(data) < n:
            break
        code = (code[: len(low) - n + 1] << np.uint64(8)) | low[n - 1 :]
        if n in lengths:
            whole = row[: len(code)] == row[n - 1 :]
            column = ((code + np.uint64(n << 56)) * _MUL) >> np.uint64(64 - bits)
            out.reshape(-1)[((row[: len(code)] << bits) + column.astype(np.int64))[whole]] = 1
    return out


def kernel(p: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Shared n-grams of each text and landmark, normalised to 1 for equal sets; 0 for empty texts."""
    size = lambda m: np.sqrt(np.maximum(m.sum(1), 1))
    return (p @ landmarks.T) / size(p)[:, None] / size(landmarks)[None]


@dataclass
class Kernels:
    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    lengths: tuple[int, ...]
    bits: int

    def scores(self, p: np.ndarray) -> np.ndarray:
        """One column per language: its one-versus-rest regression, a batched product with the landmarks and one with the weights."""
        return kernel(p, self.landmarks) @ self.weights


def krr(p: np.ndarray, langs: list[str], landmarks: int, ridge: float, lengths: tuple[int, ...], bits: int) -> Kernels:
    """Kernel ridge regression of each language against the rest on Nystroem features of `landmarks` texts, dealt over the languages; each of up to 1024 languages has one."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    turn = np.zeros(len(label), int)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    marks = p[np.argsort(turn, kind="stable")[: max(landmarks, min(len(names), 1024))]]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])  # K_mm ** -1/2
    z = kernel(p, marks) @ root
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    beta = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ target)
    return Kernels(names, marks, (root @ beta).astype(np.float32), lengths, bits)


def fit(docs: DataFrame, sample: int = 200, most: int = 10_000, landmarks: int = 128, ridge: float = 0.1, lengths: tuple[int, ...] = (1, 2, 3), bits: int = 14, fold: int = 4, rest: int = 2) -> Kernels | None:
    """Learns from at most `sample` documents of each language and `most` of all, outside the held-out fold, those of the smallest id hashes; languages take turns.

    Ranking goes over ids alone and keeps `sample` rows of a language in each task before the shuffle. The driver
    gets the sets of n-grams of those documents (2**bits bits each). None if no text has a language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(fold, rest))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).orderBy("rank", F.xxhash64("doc_id"), "lang").limit(most).select("doc_id").distinct()
    picked = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # `most` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 18):
            for k in range(0, b.num_rows, 128):
                c = b.slice(k, 128)
                p = presence(*flat(c.column("text")), lengths, bits)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), c.column("lang"), pa.array([x.tobytes() for x in np.packbits(p > 0, axis=1)])], ["doc_id", "lang", "grams"])

    got = picked.mapInArrow(run, "doc_id long, lang string, grams binary").toPandas().sort_values(["doc_id", "lang"])
    if not len(got):
        return None
    p = np.unpackbits(np.frombuffer(b"".join(got["grams"]), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    return krr(p, list(got["lang"]), landmarks, ridge, lengths, bits)


def predict(docs: DataFrame, model: Kernels | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs from its whole text; `und` and 0 where text is null or holds no letter, or nothing was learned."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # `landmarks` rows of 2**bits numbers: bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        room = None if m is None else np.zeros((128, 1 << m.bits), np.float32)
        for b in slices(batches, 1 << 19):
            for k in range(0, b.num_rows, 128):
                c = b.slice(k, 128)
                letters = np.array([t.is_valid and LETTER.search(t.as_py()) is not None for t in c.column("text")], bool)
                if m is None:
                    best, score, letters = np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters), bool)
                else:
                    s = m.scores(presence(*flat(c.column("text")), m.lengths, m.bits, room))
                    best, score = s.argmax(1), np.clip((s.max(1) + 1) / 2, 0, 1)
                lang = [m.langs[i] if ok else "und" for i, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0).astype(float))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, sample: int = 200) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; see fit() and predict(). A row without doc_id is not held out."""
    return predict(docs, fit(docs, sample)).select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")
