"""Operator 3, toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of n-grams, and cells that they are hashed to.
LENGTHS = (3, 4, 5)
CELLS = 1 << 20
#: Labelled rows of each class that are learned from at most, those of the smallest hash: bounds what the driver holds.
ROWS_A_CLASS = 2000
#: Characters of them of each class at most, in that order, a longer text being left out: bounds what the driver holds in
#: bytes, at about 24 a character.
CHARS_A_CLASS = 8_000_000
#: Rows that an n-gram must be in to count, and the log-count ratio from which it does: nearer to zero it adds nothing.
LEAST_ROWS, LEAST_RATIO = 3, 0.7
STEPS, RATE, PENALTY = 100, 0.05, 1e-4
#: A text is predicted toxic from this score.
TOXIC = 0.3
HELD_OUT = 2

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@cache
def _owners() -> np.ndarray:
    return np.zeros(CELLS, np.int32)


def grams(text: str) -> np.ndarray:
    """The distinct cells of a whole text's n-grams (lower case, over code points, padded by a space on each side), in no
    particular order but always the same one. The time is that of the text's length: a table of owners, kept by the
    process and never cleared, tells which of equal cells is the last."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, hashed = [], np.zeros(len(code), np.uint64)
    for k in range(1, max(LENGTHS) + 1):
        n = len(code) - k + 1
        if n <= 0:
            break
        hashed = (hashed[:n] * np.uint64(1_000_003) + code[k - 1 :]) * np.uint64(0x2545F4914F6CDD1D)
        if k in LENGTHS:
            parts.append(((hashed * _MULTIPLIER) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64))
    if not parts:
        return np.zeros(0, np.int64)
    cells, owners = np.concatenate(parts), _owners()
    place = np.arange(len(cells), dtype=np.int32)
    owners[cells] = place
    return cells[owners[cells] == place]


@dataclass(frozen=True)
class Model:
    """weights: of each cell, log-count ratio included; a text's score is the logistic of their sum and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[cells].sum(), -35, 35))))


def train(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """A model from the cells of labelled texts; share: of toxic rows among all that may be learned from, however many
    of each class were picked. With a single class, or none, every score is that share."""
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(CELLS, np.float32), bias)
    toxic = labels > 0
    p, q = np.ones(CELLS), np.ones(CELLS)
    for cells, bad in zip(rows, toxic, strict=True):
        (p if bad else q)[cells] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    kept = (p + q - 2 >= LEAST_ROWS) & (np.abs(ratio) >= LEAST_RATIO)
    used, number = np.flatnonzero(kept), np.cumsum(kept, dtype=np.int32) - 1
    columns = [number[cells[kept[cells]]] for cells in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in columns])
    column, ratio = np.concatenate(columns), ratio[used]
    scaled = ratio[column]
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())
    w, b = np.zeros(len(used)), bias
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=w[column] * scaled, minlength=len(rows)) + b
        off = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - toxic)
        g = np.bincount(column, weights=off[row] * scaled, minlength=len(used)) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * off.sum(), 0.999 * vb + 0.001 * off.sum() ** 2
        b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(CELLS, np.float32)
    out[used] = w * ratio
    return Model(out, float(b))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents that aren't held out: ROWS_A_CLASS of each class at most, by the hash of the id.

    Only ids are ordered; the picked ids, of that bounded number, are broadcast to find the texts, of which the first in
    that order are taken up to CHARS_A_CLASS, and each comes to the driver as its distinct cells. Null labels and ids are
    left out; of a repeated id the least text counts, null and empty being one; other columns are ignored. Without labels
    of both classes, as with empty tables, all scores are equal. The same rows give the same model."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    pick = [known.where(F.col("toxic") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_A_CLASS) for k in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick[0].unionByName(pick[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    texts = texts.where(F.char_length("text") <= CHARS_A_CLASS).withColumn("chars", F.sum(F.char_length("text")).over(so_far)).where(F.col("chars") <= CHARS_A_CLASS).drop("chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [grams(t.as_py() or "").astype(np.int32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(cells, pa.binary())], ["doc_id", "toxic", "cells"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, toxic int, cells binary").collect())
    return train([np.frombuffer(r[2], np.int32) for r in rows], np.array([float(r[1]) for r in rows]), share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text): whole texts, one pass, no shuffle.

    A null or empty text gets a score too, that of its padding alone; repeated rows are scored each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            score = np.array([model.score(grams(t.as_py() or "")) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text), learned from labels (doc_id, toxic).

    See fit() and scored(): null and empty texts, ties and repeated rows are scored each, very long texts whole; empty
    docs give no rows, empty labels equal scores; other columns are ignored."""
    return scored(docs, fit(docs, labels))
