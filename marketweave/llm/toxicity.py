"""Toxicity (operator 5): a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the different hashed n-grams of 3 to 5 characters (code points, A-Z lower-cased) of its whole text. Each counts r, the log of the ratio
of its smoothed shares in toxic and other training documents; a logistic regression weighs the scaled features. n-grams whose |r| is small say little and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZES, HASH_BITS = (3, 4, 5), 20


@dataclass(frozen=True)
class Training:
    """per_class and max_bytes bound the sample that one task learns from; the other values steer the fit."""

    per_class: int = 1500
    max_bytes: int = 48_000_000
    smoothing: float = 1.0
    least_docs: int = 5
    least_ratio: float = 1.5
    decay: float = 1e-3
    steps: int = 120
    rate: float = 0.05


def grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the whole text, repeats included; the text stands between two blanks."""
    code = np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    b = np.where((code >= 65) & (code <= 90), code + np.uint32(32), code) * np.uint32(0x9E3779B1)
    h, out = b, []
    for n in range(2, SIZES[-1] + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x85EBCA6B) + b[n - 1 :]
        if n in SIZES:
            x = h ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((x ^ (x >> np.uint32(12))) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each hash: regression weight times log-count ratio
    bias: float

    def score(self, text: str | None) -> float:
        g = grams(text)
        g = np.unique(g[self.weight[g] != 0])
        return float(_sigmoid(np.float64(self.weight[g].sum(dtype=np.float64) + self.bias)))


def fit(texts: list[str], y: list[int], how: Training) -> Model:
    """On labelled texts. Without both labels among them the score is constant: the label that there is, or 0."""
    n = 1 << HASH_BITS
    target = np.asarray(y, float)
    if len(set(y)) < 2:
        return Model(np.zeros(n, np.float32), 30.0 if y and y[0] == 1 else -30.0)
    pos, neg = np.zeros(n), np.zeros(n)
    for t, label in zip(texts, y):
        (pos if label else neg)[np.unique(grams(t))] += 1
    p, q = pos + how.smoothing, neg + how.smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(pos + neg < how.least_docs) | (np.abs(ratio) < how.least_ratio)] = 0
    sets = [k[ratio[k] != 0] for k in (np.unique(grams(t)) for t in texts)]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(k) for k in sets])
    used, col = np.unique(np.concatenate(sets), return_inverse=True)
    col = col.astype(np.int32)
    x = ratio[used][col]
    w, b = np.zeros(len(used)), 0.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, how.steps + 1):
        err = (_sigmoid(np.bincount(row, weights=w[col] * x, minlength=len(sets)) + b) - target) / len(sets)
        grad = np.append(np.bincount(col, weights=err[row] * x, minlength=len(used)) + how.decay * w, err.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        step = how.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    full = np.zeros(n, np.float32)
    full[used] = w * ratio[used]
    return Model(full, float(b))


def _fitted(docs: DataFrame, labels: DataFrame, how: Training) -> Model:
    """The model of the labelled sample among docs; it is fitted in a task, and only its weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))))
        model = fit([t for _, t, _ in rows], [y for *_, y in rows], how)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])

    sample = common.labelled_sample(docs, labels, "toxic", ~held_out(), how.per_class, how.max_bytes)
    found = sample.repartition(1).mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(found["weight"], np.float32), found["bias"]) if found else fit([], [], how)


def held_out():
    """Rows that are never learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """docs with two more columns, __score (double) and __held_out; the score sees the whole text and nothing else.

    Null and empty texts get the score of a text without n-grams but blanks. labels with null or other values than 0 and 1 are ignored; with
    one label or none the score is constant. Repeated rows score alike. Empty docs give an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels, how))
    keyed = docs.withColumn("__held_out", held_out())

    common.narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            yield b.append_column("__score", pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64()))

    return keyed.mapInArrow(run, T.StructType([*keyed.schema.fields, T.StructField("__score", T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from 0.5)."""
    found = score(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score stays below 0.5; same columns."""
    return score(docs, labels).where("__score < 0.5").select(*docs.columns)
