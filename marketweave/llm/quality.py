"""Quality (operator 3): a byte-level convolutional network in numpy.

The whole text is cut into overlapping chunks of 128 bytes, so that every run of WIDTH bytes lies within one. Learned filters slide over each chunk
(a filter is a table of values by place and byte, which is a one-hot convolution), a rectifier and a maximum over the chunk follow. The largest and the mean
of the chunks' values enter one logistic unit. Training back-propagates through the winning places only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS, WIDTH, CHUNK = 16, 6, 128
STEP = CHUNK - WIDTH + 1
#: Chunks that are filtered at once; bounds memory for texts of any length.
BLOCK = 1024


@dataclass(frozen=True)
class Training:
    """per_class and max_bytes bound the sample that one task learns from; the other values steer the fit."""

    per_class: int = 1000
    max_bytes: int = 32_000_000
    epochs: int = 4
    batch: int = 16
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


def chunks(raw: bytes) -> np.ndarray:
    """All overlapping chunks of the text as rows; the last is filled up with zero bytes."""
    k = max(1, -(-max(0, len(raw) - WIDTH + 1) // STEP))
    padded = np.zeros(k * STEP + WIDTH - 1, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    weight: np.ndarray  # of the maxima, then of the means
    shift: float

    def filtered(self, rows: np.ndarray) -> np.ndarray:
        out = self.table[0][rows[:, :STEP]]
        for k in range(1, WIDTH):
            out += self.table[k][rows[:, k : k + STEP]]
        return out

    def score(self, text: str | None) -> float:
        rows = chunks(_bytes(text))
        top, total = np.zeros(FILTERS), np.zeros(FILTERS)
        for i in range(0, len(rows), BLOCK):
            a = np.maximum(self.filtered(rows[i : i + BLOCK]).max(1) + self.bias, 0)
            top, total = np.maximum(top, a.max(0)), total + a.sum(0, dtype=np.float64)
        z = np.concatenate([top, total / len(rows)]) @ self.weight + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str], y: list[int], how: Training) -> Model:
    """On whole labelled texts and a short passage of each. Without both labels the score is constant: the label that there is, or 0.5."""
    rng = np.random.default_rng(how.seed)
    if len(set(y)) < 2:
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0 if not y else 30.0 if y[0] else -30.0)
    docs, target = [_bytes(t) for t in texts], list(y)
    for raw, label in zip(list(docs), y):  # short texts are rare among the labelled ones
        n = int(rng.integers(12, 200))
        at = int(rng.integers(0, max(1, len(raw) - n)))
        docs.append(raw[at : at + n])
        target.append(label)
    goal = np.asarray(target, np.float32)
    m = Model((rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(2 * FILTERS) * 0.1), 0.0)
    moments = [[np.zeros_like(p) for p in (m.table, m.bias, m.weight, np.zeros(1))] for _ in range(2)]
    t = 0
    for _ in range(how.epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), how.batch):
            take = order[i : i + how.batch]
            parts = [chunks(docs[j]) for j in take]
            n = np.array([len(p) for p in parts])
            rows, start, doc = np.concatenate(parts), np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n)
            win, best = [], []
            for s in range(0, len(rows), BLOCK):
                out = m.filtered(rows[s : s + BLOCK])
                win.append(out.argmax(1))
                best.append(np.take_along_axis(out, win[-1][:, None, :], 1)[:, 0, :])
            at, a = np.concatenate(win), np.maximum(np.concatenate(best) + m.bias, 0)
            top = np.maximum.reduceat(a, start)
            f = np.concatenate([top, np.add.reduceat(a, start) / n[:, None]], 1)
            err = (1 / (1 + np.exp(-np.clip(f @ m.weight + m.shift, -60, 60))) - goal[take]) / len(take)
            back = err[:, None] * m.weight[None]
            wins = (a == top[doc]).astype(np.float32)
            ga = (back[:, FILTERS:] / n[:, None])[doc] + wins * (back[:, :FILTERS] / np.add.reduceat(wins, start))[doc]
            ga = np.where(a > 0, ga, 0)
            gt, each = np.zeros_like(m.table), np.broadcast_to(np.arange(FILTERS), ga.shape)
            for k in range(WIDTH):
                byte = rows[np.arange(len(rows))[:, None], at + k].astype(np.int64)
                gt[k] = np.bincount((byte * FILTERS + each).ravel(), weights=ga.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            t += 1
            grads = (gt, ga.sum(0), f.T @ err + how.decay * m.weight, np.array([err.sum()]))
            for p, (name, g) in enumerate(zip(("table", "bias", "weight", "shift"), grads)):
                moments[0][p] = 0.9 * moments[0][p] + 0.1 * g
                moments[1][p] = 0.99 * moments[1][p] + 0.01 * g**2
                step = how.rate * (moments[0][p] / (1 - 0.9**t)) / (np.sqrt(moments[1][p] / (1 - 0.99**t)) + 1e-8)
                now = getattr(m, name) - (step if name != "shift" else float(step[0]))
                setattr(m, name, now.astype(np.float32) if name in ("table", "bias") else now)
    return m


def held_out():
    """Rows that are never learnt from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _fitted(docs: DataFrame, labels: DataFrame, how: Training) -> Model:
    """The model of the labelled sample among docs; it is fitted in a task, and only its weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y"))))
        m = fit([t for _, t, _ in rows], [y for *_, y in rows], how)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (m.table, m.bias, m.weight)] + [pa.array([m.shift])], ["table", "bias", "weight", "shift"])

    sample = common.labelled_sample(docs, labels, "quality", ~held_out(), how.per_class, how.max_bytes)
    found = sample.repartition(1).mapInArrow(run, "table binary, bias binary, weight binary, shift double").first()
    if not found:
        return fit([], [], how)
    table, bias, weight = (np.frombuffer(found[c]) for c in ("table", "bias", "weight"))
    return Model(table.reshape(WIDTH, 256, FILTERS).astype(np.float32), bias.astype(np.float32), weight, found["shift"])


def scores(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from 0.7). The score sees the whole text and nothing else.

    Null and empty texts are scored as one chunk of zero bytes. labels with null or other values than 0 and 1 are ignored; with one label or none the
    score is constant. Repeated rows score alike; empty docs give an empty result; other columns are ignored.
    """
    common.narrow_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            s = pa.array([m.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), s], ["doc_id", "held_out", "score"])

    kept = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
