"""Vector code compression by exact product quantisation (operator 12).

Components become integers, vectors are cut into parts, and each part gets the index of its codebook's nearest entry. All distances are exact: integers are split into limbs so short
that a float64 matrix product of limbs stays below 2^53, the products are put together in int64, and the first least distance wins. So results don't depend on the order of
rows, partitions or BLAS. A round is one job: each task adds up its vectors by entry, and only these sums, whose number is bounded by the codebooks, are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Largest table of labels that is broadcast, in rows; beyond that the join shuffles.
MAX_LABELS = 200_000


def limb_bits(width: int) -> int:
    """Bits of a limb, so that a sum of width products of two limbs is below 2^53."""
    return (53 - max(1, width).bit_length()) // 2


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, the lowest first; all but the last are not negative."""
    out = []
    while len(a) and (a.max(initial=0) >= 1 << bits or a.min(initial=0) < -(1 << bits)):
        out.append((a & ((1 << bits) - 1)).astype(np.float64))
        a = a >> bits
    return [*out, a.astype(np.float64)]


def products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact dot products of the rows of a and b (int64). Terms may wrap around on the way; the sum fits."""
    bits = bits or limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x, the first of the nearest rows of book and its squared distance."""
    score = (book * book).sum(1) - 2 * products(x, book, bits)
    best = score.argmin(1)
    return best, (x * x).sum(1) + score[np.arange(len(x)), best]


def integers(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """Stored rows vec_id, label, q (array of int: floors of scale times each component) of vectors (vec_id, embedding, and label where there is one), and the width of a part.

    Vectors that are null or hold null or non-finite components take no part. Where lengths differ or don't divide by parts, zeros follow, so that all have one length.
    Raises ValueError if components are so large that squared distances would not fit 64 bits.
    """
    common.narrow_batches(vectors.sparkSession)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), label, v.alias("v")).where(F.col("v").isNotNull() & ~bad)
    seen = kept.agg(F.max(F.size("v")).alias("size"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    width = max(1, -(-(seen["size"] or 0) // parts))
    most = int(scale * (seen["most"] or 0.0)) + 1
    if most >= 1 << 31 or 4 * parts * width * most * most >= 1 << 63:
        raise ValueError(f"components of up to {seen['most']} are too large for exact 64-bit distances at scale {scale}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
            full = np.zeros((len(lists), parts * width), np.int32)
            full[np.arange(parts * width) < sizes[:, None]] = flat
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * parts * width, pa.int32()), pa.array(full.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), made], ["vec_id", "label", "q"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), kept.schema["label"], T.StructField("q", T.ArrayType(T.IntegerType()))])
    return common.store(kept.mapInArrow(run, schema), "integers"), width


def _matrix(b: pa.RecordBatch, parts: int) -> np.ndarray:
    """Rows, parts and positions of q."""
    return b.column("q").flatten().to_numpy().reshape(b.num_rows, parts, -1).astype(np.int64)


def first_books(q: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts, entries and positions: the vectors of the smallest vec_ids, ascending; of an id with several vectors the least. A null id comes last. Fewer ids give fewer entries."""
    ids: list[int] = []
    while len(ids) < entries:  # more than once only where ids repeat
        rest = q.where(F.col("vec_id").isNotNull() if not ids else F.col("vec_id") > ids[-1])
        more = [r["vec_id"] for r in rest.select("vec_id").orderBy("vec_id").limit(entries).collect()]
        if not more:
            break
        ids = sorted({*ids, *more})[:entries]
    found = {r["vec_id"]: r["q"] for r in q.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("q").alias("q")).collect()} if ids else {}
    if len(ids) < entries:
        found |= {None: r["q"] for r in q.where("vec_id IS NULL").agg(F.min("q").alias("q")).collect() if r["q"] is not None}
    rows = [found[i] for i in (*ids, None) if i in found]
    return np.array(rows, np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2) if rows else np.zeros((parts, 0, 1), np.int64)


def improved(q: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry becomes the floor of the mean of the parts that are nearest to it; an entry without any stays."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b, parts)
            for p in range(parts):
                best, _ = nearest(x[:, p], books[p])
                n[p] += np.bincount(best, minlength=entries)
                np.add.at(total[p], best, x[:, p])
        used = np.argwhere(n > 0)
        if len(used):
            sums = pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[n > 0]), sums], ["part", "entry", "n", "sums"])

    each = q.select("q").mapInArrow(run, "part int, entry int, n long, sums array<long>").select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
    rows = each.groupBy("part", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # as many as the codebooks have components
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return out


def fit(q: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, positions) of what integers() gave."""
    books = first_books(q, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = improved(q, books)
    return books


def encode(q: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits for each part) and error (squared distances, summed over parts) of what integers() gave."""
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, error = _matrix(b, parts), np.zeros(b.num_rows, np.int64)
            codes = np.zeros((b.num_rows, parts), np.uint8)
            for p in range(parts):
                codes[:, p], far = nearest(x[:, p], books[p])
                error += far
            digits = codes.tobytes().hex()
            texts = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = T.StructType([*(q.schema[c] for c in ("vec_id", "label")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return q.mapInArrow(run, schema)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([books[p, k] for p, k in enumerate(bytes.fromhex(code))])


def compressed(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over rows of the same label, null ones together) and codebooks_sha256 of each vector that takes part, see integers().

    Repeated rows each count and each give a row. A table without vectors gives an empty result. At most 256 entries.
    """
    q, _ = integers(vectors, scale, parts)
    books = fit(q, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = common.store(encode(q, books), "codes")
    by_label = common.store(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    return common.match(coded, common.small(by_label, MAX_LABELS), ["label"]).withColumn("codebooks_sha256", F.lit(digest))
