"""Repeated lines (operator 13).

Lines are exploded as hashes of their normalised form. A line that stands in several documents stays in the one with the largest doc_id and goes from all others; documents are
put together again by the places of what goes. Counts combine before they are shuffled, so a line in a third of all documents costs no more than another, and only hashes and
places are shuffled; texts are, if the documents that lose lines are too many to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points that a line needs to count, and documents that hold a line which goes.
LEAST_CHARS, LEAST_DOCS = 20, 3
BLANKS = b" \t\n\x0b\x0c\r"
DOC = ["doc_id", "text_hash"]
#: Largest tables that are broadcast, in rows; beyond that the joins shuffle.
MAX_LINES, MAX_DOCS = 500_000, 200_000


def line_hashes(text: str | None, least: int = LEAST_CHARS) -> tuple[list[int], bytes]:
    """Places (from 0) of the lines of a text whose key has least code points, and the keys' 128-bit hashes one after another."""
    import xxhash

    places, digests = [], []
    for k, line in enumerate((text or "").encode("utf-8", "surrogatepass").translate(common.LOWER_BYTES).split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least):
            places.append(k)
            digests.append(xxhash.xxh3_128_digest(key))
    return places, b"".join(digests)


def hashed(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash and at, h1, h2 (arrays: places and hashes of the lines that count) of each row with such lines."""
    common.narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_hashes(t, least) for t in b.column("text").to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(p) for p, _ in found)]), pa.int32())
            h = np.frombuffer(b"".join(d for _, d in found), "<i8").reshape(-1, 2)
            places = pa.array(np.fromiter((p for x, _ in found for p in x), np.int32), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (places, pa.array(h[:, 0]), pa.array(h[:, 1]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *lists], [*DOC, "at", "h1", "h2"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").isNotNull())
    return keyed.mapInArrow(run, "doc_id long, text_hash long, at array<int>, h1 array<long>, h2 array<long>").where(F.size("at") > 0)


def dropped(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_hash and at (places of the lines that go) of each document that loses lines. Documents are told apart by doc_id; rows without one are one document, before all others."""
    own = common.store(hashed(docs, least_chars), "line-hashes")
    each = own.select(*DOC, F.explode(F.arrays_zip("at", "h1", "h2")).alias("l")).select(*DOC, "l.*")
    holders = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    often = each.groupBy("h1", "h2").agg(holders.alias("holders"), F.max("doc_id").alias("keep")).where(F.col("holders") >= least_docs).select("h1", "h2", "keep")
    often = common.small(common.store(often, "repeated-lines"), MAX_LINES)
    gone = each.join(often, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return gone.groupBy(*DOC).agg(F.collect_set("at").alias("at"))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs without the lines that least_docs documents share, but in the last of them, and two more columns (long): n_lines (before) and n_dropped.

    A line's key is the line without white space (ASCII) at its ends, A-Z in lower case. Lines whose key has least_chars code points or more and stands in least_docs documents or more
    stay in the document with the largest doc_id alone, there as often as it has them. Null texts stay null and count as one empty line, as empty texts do. Rows that share a doc_id are
    one document. Empty docs give an empty result; columns called like the new ones are replaced.
    """
    kept = docs.drop("n_lines", "n_dropped")
    gone = common.small(common.store(dropped(kept, least_chars, least_docs), "dropped-lines"), MAX_DOCS).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("at").alias("__at"))
    keyed = kept.withColumn("__own", F.xxhash64("text"))
    joined = keyed.join(gone, keyed["doc_id"].cast("long").eqNullSafe(gone["__doc"]) & (keyed["__own"] == gone["__hash"]), "left").drop("__own", "__doc", "__hash")
    at, names = kept.columns.index("text"), [*kept.columns, "n_lines", "n_dropped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = b.column(at).to_pylist(), b.column(b.num_columns - 1)
            n, lost = np.array([(t or "").count("\n") + 1 for t in texts], np.int64), np.zeros(b.num_rows, np.int64)
            columns = list(b.columns[:-1])
            if places.null_count < b.num_rows:
                for k, gone_at in enumerate(places.to_pylist()):
                    if gone_at is not None:
                        some = set(gone_at)
                        texts[k], lost[k] = "\n".join(x for j, x in enumerate(texts[k].split("\n")) if j not in some), len(some)
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(lost)], names)

    return joined.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
