"""Repeated passages by sliding sentence spans (operator 4).

Texts are cut into units: sentences, cut again at words that a rule picks by the word alone, so that a long sentence, or one that a passage enters in its middle, has the
same inner borders wherever it stands. A run begins at each unit and takes as many consecutive ones as it needs for LEAST_WORDS words, two at least. Every run is hashed; of
hashes that several documents hold, the first occurrence over the whole corpus (smallest doc_id, then place) stays, and units that any later occurrence covers are removed, but
for those that the first itself covers (as in a text that repeats one word). A text of fewer words is one run, so short copies are found whole. Characters of scripts without
blanks count as words. What repeats in one document alone (refrains, junk) goes where the caller asks for it, as the registered query does; else it is not a passage that documents share and stays.

Work is shuffled in two steps: counts by the first half of the hash, which combine before the shuffle, then only runs whose half repeats, with whole hashes. So a passage
in a third of all documents costs no more than another, and what is shuffled grows in proportion to the input. Only documents that lose units are rebuilt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words and units that a run needs: shorter ones repeat by chance.
LEAST_WORDS, LEAST_UNITS = 24, 2
#: One in so many (a power of two) kinds of words ends a unit inside a sentence.
INNER_BORDERS = 8
DOC = ["doc_id", "text_hash"]
#: Largest table that is broadcast, in rows; beyond that the join shuffles.
MAX_DOCS = 200_000
BLANKS = np.zeros(256, bool)
BLANKS[list(b" \t\n\x0b\x0c\r")] = True
STOPS, CLOSERS = np.zeros(256, bool), np.zeros(256, bool)
STOPS[list(b".!?")] = True
CLOSERS[list(b"\"')]")] = True
#: Ends of sentences beyond ASCII that take three bytes, as numbers.
WIDE_STOPS = np.array([int.from_bytes(c.encode(), "big") for c in "。！？…।｡"], np.uint32)
#: First bytes of kana and Chinese characters: each of these characters is a word.
UNSPACED = np.zeros(256, bool)
UNSPACED[0xE3:0xEA] = True


def words(raw: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, with blank telling which bytes are white space. A character of a script without blanks is a word of its own."""
    inside = ~blank
    begins = inside & np.append(True, blank[:-1])
    alone = np.flatnonzero(UNSPACED[raw] & inside)
    if len(alone):
        begins[alone] = True
        after = alone + 3
        after = after[after < len(raw)]
        begins[after] |= inside[after]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & np.append(blank[1:] | begins[1:], True)) + 1
    return starts, ends


def borders(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the words behind which a unit ends, the last word among them. raw has letters A-Z lower-cased; words lie between starts and ends.

    A word ends a unit if it ends a sentence, or if a hash of its length and last two bytes picks it.
    """
    last, n = raw[ends - 1], ends - starts
    before = np.where(n > 1, raw[ends - np.minimum(n, 2)], 0)
    stop = STOPS[last] | (CLOSERS[last] & STOPS[before])
    wide = np.flatnonzero((last >= 0x80) & (n >= 3))
    if len(wide):
        code = raw[ends[wide] - 3].astype(np.uint32) << 16 | raw[ends[wide] - 2].astype(np.uint32) << 8 | raw[ends[wide] - 1]
        stop[wide] |= np.isin(code, WIDE_STOPS)
    mixed = (last.astype(np.uint32) | before.astype(np.uint32) << np.uint32(8) | n.astype(np.uint32) << np.uint32(16)) * np.uint32(0x9E3779B1)
    ends_unit = stop | (((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B)) >> np.uint32(16) & np.uint32(INNER_BORDERS - 1) == 0)
    ends_unit[-1:] = True
    return np.flatnonzero(ends_unit)


def run_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (rows of two longs) of the runs that begin at the first, second, ... unit of a text, and how many units each has."""
    import xxhash

    norm = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(common.LOWER_BYTES).split())
    raw = np.frombuffer(norm, np.uint8)
    if not len(raw):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int32)
    starts, ends = words(raw, raw == 32)
    stop = borders(raw, starts, ends)
    if len(starts) < LEAST_WORDS:
        return np.frombuffer(xxhash.xxh3_128_digest(norm), "<i8").reshape(1, 2), np.array([len(stop)], np.int32)
    first = np.append(0, stop[:-1] + 1)
    upto = np.maximum(np.searchsorted(stop, first + LEAST_WORDS - 1), np.arange(len(stop)) + LEAST_UNITS - 1)
    upto = upto[upto < len(stop)]
    view = memoryview(norm)
    digests = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[first[: len(upto)]].tolist(), ends[stop[upto]].tolist())]
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), (upto - np.arange(len(upto)) + 1).astype(np.int32)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and for the runs of each row, by the unit that they begin with: h1, h2 (hash) and n (units)."""
    common.narrow_batches(docs.sparkSession)

    def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [run_hashes(t) for t in b.column("text").to_pylist()]
                h = [lists([x[:, k] for x, _ in found], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *h, lists([n for _, n in found], pa.int32())], [*DOC, "h1", "h2", "n"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").isNotNull())
    return keyed.mapInArrow(run, "doc_id long, text_hash long, h1 array<long>, h2 array<long>, n array<int>")


def repeated(docs: DataFrame, alone: bool = False) -> DataFrame:
    """doc_id, text_hash, at and n (first unit and number of units of spans) of what later occurrences of runs cover in each document that has any.

    Rows alike in doc_id and text count as one document and are treated alike. With alone, runs that repeat in one document only count, too.
    """
    found = common.store(runs(docs), "runs")
    twice = common.store(found.select(F.explode("h1").alias("h1")).groupBy("h1").count().where("count > 1").select("h1"), "repeated-halves")
    each = found.select(*DOC, F.posexplode(F.arrays_zip("h1", "h2", "n")).alias("at", "r")).select(*DOC, "at", F.col("r.h1").alias("h1"), F.col("r.h2").alias("h2"), F.col("r.n").alias("n"))
    some = common.store(each.join(twice, "h1", "left_semi"), "repeated-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "at")
    ends = some.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Stored, so that the join has nothing but shuffles on both sides and a hot hash can be split.
    several = "NOT (first <=> last)" if alone else "NOT (first.doc_id <=> last.doc_id AND first.text_hash = last.text_hash)"
    firsts = common.store(ends.where(several).select("h1", "h2", "first"), "first-runs")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # In the document of the first, what the first covers stays; equal runs have as many units.
    begin = F.when(own, F.greatest("at", F.col("first.at") + F.col("n"))).otherwise(F.col("at"))
    later = some.join(firsts, ["h1", "h2"]).select(*DOC, begin.alias("at"), (F.col("at") + F.col("n") - begin).alias("n")).where("n > 0")
    return later.groupBy(*DOC).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")).mapInArrow(_joined, "doc_id long, text_hash long, at array<int>, n array<int>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins overlapping spans of a document, so that few remain."""
    for b in batches:
        at, n = [], []
        for x, y in zip(b.column("at"), b.column("n")):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            order = np.argsort(x, kind="stable")
            x, end = x[order], np.maximum.accumulate((x + y)[order])
            apart = np.flatnonzero(x[1:] > end[:-1]) + 1
            at.append(x[np.append(0, apart)])
            n.append(end[np.append(apart - 1, len(x) - 1)] - at[-1])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], [*DOC, "at", "n"])


def without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """A text without the units in spans, and how many they are. A unit goes with the white space behind it, the first also with that before it."""
    encoded = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(encoded.translate(common.LOWER_BYTES), np.uint8)
    starts, ends = words(raw, BLANKS[raw])
    stop = borders(raw, starts, ends)
    cuts = np.concatenate([[0], starts[stop[:-1] + 1], [len(raw)]])
    change = np.zeros(len(stop) + 1, np.int64)
    for at, n in spans:
        change[at] += 1
        change[at + n] -= 1
    gone = np.cumsum(change)[:-1] > 0
    kept = [encoded[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~gone)]
    return b"".join(kept).decode("utf-8", "surrogatepass"), int(gone.sum())


def dedup(docs: DataFrame, alone: bool = False) -> DataFrame:
    """docs with repeated passages removed from text, and two more columns: n_removed (units, long) and changed.

    With alone, every occurrence of a run but the first goes, also where one document alone holds them; else such refrains stay.
    Null texts stay null; a text all of whose units repeat earlier ones becomes empty; texts without repeats stay as they are, to the
    byte. Words lie between ASCII white space, and Chinese characters and kana are words themselves. Empty docs give an empty result; doc_id may be null (such rows come last in order). Columns called like the new ones are replaced.
    """
    kept = docs.drop("n_removed", "changed")
    gone = common.store(repeated(kept, alone), "spans")
    key = common.small(gone, MAX_DOCS).select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.arrays_zip("at", "n").alias("__spans"))
    keyed = kept.withColumn("__own", F.xxhash64("text"))
    joined = keyed.join(key, keyed["doc_id"].cast("long").eqNullSafe(key["__doc"]) & (keyed["__own"] == key["__hash"]), "left").drop("__own", "__doc", "__hash")
    at, names = kept.columns.index("text"), [*kept.columns, "n_removed", "changed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, columns, n = b.column("__spans"), b.columns[:-1], np.zeros(b.num_rows, np.int64)
            if spans.null_count < b.num_rows:
                texts = columns[at].to_pylist()
                for k, s in enumerate(spans.to_pylist()):
                    if s is not None:
                        texts[k], n[k] = without(texts[k], [(x["at"], x["n"]) for x in s])
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(n > 0)], names)

    return joined.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("changed", T.BooleanType())]))
