"""SimHash near-duplicates by segment popcounts (operator 10).

A fingerprint of 64 bits becomes a point: the number of set bits in each of 32 segments of two bits. The Manhattan distance of two
points never exceeds the Hamming distance of the fingerprints, so fingerprints at most two bits apart lie at most two apart on the grid,
and some grid cell lies at most one from both. Each distinct fingerprint therefore enters its own cell and the neighbours at distance
one; cells with a single fingerprint link nothing and are left. What remains is verified exactly and without forming pairs: within a
cell, a fingerprint visits the bit strings at most one bit from it that belong to the cell; all fingerprints that visit one string (65 at
most) differ pairwise in two bits at most, and any two that differ in one or two bits meet in some string. A star links them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import common

SEED, SHINGLE, BITS, SEGMENT = 42, 3, 64, 2
#: Bits of the low half of each segment, for counting bits in all segments at once.
LOW_HALF = 0x5555555555555555
#: Largest tables that are broadcast, in rows of one or two longs; beyond that the joins shuffle.
MAX_CELLS = MAX_DROPPED = 1_000_000


def fingerprint(text: str | None) -> int:
    """Of one whole text, as a signed 64-bit integer; 0 for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").translate(common.LOWER_BYTES).split()
    if not w:
        return 0
    parts = [b"%b %b %b" % t for t in zip(w, w[1:], w[2:])] if len(w) >= SHINGLE else [b" ".join(w)]
    ones, step = np.zeros(BITS, np.int64), 65_536
    for i in range(0, len(parts), step):
        h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts[i : i + step]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(parts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the whole text) and fp (signed long) of each row; other columns of docs are ignored."""

    common.narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _point(fp: str) -> Column:
    """The number of set bits of each segment, packed like the fingerprint itself."""
    low, high = F.col(fp).bitwiseAND(F.lit(LOW_HALF)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_HALF))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def links(fps: DataFrame) -> DataFrame:
    """Stars over distinct fingerprints (column fp): a and b (b < a), at most two bits apart. Every pair that close is connected by them."""
    point = fps.withColumn("point", _point("fp"))
    # The point packs its coordinates, two bits each (0 to 2): between 0 and 1 the low bit differs, between 1 and 2 both.
    moves = []
    for s in range(BITS // SEGMENT):
        at, one, two = F.shiftrightunsigned("point", SEGMENT * s).bitwiseAND(F.lit(3)), F.lit(_signed(1 << 2 * s)), F.lit(_signed(3 << 2 * s))
        moves += [F.when(at < 2, F.col("point").bitwiseXOR(F.when(at == 0, one).otherwise(two))), F.when(at > 0, F.col("point").bitwiseXOR(F.when(at == 1, one).otherwise(two)))]
    cells = point.select("fp", F.explode(F.array(F.col("point"), *moves)).alias("cell")).where("cell IS NOT NULL")
    shared = common.store(cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("cell"), "cells")
    close = cells.join(common.small(shared, MAX_CELLS), "cell")
    # Bit strings at most one flip from fp whose own point is the cell: fp itself, or a flip in the one segment that differs.
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)]
    strings = close.select("fp", "cell", F.explode(F.array(*flips)).alias("via"))
    met = strings.where(_point("via") == F.col("cell")).select("via", "fp")
    least = F.min("fp").over(Window.partitionBy("via"))
    return met.select(F.col("fp").alias("a"), least.alias("b")).where("b < a").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and root, the smallest node of its component; nodes without edges are absent.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the size of a component even for chains. Every
    round is a join and a minimum by node, stored in the shared folder; only a count and a checksum reach the driver.
    """
    both_ways = lambda x, y: F.inline(F.array(F.struct(F.col(x[0]).alias("a"), F.col(x[1]).alias("b")), F.struct(F.col(y[0]).alias("a"), F.col(y[1]).alias("b"))))
    now = common.store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.select(both_ways("ab", "ba"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(both_ways("bm", "am")).where("a <> b").distinct()
        # Counted as they are written: no job of its own.
        seen = Observation()
        now = common.store(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        row = (seen.get.get("n", 0), seen.get.get("h"))
        if mark == row:
            break
        mark = row
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id, text_hash.

    Fingerprints link at two or fewer differing bits; component_id is the smallest doc_id of the connected group. Null texts and texts without words have
    fingerprint zero, linked like any other. Copies share one node of the graph, whatever their number. Repeated rows each give a row; a null doc_id
    gets a row but is never a component_id unless its whole group has none. Empty docs give an empty result.
    """
    own = common.store(fingerprints(docs), "fingerprints")
    nodes = common.store(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp")))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(by_root, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def dedup(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id. Same columns.

    groups gives doc_id, component_id and text_hash per row. Rows of one group that share that doc_id are reduced to one (with the smallest hash of the text); rows with a null doc_id stay.
    """
    keys = ["doc_id", "text_hash"]
    found = common.store(groups(docs), "groups")
    gone = common.small(common.store(found.where("doc_id <> component_id").select(*keys).distinct(), "dropped"), MAX_DROPPED)
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    kept = keyed.join(gone.withColumnRenamed("text_hash", "__hash"), ["doc_id", "__hash"], "left_anti")
    twice = common.store(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not twice.isEmpty():
        again = common.small(twice, MAX_DROPPED)
        first = Window.partitionBy("doc_id").orderBy("__hash")
        one = kept.join(again, "doc_id", "left_semi").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one)
    return kept.select(*docs.columns)
