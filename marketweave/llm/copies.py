"""Near copies by SimHash, checked by the exact Jaccard similarity of word shingles (the near-duplicate stage of the pipeline).

Candidates are texts that the links of operator 10 join: fingerprints at two or fewer differing bits. That radius misses near copies of any length, so further
candidates come from minima: of each text, minima of its shingles under 128 fixed hash functions, in 32 bands of four. Two texts of similarity t agree in a band with probability t^4, so a pair at 0.8 meets in one of the bands but for a chance of 5 in 100,000,000,
while texts that share a passage hardly ever meet, however many have it. Candidates are verified on the whole sets of shingles.

Texts first meet one text of each shared band, its centre: the text that meets most others in its bands, which of a group of near copies is one with the fewest changes. What those
stars leave apart in a band is joined exactly by its rarest shingles: of two sets at 0.8 or more, the rarest shingles of each, a ninth to a fifth of the set, hold a common one, and what
lies behind it in both must be enough. Texts that operator 10 links meet likewise: first the least one of each fingerprint and of its star's, and what that leaves apart among them is joined by its rarest shingles, so every link of operator 10 is checked. A text with so many shingles of its own that they fill this part is at 0.8 to no other and meets none. So a large group of near copies forms
no pairs of its members, unless hundreds of them lie between a ninth and a fifth from one another without any text in their middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

SEED, SHINGLE, LEAST = 42, 5, 0.8
BANDS, ROWS = 32, 4
#: Odd multipliers and offsets of the hash functions.
_draw = np.random.default_rng(SEED)
FACTORS, OFFSETS = (_draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: Largest tables that are broadcast, in rows; beyond that the joins shuffle.
MAX_NEEDED = 200_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Ascending different hashes of the runs of size words of one whole text; a shorter text is one run, so texts without words are alike."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").translate(common.LOWER_BYTES).split()
    parts = zip(*(w[i:] for i in range(size))) if len(w) >= size else [w]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts), np.uint64))


def _signature(s: np.ndarray) -> int:
    import xxhash

    return simhash._signed(xxhash.xxh64_intdigest(s.tobytes(), SEED))


def band_keys(s: np.ndarray) -> list[int]:
    """A key of each band of minima of a set of shingles."""
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i : i + 1024, None] * FACTORS + OFFSETS).min(0))
    return [simhash._signed(xxhash.xxh64_intdigest(x.tobytes(), k)) for k, x in enumerate(least.reshape(BANDS, ROWS))]


def bands(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, sig (hash of the set of shingles), n (its size), keys (of the bands) and fp (fingerprint by operator 10) of each row."""
    common.narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sets = [shingles(t, size) for t in texts]
            made = [pa.array([_signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array([simhash.fingerprint(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *made], ["doc_id", "text_hash", "sig", "n", "keys", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_hash long, sig long, n int, keys array<long>, fp long")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """sig and all its shingles, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sig", "s"])

    return docs.select("text").mapInArrow(run, "sig long, s array<long>").dropDuplicates(["sig"])


def _least(n: Column, least: float) -> Column:
    """Fewest common members of two sets of n members together."""
    return F.ceil(least / (1 + least) * n - 1e-9)


def rare_pairs(sets: DataFrame, roots: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs of sig (a < b), among them all of similarity least or more, of sets (sig, s) whose roots (sig, root; one row each) differ.

    Rows of a shingle are joined but for those of its most frequent root among themselves, so a group that is connected already costs nothing.
    """
    each = sets.join(roots.select("sig"), "sig", "left_semi").select("sig", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    common_ = each.join(often, "shingle")
    of = Window.partitionBy("sig")
    # Shingles that no other set has come first, and are only counted.
    placed = common_.withColumn("pos", F.col("n") - F.count("*").over(of) + F.row_number().over(of.orderBy("often", "shingle")))
    front = placed.where(F.col("pos") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select("sig", "n", "shingle", "pos").join(roots, "sig")
    front = common.store(front, "rare-shingles")
    by_root = front.groupBy("shingle", "root").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    front = front.join(by_root.select("shingle", F.col("top.root").alias("major")), "shingle")
    left = front.where("root <> major").select("shingle", F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("root").alias("root_a"))
    k = _least(F.col("n_a") + F.col("n"), least)
    room = (F.col("pos_a") <= F.col("n_a") - k + 1) & (F.col("pos") <= F.col("n") - k + 1) & (1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n") - F.col("pos")) >= k)
    alike = (F.least("n_a", "n") >= least * F.greatest("n_a", "n") - 1e-9) & (F.col("root_a") != F.col("root")) & room
    met = left.join(front.withColumnRenamed("shingle", "__s"), (F.col("shingle") == F.col("__s")) & alike)
    return met.select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct()


def fingerprint_groups(one: DataFrame) -> DataFrame:
    """key, sig, least of sets (sig, fp; a row for each fingerprint of a set): those of one fingerprint, and with them those that a star of operator 10 links to it. least is the least set of the fingerprint itself.

    Any two different sets with fingerprints at two bits or fewer share a key. Groups of a single set are left.
    """
    least = common.store(one.groupBy(F.col("fp").alias("key")).agg(F.min("sig").alias("least")), "fingerprints")
    stars = common.store(simhash.links(least.select(F.col("key").alias("fp"))).select(F.col("a").alias("fp"), F.col("b").alias("key")), "fingerprint-stars")
    every = one.select(F.col("fp").alias("key"), "sig").unionByName(one.join(stars, "fp").select("key", "sig"))
    shared = every.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("key")
    return every.join(shared, "key").distinct().join(least, "key")


def fingerprint_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of sig (a, b) of what fingerprint_groups() gave, or of sets (sig, fp): each set meets the least one of each of its groups."""
    found = groups if "least" in groups.columns else fingerprint_groups(groups)
    return found.where("sig <> least").select(F.col("sig").alias("a"), F.col("least").alias("b"))


def links(docs: DataFrame, own: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Pairs of sig (a, b) that connect every pair of similarity least or more among the candidates (all that share a band or are linked by operator 10), and no others. own is what bands() gave for docs.

    What stars link comes as each text with the root of its group, so that components() finds these groups settled.
    """
    one = common.store(own.groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.collect_set("fp").alias("fps"), F.min(F.struct("doc_id", "text_hash")).alias("d")), "signatures")
    posts = one.select("sig", "n", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    posts = common.store(posts.join(shared, "key"), "shared-bands")
    met = common.store(posts.groupBy("sig").agg(F.sum(F.floor(F.log2("held"))).alias("met")), "met")
    centres = posts.join(met, "sig").groupBy("key").agg(F.max(F.struct("met", "sig", "n")).alias("c")).select("key", F.col("c.sig").alias("b"), F.col("c.n").alias("n_b"))
    fingers = common.store(fingerprint_groups(one.select("sig", F.explode("fps").alias("fp"))), "fingerprint-groups")
    either = met.select("sig").unionByName(fingers.select("sig")).distinct()
    needed = common.small(common.store(one.join(either, "sig", "left_semi").select("d.doc_id", "d.text_hash"), "needed"), MAX_NEEDED)
    sets = common.store(_sets(common.match(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), needed, ["doc_id", "text_hash"], "left_semi"), size), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of different pairs (a, b) that link."""
        a, b = sets.select(F.col("sig").alias("a"), F.col("s").alias("s")), sets.select(F.col("sig").alias("b"), F.col("s").alias("t"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("s", "t")).alias("k"), (F.size("s") + F.size("t")).alias("n"))
        return both.where(F.col("k") * (1 + least) >= least * F.col("n") - 1e-9).select("a", "b")

    near = posts.join(centres, "key").where(F.col("sig") != F.col("b")).where(F.least("n", "n_b") >= least * F.greatest("n", "n_b") - 1e-9)
    stars = common.store(linked(near.select(F.col("sig").alias("a"), "b").unionByName(fingerprint_pairs(fingers)).distinct()), "stars")
    roots = simhash.components(stars)
    rooted = posts.select("key", "sig").unionByName(fingers.select("key", "sig")).join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("key", "sig", F.coalesce("root", "sig").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    apart = common.store(rooted.join(mixed, "key").select("sig", "root").distinct(), "apart")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked(rare_pairs(sets, apart, least)))


def groups(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Per row of docs: doc_id, component_id (the smallest doc_id of its connected group; null where a group has none) and text_hash.

    Texts link where the sets of their runs of size words have a Jaccard similarity of least or more. Null texts and texts without words are alike.
    Repeated rows each give a row; empty docs give an empty result. The number of bands is meant for a similarity of 0.8; lower ones are met with less certainty.
    """
    own = common.store(bands(docs, size), "bands")
    roots = simhash.components(links(docs, own, size, least))
    joined = own.select("doc_id", "text_hash", "sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least_id = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least_id, "root").select("doc_id", "component_id", "text_hash")
