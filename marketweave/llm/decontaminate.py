"""Benchmark decontamination over a positional inverted index (operator 1, DataFrame functions only).

The index is a Parquet table in the shared folder: one posting ``(term, doc_id, text_hash, pos)`` for each occurrence of a test
term in a document, sorted by term within its files, so that a lookup of a few terms skips most row groups. It is sharded by document:
a posting stays in the task that read its text, hence building it shuffles nothing. The empty term holds each document's length.

A phrase lookup starts from the rarest terms. Lists of the rarest and of the second rarest term of each window are intersected after
their offsets in the phrase are subtracted; only alignments (document, phrase, shift) that survive are probed for the other terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract: ASCII letters and digits and everything beyond ASCII belong to words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "text_hash"]
ITEM = ["item_id", "item_hash"]
#: Largest tables that are broadcast, in rows; beyond that the joins shuffle.
MAX_TERMS, MAX_DOCS = 200_000, 200_000


def words(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrases(items: DataFrame) -> DataFrame:
    """A row per word of each different item: item_id, item_hash, n (its words), q (from 0), term. Items without words give none."""
    one = items.select("item_id", F.xxhash64("text").alias("item_hash"), words(F.col("text")).alias("w")).dropDuplicates(ITEM)
    return one.select(*ITEM, F.size("w").alias("n"), F.posexplode("w").alias("q", "term"))


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Stores the postings of docs and returns them: term, doc_id, text_hash, pos (from 0).

    vocabulary (column term) limits the index to terms that are ever looked up. Each row also gives a posting of the empty term, whose
    pos is its number of words. Rows that share doc_id stay apart by a hash of the text; repeated rows repeat their postings.
    """
    all_terms = F.concat(words(F.col("text")), F.array(F.lit("")))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(all_terms).alias("pos", "term")).select("term", *DOC, "pos")
    if vocabulary is not None:
        known = vocabulary.select("term").union(docs.sparkSession.sql("SELECT '' AS term")).distinct()
        found = found.join(common.small(known, MAX_TERMS), "term")
    return common.store(found.sortWithinPartitions("term", "doc_id", "pos"), "postings")


def _rarest(words_of: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """For each window that can occur at all, the offsets and terms of its two rarest words: item, q1, term1, q2, term2 (the last two null in windows of one word)."""
    freq = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("f"))
    known = words_of.join(freq, "term", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("q") - (window - 1)), F.least(F.col("q"), F.greatest(F.lit(0), F.col("n") - window))
    placed = known.withColumn("s", F.explode(F.sequence(first, last)))
    order = Window.partitionBy(*ITEM, "s").orderBy("f", "q")
    ranked = placed.select(*ITEM, "s", "q", "term", "f", F.row_number().over(order).alias("r")).where("r <= 2")
    one = ranked.groupBy(*ITEM, "s").agg(
        F.min(F.when(F.col("r") == 1, F.struct("q", "term", "f"))).alias("a"), F.min(F.when(F.col("r") == 2, F.struct("q", "term"))).alias("b")
    )
    return one.where("a.f > 0").select(*ITEM, F.col("a.q").alias("q1"), F.col("a.term").alias("term1"), F.col("b.q").alias("q2"), F.col("b.term").alias("term2")).distinct()


def alignments(index: DataFrame, words_of: DataFrame, window: int) -> DataFrame:
    """Candidate shifts of an item against a document in which the two rarest terms of some window stand at their offsets: doc, item, shift.

    shift is negative where a document begins inside an item.
    """
    anchors = common.store(_rarest(words_of, index, window), "anchors")
    firsts = common.small(anchors, MAX_TERMS)
    one = index.withColumnRenamed("term", "term1").join(firsts, "term1").withColumn("shift", F.col("pos") - F.col("q1")).drop("pos", "term1")
    alone = one.where("term2 IS NULL").select(*DOC, *ITEM, "shift")
    seconds = index.join(common.small(anchors.where("term2 IS NOT NULL").select(F.col("term2").alias("term")).distinct(), MAX_TERMS), "term")
    both = one.where("term2 IS NOT NULL").select(*DOC, *ITEM, "shift", F.col("term2").alias("term"), (F.col("shift") + F.col("q2")).alias("pos"))
    met = common.match(both, seconds.distinct(), [*DOC, "term", "pos"])
    return alone.unionByName(met.select(*DOC, *ITEM, "shift")).distinct()


def phrase_matches(index: DataFrame, words_of: DataFrame, window: int = 10) -> DataFrame:
    """Every longest stretch of an item, of window words at least (or all of a shorter item), that a document has word for word.

    Returns doc_id, text_hash, item_id, item_hash, shift, first and last (word positions in the document, inclusive).
    """
    cand = common.store(alignments(index, words_of, window), "alignments")
    near = index.where("term <> ''")
    near = common.match(near, common.small(cand.select(*DOC).distinct(), MAX_DOCS), DOC, "left_semi")
    probe = common.match(cand, words_of, ITEM).withColumn("pos", F.col("shift") + F.col("q"))
    hit = common.match(probe, near.distinct(), [*DOC, "term", "pos"]).select(*DOC, *ITEM, "shift", "n", "q", "pos")
    run = F.col("q") - F.row_number().over(Window.partitionBy(*DOC, *ITEM, "shift").orderBy("q"))
    runs = hit.withColumn("run", run).groupBy(*DOC, *ITEM, "shift", "n", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n"))).drop("run", "n")


def proximity_matches(index: DataFrame, words_of: DataFrame, slop: int) -> DataFrame:
    """Places where all terms of an item stand together: doc_id, text_hash, item_id, item_hash, pos.

    pos is an occurrence of the item's rarest term with an occurrence of each other different term at most slop words away, in any order.
    """
    terms = words_of.select(*ITEM, "term").distinct()
    freq = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("f"))
    known = terms.join(freq, "term", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rare = known.groupBy(*ITEM).agg(F.min(F.struct("f", "term")).alias("r"), F.count("*").alias("k")).where("r.f > 0").select(*ITEM, "k", F.col("r.term").alias("term"))
    block = slop + 1
    start = index.join(rare, "term").select(*DOC, *ITEM, "k", "term", F.col("pos").alias("at")).distinct()
    others = common.match(start.withColumnRenamed("term", "rarest"), terms, ITEM).where("term <> rarest")
    cells = others.withColumn("cell", F.explode(F.array(*[F.floor(F.col("at") / block) + d for d in (-1, 0, 1)])))
    posts = index.where("term <> ''").withColumn("cell", F.floor(F.col("pos") / block))
    met = common.match(cells, posts, [*DOC, "term", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    full = met.groupBy(*DOC, *ITEM, "at", "k").agg(F.count_distinct("term").alias("c")).where("c = k - 1").select(*DOC, *ITEM, F.col("at").alias("pos"))
    return full.unionByName(start.where("k = 1").select(*DOC, *ITEM, F.col("at").alias("pos")))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    n_hit counts words inside an occurrence of a window of an item, n_items the different item_ids (null ones don't count) with such windows.
    Null or empty texts have no words and no hits; repeated rows each give a row with equal figures; an empty benchmark hits nothing,
    empty docs give an empty result; further columns of either table are ignored. doc_id may be null.
    """
    words_of = common.store(phrases(items), "phrases")
    index = build_index(docs, words_of.select("term").distinct())
    found = phrase_matches(index, words_of, window)
    per_word = found.select(*DOC, "item_id", F.explode(F.sequence("first", "last")).alias("pos"))
    hits = per_word.groupBy(*DOC).agg(F.count_distinct("pos").alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    lengths = index.where("term = ''").select(*DOC, F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("ids"), F.expr("array()").cast("array<string>"))
    return common.match(lengths, hits, DOC, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), "text_hash",
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """docs without rows that hold a window of an item. Same columns; a row whose doc_id is null is judged like any other."""
    bad = common.store(contamination(docs, items, window).where("contaminated").select(*DOC).distinct(), "contaminated")
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    gone = common.small(bad, MAX_DOCS).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["__id"]) & (keyed["__text_hash"] == gone["__hash"]), "left_anti").drop("__text_hash")
