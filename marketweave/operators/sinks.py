"""Writes as new table states: every function returns what the table holds afterwards. Those at the end are merges for the commits of a stored table, which rewrite touched buckets only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .relational import numbered


def _key(keys: Sequence[str]) -> list:
    return [F.col(k) for k in keys]


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Last write wins: new rows replace old ones of their key; among new ones the largest version (which must be unique then)."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = F.struct("__new", *([version] if version else []))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), order).alias("r")).select("r.*")


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str, seen: Observation | None = None) -> DataFrame:
    """Rows of new with keys that old lacks, the smallest seq of each key; seen counts offered and inserted rows."""
    fresh = new.join(old.select(*keys).distinct(), list(keys), "left_anti")
    one = fresh.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), seq).alias("r")).select("r.*")
    return one.observe(seen, F.count(F.lit(1)).alias("inserted")) if seen is not None else one


def merge_richer(docs: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key from its versions in order of seq: the first id, url and type, the longest title and body (the earlier of equal ones), the largest relevance, the last known dates, the last reason and alias that aren't empty."""
    text = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col(seq))).alias(c)
    last = lambda c, ok: F.max_by(c, F.when(ok, F.col(seq))).alias(c)
    some = [last(c, F.coalesce(F.col(c), F.lit("")) != "") for c in ("reason", "matched_alias") if c in docs.columns]
    return docs.groupBy(*keys).agg(
        *[F.min_by(c, seq).alias(c) for c in ("id", "url", "doc_type") if c in docs.columns and c not in keys], text("title"), text("body"), F.max("relevance_score").alias("relevance_score"),
        last("published_at", F.col("published_at").isNotNull()), F.max_by("collected_at", seq).alias("collected_at"), *some,
    )


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """New children stand for all old ones of the same parent."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def guarded_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """Like upsert, but an old row with is_manual stays unless the new one is manual too or force is set."""
    if force:
        return upsert(old, new, keys)
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*old.columns), F.struct(F.col("is_manual").cast("int"), F.col("__new"))).alias("r")).select("r.*")


def refresh_universe(old: DataFrame, new: DataFrame) -> DataFrame:
    """code, rank, is_active after a refresh: listed stocks are active with their rank or place, all other old ones inactive. new: code, rank, pos (unique)."""
    ranked = numbered(new.select("code", "rank", "pos"), ["pos"], "place").select("code", F.coalesce("rank", F.col("place").cast("int")).alias("new_rank"))
    joined = old.select("code", F.col("rank").alias("old_rank")).join(ranked, "code", "full_outer")
    return joined.select("code", F.coalesce("new_rank", "old_rank").alias("rank"), F.col("new_rank").isNotNull().alias("is_active"))


def long_lines(summaries: DataFrame) -> DataFrame:
    """summary_id, line_no (from 1), text, source_id of summaries with lines (array of text and source_ids); sources once per line."""
    one = summaries.select("summary_id", F.posexplode("lines").alias("p", "line"))
    return one.select("summary_id", (F.col("p") + 1).alias("line_no"), F.col("line.text").alias("text"), F.explode_outer(F.array_distinct("line.source_ids")).alias("source_id"))


def canonical_merge(docs: DataFrame, children: DataFrame, key: str, child: str) -> tuple[DataFrame, DataFrame]:
    """Of documents with one key the newest stays (by collected_at, id); children (column child) point to it, repeated ones go."""
    newest = F.max_by("id", F.struct("collected_at", "id")).over(Window.partitionBy(key))
    mapped = docs.withColumn("__to", newest)
    ids = mapped.select(F.col("id").alias(child), "__to")
    moved = children.join(ids, child, "left").withColumn(child, F.coalesce("__to", child)).drop("__to").dropDuplicates()
    return mapped.where("id = __to").drop("__to"), moved


Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _kept(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One whole row per key: the first or last by order among old rows (__new is 0; columns that only new has are null) and new ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    pick = F.max_by if last else F.min_by
    return both.groupBy(*keys).agg(pick(F.struct(*old.columns), F.struct(*order)).alias("r")).select("r.*")


def upserts(keys: Sequence[str], version: str | None = None) -> Merge:
    """Last write wins, see upsert."""
    return lambda old, new: _kept(old, new, keys, ["__new", *([version] if version else [])], True)


def inserts(keys: Sequence[str], seq: str) -> Merge:
    """Rows of known keys change nothing, of new ones the smallest seq is inserted. A commit's counts tell how many of the offered rows were inserted."""
    return lambda old, new: _kept(old, new, keys, ["__new", seq], False)


def firsts(keys: Sequence[str], order: Sequence[str]) -> Merge:
    """The first row of each key by order (columns of the table, total within a key), whenever it comes: any order of batches gives the same table."""
    return lambda old, new: _kept(old, new, keys, order, False)


def lasts(keys: Sequence[str], order: Sequence[str]) -> Merge:
    """The last row of each key by order, whenever it comes."""
    return lambda old, new: _kept(old, new, keys, order, True)


def guards(keys: Sequence[str], force: bool = False) -> Merge:
    """Manual rows stay unless forced, see guarded_upsert."""
    return lambda old, new: guarded_upsert(old, new.select(*old.columns), keys, force)


def children(parent: str) -> Merge:
    """New children stand for all old ones of their parent. The table's buckets must be dealt by parent."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
        replaced = new.select(parent).distinct().withColumn("__replaced", F.lit(True))
        return both.join(replaced, parent, "left").where("__new = 1 OR __replaced IS NULL").select(*old.columns)

    return merge


def richer(keys: Sequence[str], seq: str) -> Merge:
    """Versions merged into what is stored, see merge_richer: the stored row counts as the first version. The table has no seq."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        first = F.lit(-(1 << 62)).cast("long").alias(seq)
        return merge_richer(old.select("*", first).unionByName(new.select(*old.columns, F.col(seq).cast("long").alias(seq))), keys, seq)

    return merge
