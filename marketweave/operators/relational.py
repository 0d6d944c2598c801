"""Selections, joins, aggregates and windows over the market tables; every order has a total tie-break."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import store

#: Relevance gates by source, then by type; display gates; source weights.
SOURCE_GATES = {"naver_news": 0.56, "naver_finance_research": 0.34, "sec_edgar": 0.12, "opendart": 0.12}
CARD_WEIGHTS = {"news": 0.46, "research": 0.78, "filing": 0.66}


def event_time(df: DataFrame) -> Column:
    """Publication, else collection."""
    return F.coalesce(df["published_at"], df["collected_at"])


def active_universe(stocks: DataFrame, market: str | None = None, codes: Sequence[str] | None = None) -> DataFrame:
    """Active stocks by rank (missing ranks last), then code."""
    kept = stocks.where("is_active")
    kept = kept if market is None else kept.where(F.col("market") == market)
    kept = kept if codes is None else kept.where(F.col("code").isin([c.upper() for c in codes]))
    return kept.orderBy(F.coalesce("rank", F.lit(99999)), "code")


def within_days(df: DataFrame, as_of: Column, days: int, when: Column | None = None) -> DataFrame:
    """Rows whose event day is at most days before the day of as_of: the whole boundary day counts."""
    when = event_time(df) if when is None else when
    return df.where(F.to_date(when) >= F.date_sub(F.to_date(as_of), days))


def changed_since(df: DataFrame, column: str, since: Column) -> DataFrame:
    """Rows changed after a moment."""
    return df.where(F.col(column) > since)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; order must be total."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def latest_with_ties(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """All rows that share the latest value of their key."""
    r = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(column).desc()))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")


def stale(universe: DataFrame, facts: DataFrame, key: str, fact_key: str, seen: str, as_of: Column, hours: float) -> DataFrame:
    """Rows of universe whose newest fact is older than hours, or that have none; adds last_seen."""
    newest = facts.groupBy(F.col(fact_key).alias(key)).agg(F.max(seen).alias("last_seen"))
    old = (F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")) > hours * 3600
    return universe.join(newest, key, "left").where(F.col("last_seen").isNull() | old)


def relevance_gate(source: Column, doc_type: Column) -> Column:
    """Smallest relevance that passes, by source, else by type."""
    src, kind = F.lower(F.trim(source)), F.lower(F.trim(doc_type))
    out = F.when(kind == "news", 0.5).otherwise(0.38)
    for name, gate in SOURCE_GATES.items():
        out = F.when(src == name, gate).otherwise(out)
    return out


def displayable(title: Column, source: Column, doc_type: Column, score: Column, alias: Column) -> Column:
    """Whether a document may be shown: a title of 6 characters and a score that depends on its type, less strict with a matched alias."""
    gate = F.when(F.lower(F.trim(doc_type)) == "report", 0.12).when(F.lower(F.trim(source)) == "sec_edgar", 0.05).when(F.lower(F.trim(source)) == "naver_news", 0.30).otherwise(0.22)
    score = F.coalesce(score, F.lit(0.0))
    eased = F.when(F.coalesce(F.trim(alias), F.lit("")) != "", F.greatest(F.lit(0.08), gate - 0.12)).otherwise(gate)
    return (F.length(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))) >= 6) & (score >= eased)


def source_kind(doc_type: Column, source: Column) -> Column:
    """news, report or filing."""
    kind, src = F.lower(F.trim(doc_type)), F.lower(F.trim(source))
    return F.when(kind.isin("news", "report", "filing"), kind).when(src.rlike("edgar|dart|filing"), "filing").when(src.rlike("research|report|consensus"), "report").otherwise("news")


def card_source_type(doc_type: Column, source: Column) -> Column:
    """news, research or filing."""
    kind, src = F.lower(F.trim(doc_type)), F.lower(F.trim(source))
    return F.when(src.isin("sec_edgar", "opendart") | (kind == "filing"), "filing").when(kind == "report", "research").otherwise("news")


def card_weight(source_type: Column) -> Column:
    out = F.lit(0.4)
    for name, w in CARD_WEIGHTS.items():
        out = F.when(source_type == name, w).otherwise(out)
    return out


def capped_scores(docs: DataFrame, mapped: DataFrame, gate: float = 0.8, cap: float = 0.18) -> DataFrame:
    """All documents; those mapped to another ticker than their own, or to none with score gate, get relevance cap at most and no alias.

    mapped: id, ticker, score.
    """
    joined = docs.join(mapped.select("id", F.when(F.col("score") >= gate, F.col("ticker")).alias("mapped")), "id", "left")
    same = F.coalesce(F.col("mapped") == F.col("stock_code"), F.lit(False))
    return joined.withColumn("relevance_score", F.when(same, F.col("relevance_score")).otherwise(F.least("relevance_score", F.lit(cap)))).withColumn("matched_alias", F.when(same, F.col("matched_alias")).otherwise(F.lit("")))


def contains_any(text: Column, queries: Column) -> Column:
    """Whether a text holds any string of an array, whatever the case."""
    return F.element_at(F.transform(F.array(F.lower(text)), lambda v: F.exists(queries, lambda q: F.contains(v, F.lower(q)))), 1)  # the text is lower-cased once


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit - 1, with has_more and next_offset."""
    some = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = some.withColumn("__n", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows at most
    more = F.max("__n").over(Window.partitionBy(F.lit(1))) > limit
    return numbered.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + limit))).where(F.col("__n") <= limit).drop("__n")


def as_of_previous(df: DataFrame, key: Sequence[str], date: str, value: str) -> DataFrame:
    """Adds previous_ value: that of the newest row of the key with an earlier date, null if there is none. Dates are unique within a key."""
    return df.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(*key).orderBy(date)))


def resolve_refs(digests: DataFrame, refs: str, cards: DataFrame, docs: DataFrame) -> DataFrame:
    """The references of each digest in order, with what is known of their card and document."""
    one = digests.select("digest_id", F.posexplode(refs).alias("pos", "card_id"))
    return one.join(cards, "card_id", "left").join(docs.select(F.col("id").alias("item_id"), "title", "url"), "item_id", "left")


def name_key(name: Column) -> Column:
    """Sector names without what stands in brackets, punctuation and the words for sector and industry."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\([^)]*\)", "")
    return F.regexp_replace(F.regexp_replace(bare, "업종|산업", ""), r"(?U)[^\w]+", "")


def ticker_key(ticker: Column, width: int = 10) -> Column:
    """Without non-word characters, upper case, zeros on the left."""
    return F.lpad(F.upper(F.regexp_replace(ticker, r"\W+", "")), width, "0")


def common_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values that occur with every key."""
    n = df.agg(F.count_distinct(key).alias("n"))
    return df.groupBy(value).agg(F.count_distinct(key).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(value)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with name, the place (from 1, long) of each row by order, within its key if there are keys. order must be total.

    Rows are dealt to tasks by ranges of keys and order, counted by task and key, and numbered within those; what stands before is added up from the counts. So neither the whole
    table nor one large key is ever in one task. The dealt rows are stored, as counts and rows must see the same ranges.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = df.sparkSession.sparkContext.defaultParallelism
    dealt = store(df.repartitionByRange(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys, *by).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__n"))
    if keys:
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))
    else:
        found, total = [], 0
        for x in counts.orderBy("__part").collect():  # a row for each task
            found.append((x["__part"], total))
            total += x["__n"]
        offsets = F.broadcast(df.sparkSession.createDataFrame(found, "__p int, __before long"))
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = dealt.withColumn("__within", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*by)))
    joined = within.join(offsets, on).withColumn(name, F.col("__before") + F.col("__within"))
    return joined.drop("__part", "__p", "__before", "__within", *[f"__k{i}" for i in range(len(keys))])


def first_wins(parts: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Union of ranked lists; of equal keys the first list's row stays, and all get a new rank."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("__list", F.lit(i))
        out = p if out is None else out.unionByName(p)
    one = top_per_key(out, [key], [F.col("__list"), F.col(order)])
    return numbered(one.drop("rank") if order != "rank" else one.withColumnRenamed("rank", "__order"), ["__list", order if order != "rank" else "__order", key], "rank").withColumn("rank", F.col("rank").cast("int")).drop("__list", "__order")


def budget_prefix(cards: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int, most: int = 80) -> DataFrame:
    """Per key, rows in order while their sizes together stay within budget; the first always, most at most."""
    by = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return cards.withColumn("n", F.row_number().over(by)).withColumn("total", total).where(((F.col("total") <= budget) | (F.col("n") == 1)) & (F.col("n") <= most))


def run_cap(df: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """The first cap rows in order; no cap for zero or less."""
    return df if cap <= 0 else df.orderBy(*order).limit(cap)


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int = 12, most: int = 8) -> DataFrame:
    """Adds chunk, from 0: size consecutive rows each, most chunks per key."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("chunk", F.floor((r - 1) / size)).where(F.col("chunk") < most)


def greedy_batches(df: DataFrame, keys: Sequence[str], order: str, size: Column, most_rows: int = 12, most_size: int = 6000) -> DataFrame:
    """Rows packed in order into batches of at most most_rows rows and most_size size (a larger row stands alone): keys, order, size, batch (from 0 in each key). Null sizes count as 0.

    Each task walks its sorted rows once and carries the open batch from one Arrow batch to the next, so a key may have any number of rows; its packing is one walk by nature.
    """
    rows = df.select(*keys, order, F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order, "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, total, number = None, 0, 0, 0
        for b in batches:
            own = list(zip(*(b.column(k).to_pylist() for k in range(len(keys))))) if keys else [()] * b.num_rows
            out = np.zeros(b.num_rows, np.int64)
            for i, (key, s) in enumerate(zip(own, b.column("size").to_pylist())):
                if key != last:
                    last, n, total, number = key, 0, 0, 0
                elif n >= most_rows or total + s > most_size:
                    n, total, number = 0, 0, number + 1
                n, total, out[i] = n + 1, total + s, number
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "batch"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, batch long")
