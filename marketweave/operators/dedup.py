"""Duplicates of documents and titles, the title graph, and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from . import relational as r

WEEK_S = 7 * 24 * 3600
#: Words of events that make two headlines of one week the same story.
EVENT_WORDS = ["주주총회", "주총", "경영권", "지배구조", "거버넌스", "실적", "가이던스", "수주", "규제", "소송", "제재", "합병", "인수", "공급망", "배당", "증자"]
#: Rows that a feed takes from its newest documents, for each row that it shows.
DEPTH = 4
#: Most ids of all feeds together that are broadcast; beyond that the join shuffles.
MOST_IDS = 1_000_000


def newest(docs: DataFrame, feed: str, limit: int) -> DataFrame:
    """The newest documents (event_time, then id) of each feed, DEPTH times as many as it will show. Titles are compared and ranked among these alone, as the cut is part of a feed."""
    by = Window.partitionBy(feed).orderBy(F.col("event_time").desc(), F.col("id").desc())
    top = lambda rows: rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= DEPTH * limit).drop("__n")
    # Keys alone are sorted, and whole rows meet the few that are left before they are moved or joined. Rows that share an id are cut once more.
    ids = top(docs.select(feed, "id", "event_time")).select(F.col("id").alias("__id")).distinct()
    ids = F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids
    return top(docs.join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi"))


def identity_key(source: Column, url: Column, title: Column, published_at: Column) -> Column:
    """source, address and day; the title stands in for a missing address."""
    day = F.coalesce(F.date_format(published_at, "yyyy-MM-dd"), F.lit("unknown-day"))
    bare = F.left(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"(?U)\W+", ""), F.lit(120))
    address = t.normalize_url(url)
    return F.concat_ws("|", source, F.when(address != "", address).otherwise(F.concat(F.lit("title:"), bare)), day)


def first_of_identity(docs: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first document of each identity key."""
    key = identity_key(F.col("source"), F.col("url"), F.col("title"), F.col("published_at"))
    r = F.row_number().over(Window.partitionBy("__key").orderBy(*order))
    return docs.withColumn("__key", key).withColumn("__r", r).where("__r = 1").drop("__key", "__r")


def content_duplicates(items: DataFrame) -> DataFrame:
    """Items (item_id, url_hash, content_hash, arrival) after the first of each address is kept: adds duplicate_of (the latest earlier item of the same content) and status."""
    r = F.row_number().over(Window.partitionBy("url_hash").orderBy("arrival", "item_id"))
    kept = items.withColumn("__r", r).where("__r = 1").drop("__r")
    earlier = F.lag("item_id").over(Window.partitionBy("content_hash").orderBy("arrival", "item_id"))
    return kept.withColumn("duplicate_of", earlier).withColumn("status", F.when(earlier.isNull(), "new").otherwise("skipped"))


def title_pairs(docs: DataFrame, scope: str) -> DataFrame:
    """scope, a, b (a < b) and overlap of documents (id, title) of one scope that share a title word. A scope is a feed that newest() has cut, so its pairs are bounded."""
    words = docs.select(scope, "id", F.array_distinct(t.title_tokens(F.col("title"))).alias("w"))
    each = words.select(scope, "id", F.explode("w").alias("word"))
    pairs = each.withColumnRenamed("id", "a").join(each.withColumnRenamed("id", "b"), [scope, "word"]).where("a < b").groupBy(scope, "a", "b").agg(F.count("*").alias("overlap"))
    sized = words.select(scope, "id", F.size("w").alias("n"))
    left, right = sized.withColumnsRenamed({"id": "a", "n": "n_a"}), sized.withColumnsRenamed({"id": "b", "n": "n_b"})
    return pairs.join(left, [scope, "a"]).join(right, [scope, "b"])


def similar_titles(docs: DataFrame, scope: str) -> DataFrame:
    """Pairs of documents of a scope with one story by their titles: equal, one within the other, or enough shared words."""
    norm = docs.select(scope, "id", F.array_join(t.title_tokens(F.col("title")), " ").alias("norm"))
    pairs = title_pairs(docs, scope).join(norm.withColumnsRenamed({"id": "a", "norm": "x"}), [scope, "a"]).join(norm.withColumnsRenamed({"id": "b", "norm": "y"}), [scope, "b"])
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    inside = (F.length("x") >= 12) & (F.length("y") >= 12) & (F.contains("x", "y") | F.contains("y", "x"))
    same = (F.col("x") == F.col("y")) | inside | ((F.col("overlap") >= 3) & (F.col("overlap") / small >= 0.8)) | ((F.col("overlap") >= 4) & (F.col("overlap") / large >= 0.67))
    return pairs.where(same).select(scope, "a", "b", "overlap")


def ratio(a: str, b: str) -> float:
    """Share of characters in matching runs, after white space is collapsed."""
    x, y = " ".join((a or "").split()), " ".join((b or "").split())
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def similar_lines(docs: DataFrame, scope: str, line: str, when: str) -> DataFrame:
    """Pairs of one scope whose one-liners tell the same story: by words, or within a week by fewer words or by their characters."""
    titled = docs.withColumn("title", F.col(line))
    texts = docs.select(scope, "id", F.array_join(t.title_tokens(F.col(line)), " ").alias("line"), F.unix_timestamp(when).alias("s"))
    pairs = title_pairs(titled, scope).join(texts.withColumnsRenamed({"id": "a", "line": "x", "s": "s_a"}), [scope, "a"]).join(texts.withColumnsRenamed({"id": "b", "line": "y", "s": "s_b"}), [scope, "b"])
    o, small, large = F.col("overlap"), F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    words = (F.col("x") == F.col("y")) | ((F.length("x") >= 16) & (F.length("y") >= 16) & (F.contains("x", "y") | F.contains("y", "x"))) | ((o >= 4) & (o / small >= 0.55))
    near = F.abs(F.col("s_a") - F.col("s_b")) <= WEEK_S
    few = near & (o >= 4) & ((o / small >= 0.32) | (o / large >= 0.28))
    event = F.exists(F.array(*[F.lit(w) for w in EVENT_WORDS]), lambda w: F.contains("x", w) & F.contains("y", w))
    # Characters are compared only where words leave it open.
    settled = pairs.withColumn("same", words | few)
    open_ = settled.where(~F.col("same") & near).withColumn("r", sequence_ratio("x", "y")).where((F.col("r") >= 0.62) | ((F.col("r") >= 0.55) & event))
    return settled.where("same").select(scope, "a", "b").unionByName(open_.select(scope, "a", "b"))


def title_graph(docs: DataFrame, scope: str) -> DataFrame:
    """Edges scope, a, b, weight between titles that share two words and 0.34 of the shorter one."""
    share = F.col("overlap") / F.least("n_a", "n_b")
    return title_pairs(docs, scope).where((F.col("overlap") >= 2) & (share >= 0.34)).select(scope, "a", "b", F.least(share, F.lit(1.0)).alias("weight"))


def degrees(edges: DataFrame, scope: str) -> DataFrame:
    """scope, id, degree: sums of the weights at each node with edges."""
    both = edges.select(scope, F.col("a").alias("id"), "weight").unionByName(edges.select(scope, F.col("b").alias("id"), "weight"))
    return both.groupBy(scope, "id").agg(F.sum("weight").alias("degree"))


def _centrality(ids: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, steps: int, stop: float) -> np.ndarray:
    at = {k: i for i, k in enumerate(ids)}
    i, j = np.array([at[x] for x in a], int), np.array([at[x] for x in b], int)
    v = np.full(len(ids), 1.0 / len(ids))
    for _ in range(steps if len(w) else 0):
        new = np.bincount(i, w * v[j], len(ids)) + np.bincount(j, w * v[i], len(ids))
        norm = np.sqrt((new**2).sum())
        if norm <= 1e-12:
            break
        new /= norm
        done = np.abs(new - v).sum() < stop
        v = new
        if done:
            break
    low, high = v.min(), v.max()
    return np.zeros(len(ids)) if not len(w) or high - low <= 1e-12 else (v - low) / (high - low)


def centrality(nodes: DataFrame, edges: DataFrame, scope: str, steps: int = 30, stop: float = 1e-6) -> DataFrame:
    """scope, id, eigen from 0 to 1 by power iteration. A scope is a feed that newest() has cut, so it fits one task."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(left["id"].unique())
        e = _centrality(ids, right["a"].to_numpy(), right["b"].to_numpy(), right["weight"].to_numpy(float), steps, stop) if len(ids) else []
        return pd.DataFrame({scope: key[0], "id": ids, "eigen": e})

    kind = dict(nodes.dtypes)[scope]
    nodes = nodes.select(F.col(scope).alias(scope), "id")
    edges = edges.select(F.col(scope).alias(scope), "a", "b", "weight")
    return nodes.groupBy(scope).cogroup(edges.groupBy(scope)).applyInPandas(run, f"{scope} {kind}, id long, eigen double")


def scaled(value: Column, scope: str) -> Column:
    """From 0 (smallest of the scope) to 1 (largest); 0 if all are equal."""
    by = Window.partitionBy(scope)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high - low > 1e-12, (value - low) / (high - low)).otherwise(0.0)


def ranked(docs: DataFrame, scope: str) -> DataFrame:
    """docs (id, title, source, doc_type, relevance_score, event_time) of each scope with rank_score, rank_centrality, rank_freshness and place (from 1)."""
    edges = title_graph(docs, scope)
    eigen = centrality(docs.select(scope, "id"), edges, scope)
    joined = docs.join(degrees(edges, scope), [scope, "id"], "left").join(eigen, [scope, "id"], "left").fillna(0.0, ["degree", "eigen"])
    central = 0.65 * F.col("eigen") + 0.35 * scaled(F.col("degree"), scope)
    prior = F.when(F.col("doc_type") == "report", 0.9).when(F.col("source") == "sec_edgar", 0.8).when(F.col("source") == "naver_finance_research", 0.75).when(F.col("source") == "naver_news", 0.55).otherwise(0.5)
    fresh = scaled(F.unix_timestamp("event_time").cast("double"), scope)
    a = joined.withColumn("rank_centrality", central).withColumn("rank_freshness", fresh)
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("relevance_score", F.lit(0.0))))
    scored = a.withColumn("rank_score", F.round(0.45 * relevance + 0.35 * F.col("rank_centrality") + 0.15 * F.col("rank_freshness") + 0.05 * prior, 6))
    order = Window.partitionBy(scope).orderBy(F.col("rank_score").desc(), F.col("event_time").desc(), F.col("id").desc())
    return scored.withColumn("place", F.row_number().over(order)).drop("degree", "eigen")


def _alike(words: tuple[str, set], seen: tuple[str, set], least: int, small_share: float, large_share: float) -> bool:
    """Equal, one within the other from least characters on, or enough shared words of the smaller or of the larger."""
    (x, u), (y, v) = words, seen
    if x == y or min(len(x), len(y)) >= least and (x in y or y in x):
        return True
    both = len(u & v)
    return both >= 3 and both / min(len(u), len(v)) >= small_share or both >= 4 and both / max(len(u), len(v)) >= large_share


def _same_line(words: tuple[str, set], seen: tuple[str, set], seconds: float) -> bool:
    """Whether two one-liners tell one story; within a week fewer words or like characters are enough."""
    (x, u), (y, v) = words, seen
    both = len(u & v)
    if x == y or min(len(x), len(y)) >= 16 and (x in y or y in x) or both >= 4 and both / min(len(u), len(v)) >= 0.55:
        return True
    if seconds > WEEK_S:
        return False
    if both >= 4 and (both / min(len(u), len(v)) >= 0.32 or both / max(len(u), len(v)) >= 0.28):
        return True
    r = ratio(x, y)
    return r >= 0.62 or r >= 0.55 and any(w in x and w in y for w in EVENT_WORDS)


def _walk(rows: list[dict], limit: int, lines: bool) -> list[list]:
    """Representatives of rows (in order) with the number of later rows that repeat them: [row, count], limit at most. Rows are compared within a scope."""
    shown: list[list] = []
    for row in rows:
        title, line = (" ".join(row["words"]), set(row["words"])), (" ".join(row["line_words"]), set(row["line_words"]))
        mine = [x for x in shown if x[0]["scope"] == row["scope"]]
        hit = next((x for x in mine if row["url"] and row["url"] == x[0]["url"]), None)
        hit = hit or next((x for x in mine if row["key"] and row["key"] == x[0]["key"]), None)
        hit = hit or next((x for x in mine if title[0] and x[2][0] and _alike(title, x[2], 12, 0.8, 0.67)), None)
        if lines:
            hit = hit or next((x for x in mine if line[0] and x[3][0] and _same_line(line, x[3], abs(row["event_s"] - x[0]["event_s"]))), None)
        if hit:
            hit[1] += 1
        elif len(shown) < limit:
            shown.append([row, 0, title, line])
    return shown


def _compared(rows: DataFrame, scope: str, *more: str) -> DataFrame:
    """What the walk compares: scope, id, event_s, url, key, words, line_words, and columns more."""
    line = t.title_tokens(F.col("line")) if "line" in rows.columns else F.expr("cast(array() as array<string>)")
    return rows.select(F.col(scope).alias("scope"), "id", F.unix_timestamp("event_time").alias("event_s"), t.normalize_url(F.col("url")).alias("url"), t.title_key(F.col("title")).alias("key"), t.title_tokens(F.col("title")).alias("words"), line.alias("line_words"), *more)


def curated(rows: DataFrame, feed: str, scope: str, limit: int) -> DataFrame:
    """What each feed shows: feed, scope, id, rank_score, place (from 1), similar_count (rows of the feed that repeat it).

    rows: feed, scope, id, rank_score, event_time, url, title, line (one-liner), source, doc_type, relevance_score, matched_alias, of feeds that newest() has cut, so a feed fits one task.
    Rows that may be shown are walked from the best: one that repeats a representative of its scope by address, title or one-liner counts there, others become one until limit are.
    """
    shown = rows.where(r.displayable(F.col("title"), F.col("source"), F.col("doc_type"), F.col("relevance_score"), F.col("matched_alias")))
    kinds = dict(rows.dtypes)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        best = part.sort_values(["rank_score", "event_s", "id"], ascending=False).to_dict("records")
        out = [(key[0], x["scope"], x["id"], x["rank_score"], k + 1, n) for k, (x, n, *_) in enumerate(_walk(best, limit, True))]
        return pd.DataFrame(out, columns=[feed, scope, "id", "rank_score", "place", "similar_count"])

    return _compared(shown, scope, F.col(feed).alias("__feed"), "rank_score").groupBy("__feed").applyInPandas(run, f"{feed} {kinds[feed]}, {scope} {kinds[scope]}, id long, rank_score double, place int, similar_count long")


def related(docs: DataFrame, items: DataFrame, scope: str, limit: int) -> DataFrame:
    """items' id and related (ids, newest first): the newest documents of the same scope but the item itself that don't repeat one another by address or title, limit at most.

    The newest DEPTH times limit count. As the answer differs only for items among the newest, it is worked out once per scope and once for each of those.
    """
    depth, kind = DEPTH * limit, dict(docs.dtypes)[scope]
    by = Window.partitionBy(scope).orderBy(F.col("event_time").desc(), F.col("id").desc())
    top = docs.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= depth + 1)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("__n").to_dict("records")
        out = []
        for skip in [None, *[x["id"] for x in rows]]:
            kept = [x for x in rows if x["id"] != skip][:depth]
            out.append((key[0], skip, [x["id"] for x, *_ in _walk(kept, limit, False)]))
        return pd.DataFrame(out, columns=[scope, "item", "related"]).astype({"item": "Int64"})

    answers = _compared(top, scope, "__n").groupBy("scope").applyInPandas(run, f"{scope} {kind}, item long, related array<long>")
    own = items.select(scope, "id").join(answers.where("item IS NOT NULL").select(scope, F.col("item").alias("id"), F.col("related").alias("own")), [scope, "id"], "left")
    return own.join(answers.where("item IS NULL").select(scope, "related"), scope).select("id", F.coalesce("own", "related").alias("related"))


def compressed_cards(cards: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int = 120) -> DataFrame:
    """Per key, the first card of each headline, first fact and day, most at most."""
    same = [F.left("fact_headline", F.lit(120)), F.left(F.coalesce(F.get("facts", F.lit(0)), F.lit("")), F.lit(120)), F.to_date("published_at")]
    one = cards.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, *same).orderBy(*order))).where("__r = 1")
    return one.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def without_boilerplate(docs: DataFrame, text: str = "text", longest: int = 80, least: int = 4) -> DataFrame:
    """docs without lines of at most longest characters that stand least times in their document, and without lines of symbols only."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), t.compact)

    def keep(all_: Column, low: Column) -> Column:
        often = lambda x: (F.length(x) <= longest) & (x != "") & (F.size(F.filter(low, lambda y: y == F.lower(x))) >= least)
        return F.filter(all_, lambda x: ~often(x) & x.rlike(r"[\p{L}\p{N}]"))

    kept = t.let(lines, lambda a: t.let(F.transform(a, F.lower), lambda low: keep(a, low)))
    return docs.withColumn(text, F.array_join(kept, "\n"))
