"""Summaries of stocks and sectors and reports, line by line, by rule."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import evidence as e

#: The lines of a sector summary, by the document they cite (1 to 3), and headings and standing lines of a report.
SECTOR_LINES = [
    (1, "{name} sector has {n} recent deduplicated documents with mixed drivers. {tag}"), (1, "Top headline: {title} {tag}"), (2, "Follow-up signal: {title} {tag}"), (3, "Third signal: {title} {tag}"),
    (1, "Cross-stock spread indicates this sector document set references {stocks} stocks in a single item. {tag}"),
    (2, "Report/news mix should be checked before trading decisions because item types can differ by source. {tag}"),
    (3, "Use this as a morning context view, then verify key claims in original source links. {tag}"),
    (1, "Risk note: if multiple headlines repeat the same event, avoid over-weighting duplicated impact. {tag}"),
]
REPORT = [
    "# Agent Report: {entity}", "- Period: {first} to {last}", "\n## Executive Summary", "- Evidence volume reached {cards} cards across {topics} major topics.", "- Source mix: research {research}, filing {filing}, news {news}.",
    "\n## Thesis", "- {headline}", "- Topic concentration indicates {topic} remains a key near-term driver.", "\n## Bear Case", "- {risk}", "\n## Key Evidence", "{evidence}",
    "\n## What Changed Recently", "{changes}", "\n## What to Watch", "- Next confirmation on {topic} trend.",
]
NO_CHANGE = "No material change"
NO_SECTOR_DOCS = "No recent sector documents were found."
STOCK_LABELS = ["결론", "근거1", "근거2", "리스크1", "체크포인트1", "최종판단"]
NO_BODY = "핵심 사실을 판단하기에 본문 정보가 부족합니다."
VERDICTS = {"positive": "긍정", "negative": "부정", "neutral": "중립"}


def _newest(docs: DataFrame, key: str, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.col("event_time").desc(), F.col("id").desc()))
    return docs.withColumn("n", n).where(F.col("n") <= most)


def fact_sentence(title: Column, body: Column) -> Column:
    """The first sentence of 16 characters behind a repeated title, at most 220 long; else the text."""
    clean = lambda c: F.rtrim(F.left(t.compact(F.regexp_replace(t.compact(c), r"\[[^\]]{1,60}\]", "")), F.lit(220)))
    head, text = t.compact(title), F.when(t.compact(body) != "", t.compact(body)).otherwise(t.compact(title))
    rest = F.when((head != "") & F.startswith(text, head), F.trim(F.substring(text, F.length(head) + 1, F.length(text))))
    text = F.when(F.coalesce(rest, F.lit("")) != "", rest).otherwise(text)
    first = F.get(F.filter(F.transform(F.split(text, r"(?<=[.!?다])\s+"), lambda s: clean(s)), lambda s: F.length(s) >= 16), F.lit(0))
    return F.when(text == "", NO_BODY).otherwise(F.coalesce(first, clean(text)))


def stock_summaries(docs: DataFrame, risks: Sequence[str], checks: Sequence[str], positive: Sequence[str], negative: Sequence[str], newest: int = 30) -> DataFrame:
    """stock_code, line_no, text, source_id: six lines from the newest documents (id, stock_code, title, body, event_time): conclusion, two of evidence, the first risk and checkpoint, verdict."""
    top = _newest(docs, "stock_code", newest).withColumn("fact", fact_sentence(F.col("title"), F.col("body")))
    low = F.lower(F.concat_ws(" ", "title", "body"))
    has = lambda words: e.count_words(low, [w.lower() for w in words]) > 0
    pick = lambda when: F.min_by(F.struct("fact", "id"), F.when(when, F.col("n")))
    a = top.groupBy("stock_code").agg(pick(F.col("n") == 1).alias("a"), pick(F.col("n") == 2).alias("b"), pick(has(risks)).alias("r"), pick(has(checks)).alias("c"))
    mood = e.sentiment(docs, "stock_code", [F.col("event_time").desc(), F.col("id").desc()], positive, negative, newest)
    j = a.join(mood, "stock_code").withColumn("b", F.coalesce("b", "a"))
    verdict = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv]), F.col("label")), F.format_string(" (신뢰도 %.2f)", "confidence"))
    facts = [F.col("a"), F.col("a"), F.col("b"), F.coalesce("r", "a"), F.coalesce("c", "b")]
    lines = [F.struct(F.concat(F.lit(f"{label}: "), f["fact"]).alias("text"), f["id"].alias("source_id")) for label, f in zip(STOCK_LABELS, facts)]
    lines.append(F.struct(F.concat(F.lit(f"{STOCK_LABELS[5]}: "), verdict).alias("text"), F.col("a.id").alias("source_id")))
    return j.select("stock_code", F.posexplode(F.array(*lines)).alias("p", "l")).select("stock_code", (F.col("p") + 1).alias("line_no"), "l.text", "l.source_id")


def sector_summaries(sectors: DataFrame, docs: DataFrame) -> DataFrame:
    """sector_code, line_no, text, source_id: eight lines for each of sectors (sector_code, name) from its newest documents (id, sector_code, title, source, published_at, event_time, stocks)."""
    tag = t.source_tag(F.col("source"), F.col("published_at"))
    doc = F.struct("id", F.left(F.coalesce(F.nullif(t.compact(F.col("title")), F.lit("")), F.lit("no title")), F.lit(140)).alias("title"), tag.alias("tag"), F.col("stocks").cast("string").alias("stocks"))
    n = F.row_number().over(Window.partitionBy("sector_code").orderBy(F.col("event_time").desc(), F.col("id").desc()))
    a = docs.withColumn("n", n).groupBy("sector_code").agg(F.count("*").alias("k"), *[F.max(F.when(F.col("n") == i, doc)).alias(f"d{i}") for i in (1, 2, 3)])
    j = sectors.select("sector_code", "name").join(a, "sector_code", "left").withColumn("d2", F.coalesce("d2", "d1")).withColumn("d3", F.coalesce("d3", "d1"))
    lines = []
    for i, pattern in SECTOR_LINES:
        d = F.col(f"d{i}")
        text = F.lit(pattern)
        for name, v in {"name": F.col("name"), "n": F.col("k").cast("string"), "stocks": d["stocks"], "tag": d["tag"], "title": d["title"]}.items():
            text = F.replace(text, F.lit("{" + name + "}"), v)
        lines.append(F.struct(F.coalesce(text, F.lit(NO_SECTOR_DOCS)).alias("text"), d["id"].alias("source_id")))
    return j.select("sector_code", F.posexplode(F.array(*lines)).alias("p", "l")).select("sector_code", (F.col("p") + 1).alias("line_no"), "l.text", "l.source_id")


def reports(cards: DataFrame, keys: Sequence[str], first: str, last: str, changes: DataFrame, top: int = 10) -> DataFrame:
    """keys, report (Markdown) of entities that are ready for one: numbers of cards and sources, main topic, evidence of the newest cards, latest changes (keys, change_lines)."""
    ready = e.report_ready(cards, keys).where("ready").select(*keys)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("published_at").desc_nulls_last(), F.col("item_id").desc()))
    kept = cards.join(ready, list(keys), "left_semi").withColumn("n", n)
    topics = e.top_topics(kept, keys).groupBy(*keys).agg(F.count("*").alias("topics"), F.max(F.when(F.col("place") == 1, F.col("topic"))).alias("topic"))
    line = F.concat(F.lit("- ["), F.left("card_id", F.lit(12)), F.lit("] "), "fact_headline")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= top, F.struct("n", line.alias("l"))))), lambda x: x["l"]), "\n")
    of = lambda k: F.count_if(F.col("source_type") == k).alias(k)
    a = kept.groupBy(*keys).agg(F.count("*").alias("k"), of("research"), of("filing"), of("news"), F.max(F.when(F.col("n") == 1, F.struct("fact_headline", "risk_note"))).alias("head"), listed.alias("evidence"))
    j = a.join(topics, list(keys)).join(changes, list(keys), "left")
    values = {
        "first": F.lit(first), "last": F.lit(last), "cards": F.col("k").cast("string"), "topics": F.col("topics").cast("string"), **{k: F.col(k).cast("string") for k in ("research", "filing", "news")}, "topic": F.col("topic"),
        "entity": F.concat_ws("/", *keys), "headline": F.col("head.fact_headline"), "risk": F.col("head.risk_note"), "evidence": F.col("evidence"), "changes": F.coalesce(F.nullif(F.array_join("change_lines", "\n"), F.lit("")), F.lit(NO_CHANGE)),
    }
    lines = [F.concat(*[values[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", line)) if x]) for line in REPORT]
    return j.select(*keys, F.concat_ws("\n", *lines).alias("report"))


def economy_score(text: Column, blob: Column, macro: Sequence[str], policy: Sequence[str], shared: Sequence[str], hints: Sequence[str]) -> Column:
    """4, and 1 for each macro and each policy keyword in a text, 1 for a source of economic news, 10 at most. Shared keywords count on both lists."""
    low = F.lower(t.compact(text))
    hits = lambda words: e.count_words(low, list(dict.fromkeys(words)))
    known = F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(F.lower(blob), h)).cast("int")
    return F.least(F.lit(10.0), 4.0 + hits([*macro, *shared]) + hits([*policy, *shared]) + known)
