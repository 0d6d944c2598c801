"""Queries of summaries, reports and feeds."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import evidence as e
from ..operators import relational as r
from ..functions import text as t
from ..operators import resolve
from ..operators import summaries as m
from .entities import market_feed
from .evidence import CARDS, NEGATIVE, POSITIVE, _numbered, changes, docs
from .registry import register, view
from .text import LIKE, C

EVENT = "coalesce(published_at, collected_at)"


def _sector_docs(s: SparkSession, d: str) -> DataFrame:
    mapped = docs(s, d).join(view(s, d, "fx_stock_sector_map").where("confidence > 0.8"), "stock_code")
    return mapped.withColumn("stocks", F.size(F.collect_set("stock_code").over(Window.partitionBy("sector_code"))))


def _fact() -> str:
    """CTEs x to f over k (id, title, body): the fact of each document."""
    clean = lambda c: f"rtrim(left({C.format("regexp_replace(" + C.format(c) + r", '\[[^\]]{1,60}\]', '', 'g')")}, 220))"
    return rf"""x AS (SELECT *, {C.format('title')} AS head, CASE WHEN {C.format('body')} <> '' THEN {C.format('body')} ELSE {C.format('title')} END AS whole FROM k),
  y AS (SELECT *, CASE WHEN head <> '' AND starts_with(whole, head) AND trim(substr(whole, length(head) + 1)) <> '' THEN trim(substr(whole, length(head) + 1)) ELSE whole END AS rest FROM x),
  f AS (SELECT *, CASE WHEN rest = '' THEN '{m.NO_BODY}' ELSE coalesce(list_filter(list_transform(string_split(regexp_replace(rest, '([.!?다]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: {clean('s')}), lambda s: length(s) >= 16)[1], {clean('rest')}) END AS fact FROM y)"""


@register("e10_stock_summaries", f"""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY {EVENT} DESC, id DESC) AS n, lower(title || ' ' || body) AS low FROM fx_documents) AS t WHERE n <= 30), {_fact()},
  p AS (SELECT *, {{'fact': fact, 'id': id}} AS s, contains(low, 'risk') OR contains(low, 'reing') AS risky, contains(low, 'next') OR contains(low, 'tion') AS due FROM f),
  g AS (SELECT stock_code, arg_min(s, n) FILTER (WHERE n = 1) AS a, arg_min(s, n) FILTER (WHERE n = 2) AS b, arg_min(s, n) FILTER (WHERE risky) AS r, arg_min(s, n) FILTER (WHERE due) AS c,
    sum({" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in POSITIVE)} - ({" + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in NEGATIVE)})) AS gap FROM p GROUP BY stock_code),
  h AS (SELECT stock_code, a, coalesce(b, a) AS b, coalesce(r, a) AS r, coalesce(c, b, a) AS c, CASE WHEN gap > 0 THEN '긍정' WHEN gap < 0 THEN '부정' ELSE '중립' END || printf(' (신뢰도 %.2f)', CAST(least(0.9, 0.55 + 0.04 * abs(gap)) AS DOUBLE)) AS verdict FROM g)
  SELECT stock_code, CAST(i AS INT) AS line_no, CASE i WHEN 1 THEN '결론: ' || a.fact WHEN 2 THEN '근거1: ' || a.fact WHEN 3 THEN '근거2: ' || b.fact WHEN 4 THEN '리스크1: ' || r.fact WHEN 5 THEN '체크포인트1: ' || c.fact ELSE '최종판단: ' || verdict END AS text,
    CASE i WHEN 3 THEN b.id WHEN 4 THEN r.id WHEN 5 THEN c.id ELSE a.id END AS source_id FROM h, (SELECT unnest(generate_series(1, 6)) AS i) AS l""")  # fmt: skip
def e10(s: SparkSession, d: str) -> DataFrame:
    return m.stock_summaries(docs(s, d), ["risk", "reing"], ["next", "tion"], POSITIVE, NEGATIVE)


@register("e11_sector_summaries", f"""WITH k AS (SELECT DISTINCT p_type AS sector_code FROM part UNION SELECT 'EMPTY'), f AS (SELECT m.sector_code, d.*, row_number() OVER (PARTITION BY m.sector_code ORDER BY {EVENT} DESC, d.id DESC) AS n FROM fx_documents d JOIN fx_stock_sector_map m ON m.stock_code = d.stock_code AND m.confidence > 0.8),
  g AS (SELECT sector_code, max(id) FILTER (WHERE n = 1) AS a, max(id) FILTER (WHERE n = 2) AS b, max(id) FILTER (WHERE n = 3) AS c FROM f GROUP BY sector_code)
  SELECT sector_code, CAST(i AS INT) AS line_no, CASE i WHEN 3 THEN coalesce(b, a) WHEN 6 THEN coalesce(b, a) WHEN 4 THEN coalesce(c, a) WHEN 7 THEN coalesce(c, a) ELSE a END AS source_id, a IS NULL AS empty FROM k LEFT JOIN g USING (sector_code), (SELECT unnest(generate_series(1, 8)) AS i) AS x""")  # fmt: skip
def e11(s: SparkSession, d: str) -> DataFrame:
    part = view(s, d, "part")
    sectors = part.select(F.col("p_type").alias("sector_code")).union(part.limit(1).select(F.lit("EMPTY"))).distinct().withColumn("name", F.initcap("sector_code"))
    return m.sector_summaries(sectors, _sector_docs(s, d)).select("sector_code", "line_no", "source_id", (F.col("text") == m.NO_SECTOR_DOCS).alias("empty"))


def _report() -> str:
    """The lines of a report as an SQL expression."""
    values = {"first": "'2024-01-01'", "last": "'2024-01-31'", "cards": "k", "entity": "ag.entity_type || '/' || ag.entity_id", "headline": "fact_headline", "risk": "risk_note", "changes": f"coalesce(changes, '{m.NO_CHANGE}')"}
    return " || chr(10) || ".join(" || ".join(values.get(x, x) if k % 2 else "'" + x.replace("'", "''") + "'" for k, x in enumerate(re.split(r"\{(\w+)\}", line)) if x) for line in m.REPORT)


@register("e9_reports", f"""WITH {CARDS}, {_numbered('ch', '2024-01-03')}, {_numbered('ea', '2024-01-02')},
  ag AS (SELECT entity_type, entity_id, count(*) AS k, count(*) FILTER (WHERE source_type = 'research') AS research, count(*) FILTER (WHERE source_type = 'filing') AS filing, count(*) FILTER (WHERE source_type = 'news') AS news, len(list_distinct(flatten(list(topics)))) AS kinds FROM cards GROUP BY ALL),
  nn AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY published_at DESC NULLS LAST, item_id DESC) AS n FROM cards),
  hd AS (SELECT entity_id, max(fact_headline) FILTER (WHERE n = 1) AS fact_headline, max(risk_note) FILTER (WHERE n = 1) AS risk_note, string_agg('- [' || left(card_id, 12) || '] ' || fact_headline, chr(10) ORDER BY n) FILTER (WHERE n <= 10) AS evidence FROM nn GROUP BY entity_id),
  tp AS (SELECT entity_id, unnest(topics) AS topic FROM cards), tc AS (SELECT entity_id, topic, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, topic) AS p FROM tp GROUP BY entity_id, topic),
  tt AS (SELECT entity_id, least(count(*), 3) AS topics, max(topic) FILTER (WHERE p = 1) AS topic FROM tc GROUP BY entity_id),
  fr AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n) AS o FROM ch WHERE fact_headline <> '' AND NOT EXISTS (SELECT 1 FROM ea WHERE ea.entity_id = ch.entity_id AND ea.card_id = ch.card_id)),
  cl AS (SELECT entity_id, string_agg(CASE WHEN regexp_matches(lower(fact_headline), '{"|".join(e.NEGATIVE_HEADLINES)}') THEN '-' ELSE '+' END || ' ' || fact_headline || ' (cards: C' || n || ')', chr(10) ORDER BY o) AS changes FROM fr WHERE o <= 3 GROUP BY entity_id)
  SELECT ag.entity_type, ag.entity_id, {_report()} AS report FROM ag JOIN hd USING (entity_id) JOIN tt USING (entity_id) LEFT JOIN cl USING (entity_id) WHERE k >= 12 AND (research >= 2 OR filing >= 1) AND kinds >= 2""")  # fmt: skip
def e9(s: SparkSession, d: str) -> DataFrame:
    keys = ["entity_type", "entity_id"]
    return m.reports(e.cards(docs(s, d)), keys, "2024-01-01", "2024-01-31", changes(s, d, keys))


@register("r5_economy_scores", "SELECT id, least(10.0, 4 + CAST(contains(b, 'rate') AS INT) + CAST(contains(b, 'ment') AS INT) * 2 + CAST(contains(b, 'tion') AS INT) + CAST(source = 'naver_news' AS INT))::DOUBLE AS score FROM (SELECT id, source, lower(title || ' ' || body) AS b FROM fx_documents) AS t")
def r5(s: SparkSession, d: str) -> DataFrame:
    found = view(s, d, "fx_documents")
    return found.select("id", m.economy_score(F.concat_ws(" ", "title", "body"), F.concat_ws(" ", "source", "url"), ["rate"], ["tion"], ["ment"], ["naver_news"]).alias("score"))


@register("j15_item_feed", f"""SELECT d.id, s.name, l.quality FROM fx_documents d JOIN labels l ON l.doc_id = d.id JOIN fx_stocks s ON s.code = d.stock_code AND s.is_active
  LEFT JOIN (SELECT id AS mid, CASE WHEN id % 4 = 0 THEN 'OTHER' ELSE stock_code END AS ticker, relevance_score AS score FROM fx_documents WHERE id % 2 = 0) AS m ON mid = d.id
  WHERE mid IS NULL OR (ticker = d.stock_code AND score >= 0.55) ORDER BY {EVENT} DESC, d.id DESC LIMIT 160""")  # fmt: skip
def j15(s: SparkSession, d: str) -> DataFrame:
    found = docs(s, d)
    stocks = view(s, d, "fx_stocks").where("is_active").select(F.col("code").alias("stock_code"), "name")
    mapping = found.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "OTHER").otherwise(F.col("stock_code")).alias("ticker"), F.col("relevance_score").alias("score"))
    joined = found.join(view(s, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").join(stocks, "stock_code").join(mapping, "id", "left")
    return joined.where("ticker IS NULL OR (ticker = stock_code AND score >= 0.55)").orderBy(F.col("event_time").desc(), F.col("id").desc()).limit(160).select("id", "name", "quality")


@register("j19_related_documents")
def j19(s: SparkSession, d: str) -> DataFrame:
    """Five documents of the same stock for each report."""
    found = docs(s, d)
    return dedup.related(found, found.where("doc_type = 'report'"), "stock_code", 5)


@register("j21_sector_lines", f"SELECT sector_code, title AS line FROM (SELECT k.sector_code, d.title, row_number() OVER (PARTITION BY k.sector_code ORDER BY {EVENT} DESC NULLS LAST, d.id DESC) AS n FROM (SELECT DISTINCT sector_code FROM fx_stock_sector_map) AS k LEFT JOIN fx_stock_sector_map m ON m.sector_code = k.sector_code LEFT JOIN fx_documents d ON d.stock_code = m.stock_code) AS t WHERE n = 1")
def j21(s: SparkSession, d: str) -> DataFrame:
    sectors = view(s, d, "fx_stock_sector_map")
    lines = r.top_per_key(docs(s, d).join(sectors, "stock_code"), ["sector_code"], [F.col("event_time").desc(), F.col("id").desc()]).select("sector_code", F.col("title").alias("line"))
    return sectors.select("sector_code").distinct().join(lines, "sector_code", "left")


@register("a14_similar_counts")
def a14(s: SparkSession, d: str) -> DataFrame:
    return market_feed(s, d).select("market", "id", "similar_count")


@register("f14_title_copies")
def f14(s: SparkSession, d: str) -> DataFrame:
    """First sentences that copy their title (ratio 0.9) are blanked."""
    line = F.get(t.sentences(F.col("body")), F.lit(0))
    close = dedup.sequence_ratio(F.lower(line), F.lower("title"))
    return view(s, d, "fx_documents").select("id", F.when(close >= 0.9, "").otherwise(line).alias("line"))


@register("e19_change_snapshots", """WITH c AS (SELECT stock_code AS entity_id, count(*) FILTER (WHERE day BETWEEN DATE '2023-12-29' AND DATE '2024-01-04') AS a, count(*) FILTER (WHERE day BETWEEN DATE '2023-12-22' AND DATE '2023-12-28') AS b,
    count(*) FILTER (WHERE doc_type = 'report' AND day BETWEEN DATE '2023-12-29' AND DATE '2024-01-04') AS ra, count(*) FILTER (WHERE doc_type = 'report' AND day BETWEEN DATE '2023-12-22' AND DATE '2023-12-28') AS rb,
    count(*) FILTER (WHERE bad AND day BETWEEN DATE '2023-12-29' AND DATE '2024-01-04') AS na, count(*) FILTER (WHERE bad AND day BETWEEN DATE '2023-12-22' AND DATE '2023-12-28') AS nb
    FROM (SELECT *, CAST(coalesce(published_at, collected_at) AS DATE) AS day, contains(lower(body), 'reing') AS bad FROM fx_documents) AS d GROUP BY stock_code),
  w AS (SELECT entity_id, list_filter([CASE WHEN a + b > 0 THEN '+ 최근 7일 이벤트 ' || a || '건 (직전 7일 ' || b || '건, 변화 ' || CASE WHEN a > b THEN '+' ELSE '' END || (a - b) || ')' END, CASE WHEN ra + rb > 0 THEN '+ 리포트 ' || ra || '건 (직전 7일 ' || rb || '건)' END, CASE WHEN na + nb > 0 THEN '− 부정 신호 ' || na || '건 (직전 7일 ' || nb || '건)' END], lambda x: x IS NOT NULL) AS l FROM c),
  n AS (SELECT stock_code AS entity_id, id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS h, doc_type, row_number() OVER (PARTITION BY stock_code ORDER BY published_at DESC, id DESC) AS n FROM fx_documents WHERE published_at IS NOT NULL AND CAST(published_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-03' AND trim(regexp_replace(title, '\\s+', ' ', 'g')) <> ''),
  m AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n) AS k FROM n WHERE n <= 200 AND doc_type <> 'filing'),
  p AS (SELECT entity_id, id FROM (SELECT stock_code AS entity_id, id, doc_type, row_number() OVER (PARTITION BY stock_code ORDER BY published_at DESC, id DESC) AS n FROM fx_documents WHERE published_at IS NOT NULL AND CAST(published_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-02' AND trim(regexp_replace(title, '\\s+', ' ', 'g')) <> '') AS x WHERE n <= 200 AND doc_type <> 'filing'),
  f AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY k) AS o FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.entity_id = m.entity_id AND p.id = m.id)),
  g AS (SELECT entity_id, max(CASE WHEN regexp_matches(lower(h), 'risk|downgrade|decline|weak|cut|하락|악화') THEN '-' ELSE '+' END || ' ' || h || ' (cards: C' || k || ')') FILTER (WHERE o = 1) AS d1, count(*) AS lines FROM f GROUP BY entity_id)
  SELECT w.entity_id, CASE WHEN d1 IS NULL THEN CAST([] AS VARCHAR[]) ELSE [d1] END AS d1_preview, coalesce(lines, 0) > 1 AS d1_more, CASE WHEN len(l) = 0 THEN ['유의미한 변화 없음'] ELSE l[1:1] END AS d7_preview, len(l) > 1 AS d7_more FROM w LEFT JOIN g USING (entity_id)""")  # fmt: skip
def e19(s: SparkSession, d: str) -> DataFrame:
    events = docs(s, d).select(F.col("stock_code").alias("entity_id"), "event_time", F.col("doc_type").alias("kind"), e.impact(F.col("body"), [], ["reing"]).alias("impact"))
    snapshot = e.change_snapshots(events, changes(s, d, ["entity_id"]), ["entity_id"], "2024-01-04")
    return snapshot.select("entity_id", "d1_preview", "d1_more", "d7_preview", "d7_more")


LINES = f"""{CARDS}, ra AS (SELECT *, list_filter(list_transform(['conclusion: ' || fact_headline, 'evidence: ' || facts[1], 'evidence: ' || facts[2], 'risk: ' || risk_note, 'checkpoint: ' || topics[1], 'final: ' || interpretation], lambda x: left(x, 220)), lambda x: x IS NOT NULL) AS raw FROM cards),
lines AS (SELECT item_id, fact_headline, facts, risk_note, list_filter(raw, lambda x, i: list_position(list_transform(raw, lambda y: lower(y)), lower(x)) = i)[1:6] AS lines FROM ra),
fe AS (SELECT item_id, unnest(facts) AS f, generate_subscripts(facts, 1) AS n, fact_headline FROM lines), fw AS (SELECT item_id, n, f, lower(f) AS a, lower(fact_headline) AS b, list_distinct(string_split(lower(f), ' ')) AS u, list_distinct(string_split(lower(fact_headline), ' ')) AS v FROM fe),
fo AS (SELECT item_id, arg_min(f, n) AS own FROM fw WHERE NOT {LIKE} GROUP BY item_id)"""


@register("e6_item_lines", f"WITH {LINES} SELECT item_id, lines, left(coalesce(own, risk_note), 120) AS one_liner FROM lines LEFT JOIN fo USING (item_id)")
def e6(s: SparkSession, d: str) -> DataFrame:
    return e.item_lines(e.cards(docs(s, d)))


@register("e18_sections", f"""WITH {LINES}, sp AS (SELECT item_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS n FROM lines)
  SELECT item_id, split_part(x, ': ', 1) AS section, list(trim(x[length(split_part(x, ': ', 1)) + 2:]) ORDER BY n) AS texts FROM sp GROUP BY item_id, section""")
def e18(s: SparkSession, d: str) -> DataFrame:
    return e.labelled_sections(e.item_lines(e.cards(docs(s, d))), "lines")


@register("r1_stock_aliases", """WITH a AS (SELECT code, code AS alias FROM fx_stocks UNION SELECT code, name FROM fx_stocks UNION SELECT code, brand FROM fx_stocks WHERE lower(brand) <> 'brand#11') SELECT DISTINCT code, alias FROM a""")
def r1(s: SparkSession, d: str) -> DataFrame:
    return resolve.stock_aliases(view(s, d, "fx_stocks").withColumn("queries", F.array("brand", F.upper("name"), F.lit("77"), F.lit("x"))), ["Brand#11"])


@register("r11_mapping_rows", """WITH p AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'UNASSIGNED' ELSE stock_code END AS ticker, relevance_score AS score FROM fx_documents)
  SELECT id, 'ticker' AS entity_type, ticker AS entity_id, score, ticker <> 'UNASSIGNED' AS is_primary FROM p UNION ALL SELECT id, 'sector', 'A', CAST(6 AS DOUBLE), ticker = 'UNASSIGNED' FROM p WHERE id % 2 = 0""")  # fmt: skip
def r11(s: SparkSession, d: str) -> DataFrame:
    found = view(s, d, "fx_documents")
    primary = found.select("id", F.when(F.col("id") % 3 == 0, "UNASSIGNED").otherwise(F.col("stock_code")).alias("ticker"), F.col("relevance_score").alias("score"))
    pair = lambda name, score: F.struct(F.lit(name).alias("sector"), F.lit(score).alias("score"))
    sectors = found.where("id % 2 = 0").select("id", F.explode(F.array(pair("B", 6.0), pair("A", 6.0), pair("C", 5.0))).alias("x")).select("id", "x.*")
    return resolve.mapping_rows(primary, sectors)


@register("f22_doc_types", "SELECT id, doc_type AS kind, CASE lang WHEN 'en' THEN '긍정' WHEN 'de' THEN '부정' ELSE '중립' END AS label FROM fx_documents")
def f22(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_type") == "report", " Research ").when(F.col("doc_type") == "filing", "DISCLOSURE").otherwise("blog")
    impact = F.when(F.col("lang") == "en", "positive").when(F.col("lang") == "de", "negative")
    return view(s, d, "fx_documents").select("id", t.doc_type(raw).alias("kind"), t.impact_label(impact).alias("label"))
