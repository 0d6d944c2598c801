"""Queries of the text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from .registry import AS_OF, register, view

C = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def docs(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_documents")


@register("f1_compact", f"SELECT doc_id, {C.format('text')} AS text FROM documents")
def f1(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.compact(F.col("text")).alias("text"))


@register("f2_normalized_urls", r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || lower(regexp_extract(url, '//([^/?#]*)', 1)) || regexp_replace(coalesce(nullif(regexp_extract(url, '//[^/?#]*([^?#]*)', 1), ''), '/'), '/+', '/', 'g') AS base,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT regexp_matches(lower(p), '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|smid|from)='))) AS q FROM pages)
  SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM u""")  # fmt: skip
def f2(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "pages").select("page_id", t.normalize_url(F.col("url")).alias("url"))


@register("f3_hashes", r"SELECT id, sha256(title || chr(10) || lang) AS content_hash FROM fx_documents")
def f3(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.content_hash(F.col("title"), F.col("lang")).alias("content_hash"))


@register("f4_parsed_times", f"""SELECT id, CASE id % 4 WHEN 0 THEN TIMESTAMP '{AS_OF}' - to_minutes(CAST(id % 50 AS INT)) WHEN 1 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(id % 50 AS INT)) WHEN 2 THEN TIMESTAMP '2023-05-09 00:00:00' ELSE NULL END AS moment FROM fx_documents""")
def f4(s: SparkSession, d: str) -> DataFrame:
    n = (F.col("id") % 50).cast("string")
    raw = F.when(F.col("id") % 4 == 0, F.concat(n, F.lit("분 전"))).when(F.col("id") % 4 == 1, F.concat(n, F.lit(" 시간 전"))).when(F.col("id") % 4 == 2, "2023.5.9.").otherwise("soon")
    return docs(s, d).select("id", t.parse_datetime(raw, F.lit(AS_OF).cast("timestamp")).alias("moment"))


@register("f5_clean_news", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\[[^\]]{1,30}\]', ' ', 'g'), '\([^)]*기자[^)]*\)', ' ', 'g'), '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]+', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def f5(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.clean_news(F.col("text")).alias("text"))


@register("f6_paragraphs", r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: length(p) >= 1)[1:8] AS paragraphs FROM documents""")
def f6(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.paragraphs(F.col("text")).alias("paragraphs"))


SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: left(trim(x), 220)), lambda x: x <> '')"


@register("f7_sentences", f"SELECT doc_id, {SENTENCES.format(C.format('text'))} AS sentences FROM documents")
def f7(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.sentences(F.col("text")).alias("sentences"))


WORDS = r"string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(title, '\s+', ' ', 'g'))), '\[[^\]]{1,40}\]', ' ', 'g'), '\([^)]{1,40}\)', ' ', 'g'), '[^0-9a-z가-힣]+', ' ', 'g')), ' ')"


@register("f8_title_tokens", f"SELECT id, list_filter({WORDS}, lambda w: length(w) > 1)[1:20] AS tokens FROM fx_documents")
def f8(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.title_tokens(F.col("title")).alias("tokens"))


@register("d3_title_keys", f"SELECT id, array_to_string(list_filter({WORDS}, lambda w: length(w) > 1)[1:12], ' ') AS key FROM fx_documents")
def d3(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.title_key(F.col("title")).alias("key"))


@register("f9_numeric_context", r"SELECT doc_id, regexp_matches(lower(text), '\d+(\.\d+)?%|\d+\s*(원|억|조|만)|실적|매출|영업이익|eps|목표가|가이던스|전망') AS numeric FROM documents")
def f9(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.numeric_context(F.col("text")).alias("numeric"))


@register("f11_dominant_script", "SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) >= greatest(6, floor(len(regexp_extract_all(text, '[A-Za-z]')) * 1.2)) AS hangul FROM documents")
def f11(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.mostly_hangul(F.col("text")).alias("hangul"))


@register("f12_like_title", r"""SELECT id, a = b OR contains(a, b) OR contains(b, a) OR len(list_intersect(list_distinct(string_split(a, ' ')), string_split(b, ' '))) / len(list_distinct(string_split(a, ' '))) >= 0.7 AS repeats
  FROM (SELECT id, lower(trim(regexp_replace(substr(body, 41, 60), '\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS b FROM fx_documents) AS x WHERE a <> '' AND b <> ''""")  # fmt: skip
def f12(s: SparkSession, d: str) -> DataFrame:
    line = F.substring("body", 41, 60)
    return docs(s, d).where((t.compact(line) != "") & (t.compact(F.col("title")) != "")).select("id", t.like_title(line, F.col("title")).alias("repeats"))


@register("f15_sanitized_lines", r"""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: left(trim(regexp_replace(x, '\s+', ' ', 'g')), 220)), lambda x: x <> '') AS l FROM documents)
  SELECT doc_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)[1:6] AS lines FROM c""")  # fmt: skip
def f15(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.sanitize_lines(F.split("text", "\n")).alias("lines"))


@register("f17_numbers", "SELECT id, CAST(id * 1000 AS DOUBLE) AS number, CAST(id AS DOUBLE) * 1e12 + 2000e8 AS cap, CASE WHEN relevance_score <= 1.5 THEN round(relevance_score * 100, 6) ELSE relevance_score END AS percent FROM fx_documents")
def f17(s: SparkSession, d: str) -> DataFrame:
    number, cap = F.concat(F.format_number(F.col("id") * 1000, 0), F.lit("%")), F.concat(F.format_number("id", 0), F.lit("조 2,000억"))
    return docs(s, d).select("id", t.parse_number(number).alias("number"), t.parse_market_cap(cap).alias("cap"), F.round(t.percent_of_ratio(F.col("relevance_score")), 6).alias("percent"))


@register("f18_display", "SELECT id, CASE WHEN id % 7 = 0 THEN '-' WHEN c >= 1e12 THEN printf('%.2fT', c / 1e12) WHEN c >= 1e9 THEN printf('%.2fB', c / 1e9) ELSE printf('%.0f', c) END AS cap FROM (SELECT id, CAST(id * 1000000007 AS DOUBLE) AS c FROM fx_documents) AS x")
def f18(s: SparkSession, d: str) -> DataFrame:
    cap = F.when(F.col("id") % 7 != 0, (F.col("id") * 1000000007).cast("double"))
    return docs(s, d).select("id", t.format_market_cap(cap).alias("cap"))


@register("f19_local_times", "SELECT id, coalesce(strftime((published_at AT TIME ZONE 'UTC') AT TIME ZONE CASE WHEN id % 2 = 0 THEN 'Asia/Seoul' ELSE 'America/New_York' END, '%Y-%m-%d %H:%M'), '-') AS local FROM fx_documents")
def f19(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.local_time(F.col("published_at"), F.when(F.col("id") % 2 == 0, "KR").otherwise("US")).alias("local"))


@register("f20_symbols", "SELECT code, CASE WHEN market = 'US' THEN replace(code, '.', '-') WHEN brand = 'KOSDAQ' THEN code || '.KQ' ELSE code || '.KS' END AS symbol FROM fx_stocks")
def f20(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_stocks").select("code", t.quote_symbol(F.col("code"), F.col("market"), F.col("brand")).alias("symbol"))


@register("f21_source_tags", "SELECT id, CASE WHEN published_at IS NULL THEN '[' || source || ']' ELSE '[' || source || ' ' || strftime(published_at, '%Y-%m-%dT%H:%M') || ']' END AS tag FROM fx_documents")
def f21(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.source_tag(F.col("source"), F.col("published_at")).alias("tag"))


@register("f24_bodies", rf"SELECT id, left(concat_ws(chr(10), nullif({C.format('title')}, ''), lang, nullif({C.format('body')}, '')), 6000) AS body FROM fx_documents")
def f24(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.body_text(F.col("title"), F.col("lang"), F.col("body")).alias("body"))


#: Borders of words mind letters of all scripts, so those beyond ASCII become z before DuckDB looks for tokens.
TOKENS = r"\b20\d{2}[./-]\d{1,2}[./-]\d{1,2}\b|\b\d+(?:[.,]\d+)?%|\b\d+(?:[.,]\d+)?\b|\b[A-Z]{2,6}\b"


@register("f10_fact_preservation", rf"""WITH k AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\P{{L}}\x00-\x7F]', 'z', 'g'), '{TOKENS}'), lambda x: upper(regexp_replace(x, '[\s,]', '', 'g'))) AS w, upper(regexp_replace(replace(coalesce(string_split(text, chr(10))[1], ''), 'ß', 'SS'), '[\s,]', '', 'g')) AS l FROM documents)
  SELECT doc_id, CAST(len(w) AS INT) AS tokens, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: contains(l, x))) / len(w) END, 6) AS kept FROM k""")  # fmt: skip
def f10(s: SparkSession, d: str) -> DataFrame:
    """How much of a document its first line preserves."""
    return view(s, d, "documents").select("doc_id", F.size(t.fact_tokens(F.col("text"))).alias("tokens"), F.round(t.preservation(F.col("text"), F.substring_index("text", "\n", 1)), 6).alias("kept"))


@register("f23_packed_lines", f"""WITH k AS (SELECT doc_id, list_transform(string_split({C.format("coalesce(text, '')")}, ' '), lambda x: [x]) AS w FROM documents)
  SELECT doc_id, list_filter(list_reduce(w, lambda a, x: CASE WHEN len(a) > 5 THEN a WHEN length(a[-1]) + 1 + length(x[1]) > 110 THEN list_concat(a, x) ELSE list_concat(a[:-2], [a[-1] || ' ' || x[1]]) END), lambda x: x <> '')[1:5] AS lines FROM k""")  # fmt: skip
def f23(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", t.pack_words(F.col("text")).alias("lines"))


@register("f16_sections", "SELECT id, CASE id % 3 WHEN 0 THEN 'risk' WHEN 1 THEN 'final' END AS section, CASE WHEN id % 3 = 2 THEN 'other: ' || lang ELSE lang END AS body FROM fx_documents")
def f16(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.when(F.col("id") % 3 == 0, "Risk: ").when(F.col("id") % 3 == 1, "final : ").otherwise("other: "), "lang")
    return docs(s, d).select("id", t.section(line).alias("section"), t.section_body(line).alias("body"))


@register("f25_last_dates", f"SELECT id, CAST(CAST('2023-' || lpad(CAST(id % 12 + 1 AS VARCHAR), 2, '0') || '-07' AS DATE) AS TIMESTAMP) AS moment FROM fx_documents")
def f25(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("from 2021.1.2 to 2023/"), (F.col("id") % 12 + 1).cast("string"), F.lit("/7, due 2031-01-01"))
    return docs(s, d).select("id", t.last_date_mention(text, F.lit(AS_OF).cast("timestamp")).alias("moment"))


@register("f26_labels", "SELECT id, lang AS label, CASE doc_type WHEN 'report' THEN '리포트' WHEN 'filing' THEN '공시' ELSE '뉴스' END AS kind FROM fx_documents")
def f26(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.bracket_label(F.concat(F.lit(" ["), "lang", F.lit("] "), "title")).alias("label"), t.kind_label(F.col("doc_type")).alias("kind"))


LIKE = "(length(a) > 0 AND length(b) > 0 AND (a = b OR contains(a, b) OR contains(b, a) OR len(list_intersect(u, v)) / len(u) >= 0.7))"


@register("f13_one_liners", f"""WITH s AS (SELECT id, lang, {C.format('title')} AS title, list_filter({SENTENCES.format(C.format('body'))}, lambda x: x <> '') AS l FROM fx_documents),
  e AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n, title FROM s), k AS (SELECT id, n, line, lower({C.format('line')}) AS a, lower(title) AS b FROM e), w AS (SELECT *, list_distinct(string_split(a, ' ')) AS u, list_distinct(string_split(b, ' ')) AS v FROM k),
  f AS (SELECT id, arg_min({C.format('line')}, n) AS line FROM w WHERE NOT {LIKE} GROUP BY id)
  SELECT s.id, left(coalesce(f.line, nullif(s.lang, ''), s.title), 120) AS line FROM s LEFT JOIN f USING (id)""")  # fmt: skip
def f13(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("id", t.one_liner(F.lit(None).cast("string"), t.sentences(F.col("body")), F.col("title"), F.col("lang")).alias("line"))


@register("f27_labels", """SELECT id, CASE doc_type WHEN 'report' THEN '리포트' WHEN 'filing' THEN '공시' ELSE '뉴스' END AS kind, CASE WHEN contains(lower(body), 'erhe') THEN '긍정' WHEN contains(lower(body), 'reing') THEN '부정' ELSE '중립' END AS impact,
  CASE lang WHEN 'en' THEN 'Yahoo Finance' WHEN 'de' THEN '수동 입력' WHEN 'fr' THEN '뉴스/리포트 기반' ELSE '내부 프로필' END AS profile FROM fx_documents""")  # fmt: skip
def f27(s: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("lang") == "en", " Yahoo_Profile").when(F.col("lang") == "de", "manual").when(F.col("lang") == "fr", "derived_docs").otherwise(F.col("lang"))
    impact = F.when(F.contains(F.lower("body"), F.lit("erhe")), "positive").when(F.contains(F.lower("body"), F.lit("reing")), "negative")
    return docs(s, d).select("id", t.kind_label(F.col("doc_type")).alias("kind"), t.impact_label(impact).alias("impact"), t.profile_source_label(source).alias("profile"))


@register("f28_payloads", """SELECT id, title, CAST(id AS VARCHAR) AS number, list_transform(string_split(body, chr(10))[1:10], lambda x: left(x, 500)) AS lines, '{"lang":"' || lang || '","source":"' || source || '"}' AS tags FROM fx_documents""")
def f28(s: SparkSession, d: str) -> DataFrame:
    payload = F.to_json(F.struct("title", F.col("id").alias("number"), F.split("body", "\n").alias("lines"), F.struct("lang", "source").alias("tags")))
    kept = docs(s, d).select("id", t.compact_payload(payload).alias("p"))
    return kept.select("id", F.col("p.title").alias("title"), F.col("p.number").alias("number"), F.from_json("p.lines", "array<string>").alias("lines"), F.col("p.tags").alias("tags"))
