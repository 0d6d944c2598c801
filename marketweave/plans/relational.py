"""Queries of the relational operators and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as r
from ..operators import sinks
from ..operators.stored import Table, scratch
from .registry import AS_OF, keyed_stocks, register, view

NOW = f"TIMESTAMP '{AS_OF}'"
EVENT = "coalesce(published_at, collected_at)"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@register("p1_active_universe", "SELECT code, name, market, rank FROM fx_stocks WHERE is_active AND market = 'KR'")
def p1(s: SparkSession, d: str) -> DataFrame:
    return r.active_universe(view(s, d, "fx_stocks"), "KR").select("code", "name", "market", "rank")


@register("p2_recent_documents", f"SELECT id, stock_code, {EVENT} AS event_time FROM fx_documents WHERE CAST({EVENT} AS DATE) >= CAST({NOW} AS DATE) - 2")
def p2(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    return r.within_days(docs, as_of(), 2).select("id", "stock_code", r.event_time(docs).alias("event_time"))


@register("p3_price_range", "SELECT stock_code, trade_date, round(close, 9) AS close FROM fx_price_bars WHERE trade_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")
def p3(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_price_bars").where(F.col("trade_date").between("1997-01-01", "1997-12-31")).select("stock_code", "trade_date", F.round("close", 9).alias("close"))


@register("p4_reports_by_relevance", f"SELECT id, relevance_score, row_number() OVER (ORDER BY relevance_score DESC, {EVENT} DESC, id DESC) AS place FROM fx_documents WHERE doc_type = 'report' ORDER BY place LIMIT 100")
def p4(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").where("doc_type = 'report'")
    order = [F.col("relevance_score").desc(), r.event_time(docs).desc(), F.col("id").desc()]
    return docs.orderBy(*order).limit(100).select("id", "relevance_score", F.row_number().over(Window.orderBy(*order)).alias("place"))


@register("p5_stale_entities", f"""SELECT c_custkey, last_seen FROM customer LEFT JOIN (SELECT entity_id, max(CAST(as_of_date AS TIMESTAMP)) AS last_seen FROM fx_financial_snapshots GROUP BY entity_id) AS f ON entity_id = c_custkey
  WHERE last_seen IS NULL OR last_seen < TIMESTAMP '2000-01-01 00:00:00'""")  # fmt: skip
def p5(s: SparkSession, d: str) -> DataFrame:
    facts = view(s, d, "fx_financial_snapshots").withColumn("seen", F.col("as_of_date").cast("timestamp"))
    return r.stale(view(s, d, "customer").select("c_custkey"), facts, "c_custkey", "entity_id", "seen", F.lit("2000-01-01").cast("timestamp"), 0)


@register("p6_relevance_gate", "SELECT id FROM fx_documents WHERE relevance_score >= CASE source WHEN 'naver_news' THEN 0.56 WHEN 'naver_finance_research' THEN 0.34 WHEN 'sec_edgar' THEN 0.12 ELSE 0.38 END")
def p6(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_documents").where(F.col("relevance_score") >= r.relevance_gate(F.col("source"), F.col("doc_type"))).select("id")


@register("p7_displayable", r"""SELECT id FROM (SELECT *, CASE WHEN doc_type = 'report' THEN 0.12 WHEN source = 'sec_edgar' THEN 0.05 WHEN source = 'naver_news' THEN 0.3 ELSE 0.22 END AS gate FROM fx_documents) AS t
  WHERE length(trim(regexp_replace(title, '\s+', ' ', 'g'))) >= 6 AND relevance_score >= CASE WHEN lang = 'en' THEN greatest(0.08, gate - 0.12) ELSE gate END""")  # fmt: skip
def p7(s: SparkSession, d: str) -> DataFrame:
    alias = F.when(F.col("lang") == "en", F.col("lang")).otherwise("")
    return view(s, d, "fx_documents").where(r.displayable(F.col("title"), F.col("source"), F.col("doc_type"), F.col("relevance_score"), alias)).select("id")


@register("p8_keyword_filter", "SELECT id FROM fx_documents WHERE doc_type = 'filing' AND (contains(lower(title), 'tion') OR contains(lower(title), 'kunden') OR contains(lower(title), 'ment'))")
def p8(s: SparkSession, d: str) -> DataFrame:
    keys = F.array_distinct(F.split(F.lit("tion,kunden,tion,ment"), ","))
    return view(s, d, "fx_documents").where("doc_type = 'filing'").where(r.contains_any(F.col("title"), keys)).select("id")


@register("p9_changed_since", "SELECT id, run_id, source FROM fx_crawler_run_stats WHERE created_at > TIMESTAMP '2024-01-20 06:00:00'")
def p9(s: SparkSession, d: str) -> DataFrame:
    return r.changed_since(view(s, d, "fx_crawler_run_stats"), "created_at", F.lit("2024-01-20 06:00:00").cast("timestamp")).select("id", "run_id", "source")


@register("p10_source_kinds", """SELECT id, doc_type AS kind, CASE doc_type WHEN 'filing' THEN 'filing' WHEN 'report' THEN 'research' ELSE CASE WHEN source = 'sec_edgar' THEN 'filing' ELSE 'news' END END AS source_type,
  CASE doc_type WHEN 'filing' THEN 0.66 WHEN 'report' THEN 0.78 ELSE 0.46 END AS weight FROM fx_documents""")  # fmt: skip
def p10(s: SparkSession, d: str) -> DataFrame:
    kind, kept = r.card_source_type(F.col("doc_type"), F.col("source")), view(s, d, "fx_documents")
    return kept.select("id", r.source_kind(F.col("doc_type"), F.col("source")).alias("kind"), kind.alias("source_type"), r.card_weight(kind).alias("weight"))


@register("p11_selected_stocks", "SELECT code, market FROM fx_stocks WHERE is_active AND code IN ('000001', '000002', '000014', '000077')")
def p11(s: SparkSession, d: str) -> DataFrame:
    return r.active_universe(view(s, d, "fx_stocks"), None, ["000001", "000002", "000014", "000077"]).select("code", "market")


@register("p12_capped_scores", """SELECT id, CASE WHEN score >= 0.8 AND ticker = stock_code THEN relevance_score ELSE least(relevance_score, 0.18) END AS relevance_score, CASE WHEN score >= 0.8 AND ticker = stock_code THEN 'x' ELSE '' END AS matched_alias
  FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'OTHER' ELSE stock_code END AS ticker, CASE WHEN id % 5 = 0 THEN 0.5 ELSE 0.9 END AS score FROM fx_documents) AS t""")  # fmt: skip
def p12(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").withColumn("matched_alias", F.lit("x"))
    mapped = docs.select("id", F.when(F.col("id") % 4 == 0, "OTHER").otherwise(F.col("stock_code")).alias("ticker"), F.when(F.col("id") % 5 == 0, 0.5).otherwise(0.9).alias("score"))
    return r.capped_scores(docs, mapped).select("id", "relevance_score", "matched_alias")


@register("p13_page", f"SELECT id, TRUE AS has_more, 60 AS next_offset FROM (SELECT id FROM fx_documents ORDER BY {EVENT} DESC, id DESC LIMIT 20 OFFSET 40) AS t")
def p13(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    found = docs.select("id", r.event_time(docs).alias("t"))
    return r.page(found, [F.col("t").desc(), F.col("id").desc()], 40, 20).select("id", "has_more", "next_offset")


@register("p14_financial_listing", "SELECT entity_id, as_of_date, market_cap FROM (SELECT *, row_number() OVER (ORDER BY market_cap DESC, id) AS n FROM fx_financial_snapshots WHERE entity_id % 2 = 0) AS t WHERE n <= 50")
def p14(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_financial_snapshots").where("entity_id % 2 = 0").orderBy(F.col("market_cap").desc(), "id").limit(50).select("entity_id", "as_of_date", "market_cap")


@register("p15_lookup", "SELECT * EXCLUDE (price) FROM fx_stocks WHERE code = '000017'")
def p15(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_stocks").where("code = '000017'").drop("price")


@register("p16_query_containment", "SELECT id FROM fx_documents WHERE contains(lower(title), 'the') OR contains(lower(title), 'und')")
def p16(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_documents").where(r.contains_any(F.col("title"), F.array(F.lit("The"), F.lit("und")))).select("id")


@register("j1_documents_of_active", "SELECT d.id, s.name FROM fx_documents d JOIN fx_stocks s ON s.code = d.stock_code WHERE s.is_active")
def j1(s: SparkSession, d: str) -> DataFrame:
    stocks = view(s, d, "fx_stocks").where("is_active").select(F.col("code").alias("stock_code"), "name")
    return view(s, d, "fx_documents").join(stocks, "stock_code").select("id", "name")


@register("j2_sector_fan_out", "SELECT d.id, m.sector_code, m.confidence FROM fx_documents d JOIN fx_stocks s ON s.code = d.stock_code JOIN fx_stock_sector_map m ON m.stock_code = d.stock_code")
def j2(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").select("id", "stock_code")
    return docs.join(view(s, d, "fx_stocks").select(F.col("code").alias("stock_code")), "stock_code").join(view(s, d, "fx_stock_sector_map"), "stock_code").select("id", "sector_code", "confidence")


@register("j3_latest_document_of_stock", f"""SELECT code, id FROM fx_stocks LEFT JOIN (SELECT stock_code, id FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY {EVENT} DESC, id DESC) AS n FROM fx_documents) AS t WHERE n = 1) AS l ON stock_code = code WHERE is_active""")
def j3(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    latest = r.top_per_key(docs, ["stock_code"], [r.event_time(docs).desc(), F.col("id").desc()]).select(F.col("stock_code").alias("code"), "id")
    return view(s, d, "fx_stocks").where("is_active").select("code").join(latest, "code", "left")


@register("j4_not_normalised", "SELECT id FROM fx_documents WHERE id NOT IN (SELECT doc_id FROM labels)")
def j4(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_documents").select("id").join(view(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


@register("j5_pending_items", """SELECT d.id FROM fx_documents d JOIN fx_stocks s ON s.code = d.stock_code AND s.is_active LEFT JOIN labels l ON l.doc_id = d.id
  LEFT JOIN (SELECT id AS mid, CASE WHEN id % 4 = 0 THEN 'OTHER' ELSE stock_code END AS ticker, relevance_score AS score FROM fx_documents WHERE id % 2 = 0) AS m ON mid = d.id
  WHERE (l.doc_id IS NULL OR l.quality = 0) AND (mid IS NULL OR (ticker = d.stock_code AND score >= 0.55))""")  # fmt: skip
def j5(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").select("id", "stock_code", "relevance_score")
    stocks = view(s, d, "fx_stocks").where("is_active").select(F.col("code").alias("stock_code"))
    mapping = docs.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "OTHER").otherwise(F.col("stock_code")).alias("ticker"), F.col("relevance_score").alias("score"))
    summary = view(s, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    joined = docs.join(stocks, "stock_code").join(summary, "id", "left").join(mapping, "id", "left")
    return joined.where("(quality IS NULL OR quality = 0) AND (ticker IS NULL OR (ticker = stock_code AND score >= 0.55))").select("id")


@register("j6_sectors_of_market", "SELECT DISTINCT sector_code FROM fx_stock_sector_map WHERE stock_code IN (SELECT code FROM fx_stocks WHERE market = 'KR' AND is_active)")
def j6(s: SparkSession, d: str) -> DataFrame:
    stocks = view(s, d, "fx_stocks").where("market = 'KR' AND is_active").select(F.col("code").alias("stock_code"))
    return view(s, d, "fx_stock_sector_map").join(stocks, "stock_code", "left_semi").select("sector_code").distinct()


@register("j7_identity_lookup", "SELECT stock_code, source, url_hash, max(id) AS id FROM (SELECT stock_code, source, id, sha256(url) AS url_hash FROM fx_documents) AS t GROUP BY stock_code, source, url_hash")
def j7(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_documents").groupBy("stock_code", "source", F.sha2("url", 256).alias("url_hash")).agg(F.max("id").alias("id"))


@register("j8_reference_order", """WITH g AS (SELECT stock_code AS digest_id, list(id ORDER BY relevance_score DESC, id) AS refs FROM fx_documents GROUP BY stock_code),
  e AS (SELECT digest_id, unnest(refs) AS card_id, generate_subscripts(refs, 1) - 1 AS pos FROM g)
  SELECT digest_id, pos, card_id, id AS item_id, title, url FROM e LEFT JOIN (SELECT * FROM fx_documents WHERE id % 7 <> 0) AS d ON id = card_id""")  # fmt: skip
def j8(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    refs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("relevance_score")).alias("k"), "id"))), lambda x: x["id"])
    digests = docs.groupBy(F.col("stock_code").alias("digest_id")).agg(refs.alias("refs"))
    known = docs.where("id % 7 <> 0")
    return r.resolve_refs(digests, "refs", known.select(F.col("id").alias("card_id"), F.col("id").alias("item_id")), known).select("digest_id", "pos", "card_id", "item_id", "title", "url")


@register("j12_sector_names", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON regexp_replace(lower(s_name || ' (' || n_name || ')'), '\\([^)]*\\)|[^a-z0-9_]', '', 'g') = regexp_replace(lower(s_name), '[^a-z0-9_]', '', 'g') AND s_nationkey = n_nationkey")
def j12(s: SparkSession, d: str) -> DataFrame:
    nation = view(s, d, "nation")
    left = view(s, d, "supplier").withColumn("k", r.name_key(F.col("s_name")))
    named = left.join(nation, left["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", "n_name", r.name_key(F.concat("s_name", F.lit(" ("), "n_name", F.lit(")"))).alias("k"))
    return left.select("s_suppkey", "k").join(named, ["s_suppkey", "k"], "left").select("s_suppkey", "n_name")


@register("j13_line_sources", f"""SELECT stock_code, day, list(id ORDER BY id) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY stock_code, day, url ORDER BY id) AS n FROM (SELECT id, stock_code, url, CAST({EVENT} AS DATE) AS day FROM fx_documents) AS a) AS t WHERE n = 1 GROUP BY stock_code, day""")
def j13(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    one = r.top_per_key(docs.withColumn("day", F.to_date(r.event_time(docs))), ["stock_code", "day", "url"], [F.col("id")])
    return one.groupBy("stock_code", "day").agg(F.sort_array(F.collect_list("id")).alias("sources"))


@register("j14_mapping_audit", f"SELECT d.id, s.name, d.relevance_score FROM fx_documents d JOIN fx_stocks s ON s.code = d.stock_code JOIN labels l ON l.doc_id = d.id WHERE s.market = 'KR' ORDER BY {EVENT} DESC, d.id DESC LIMIT 50")
def j14(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    stocks = view(s, d, "fx_stocks").where("market = 'KR'").select(F.col("code").alias("stock_code"), "name")
    joined = docs.withColumn("t", r.event_time(docs)).join(stocks, "stock_code").join(view(s, d, "labels").select(F.col("doc_id").alias("id")), "id")
    return joined.orderBy(F.col("t").desc(), F.col("id").desc()).limit(50).select("id", "name", "relevance_score")


@register("j16_previous_snapshot", "SELECT entity_id, as_of_date, market_cap, lag(market_cap) OVER (PARTITION BY entity_id ORDER BY as_of_date) AS previous_market_cap FROM fx_financial_snapshots")
def j16(s: SparkSession, d: str) -> DataFrame:
    return r.as_of_previous(view(s, d, "fx_financial_snapshots").drop("id"), ["entity_id"], "as_of_date", "market_cap")


@register("j17_card_reuse", f"""SELECT id, last_value(CASE WHEN id % 3 = 0 THEN id END IGNORE NULLS) OVER (PARTITION BY url, lang ORDER BY {EVENT}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS card_of FROM fx_documents""")
def j17(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    by = Window.partitionBy("url", "lang").orderBy(r.event_time(docs), "id").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("card_of", F.last(F.when(F.col("id") % 3 == 0, F.col("id")), ignorenulls=True).over(by)).select("id", "card_of")


@register("j18_sector_top_stocks", """SELECT sector_code, code, n FROM (SELECT m.sector_code, s.code, row_number() OVER (PARTITION BY m.sector_code ORDER BY coalesce(s.rank, 99999), s.code) AS n FROM fx_stock_sector_map m JOIN fx_stocks s ON s.code = m.stock_code WHERE s.is_active) AS t WHERE n <= 5""")
def j18(s: SparkSession, d: str) -> DataFrame:
    stocks = view(s, d, "fx_stocks").where("is_active").select(F.col("code").alias("stock_code"), "rank")
    order = [F.coalesce("rank", F.lit(99999)), F.col("stock_code")]
    top = r.top_per_key(view(s, d, "fx_stock_sector_map").join(stocks, "stock_code"), ["sector_code"], order, 5)
    return top.select("sector_code", F.col("stock_code").alias("code"), F.row_number().over(Window.partitionBy("sector_code").orderBy(*order)).alias("n"))


@register("j20_sectors_of_stock", "SELECT stock_code, list(sector_code ORDER BY confidence DESC, sector_code) AS sectors FROM fx_stock_sector_map GROUP BY stock_code")
def j20(s: SparkSession, d: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("k"), "sector_code"))), lambda x: x["sector_code"])
    return view(s, d, "fx_stock_sector_map").groupBy("stock_code").agg(ordered.alias("sectors"))


@register("j22_ticker_keys", "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON lpad(upper(regexp_replace(replace(s.s_name, 'Supplier', ''), '\\W+', '', 'g')), 10, '0') = lpad(upper(regexp_replace(replace(c.c_name, 'Customer', ''), '\\W+', '', 'g')), 10, '0')")
def j22(s: SparkSession, d: str) -> DataFrame:
    left = view(s, d, "supplier").select("s_suppkey", r.ticker_key(F.replace("s_name", F.lit("Supplier"), F.lit(""))).alias("k"))
    return left.join(view(s, d, "customer").select("c_custkey", r.ticker_key(F.replace("c_name", F.lit("Customer"), F.lit(""))).alias("k")), "k").select("s_suppkey", "c_custkey")


@register("a1_sector_distribution", "SELECT m.sector_code, count(d.id) AS documents FROM fx_stock_sector_map m LEFT JOIN fx_documents d ON d.stock_code = m.stock_code GROUP BY m.sector_code HAVING count(d.id) > 0")
def a1(s: SparkSession, d: str) -> DataFrame:
    joined = view(s, d, "fx_stock_sector_map").join(view(s, d, "fx_documents").select("id", "stock_code"), "stock_code", "left")
    return joined.groupBy("sector_code").agg(F.count("id").alias("documents")).where("documents > 0")


@register("a2_recent_sectors", f"SELECT m.sector_code, count(*) AS documents FROM fx_stock_sector_map m JOIN fx_documents d ON d.stock_code = m.stock_code WHERE CAST({EVENT} AS DATE) >= CAST({NOW} AS DATE) - 1 GROUP BY m.sector_code")
def a2(s: SparkSession, d: str) -> DataFrame:
    recent = r.within_days(view(s, d, "fx_documents"), as_of(), 1).select("stock_code")
    return recent.join(view(s, d, "fx_stock_sector_map"), "stock_code").groupBy("sector_code").agg(F.count("*").alias("documents"))


@register("a3_latest_with_ties", "SELECT stock_code, trade_date FROM (SELECT stock_code, trade_date, rank() OVER (PARTITION BY stock_code ORDER BY date_trunc('month', trade_date) DESC) AS n FROM fx_price_bars) AS t WHERE n = 1")
def a3(s: SparkSession, d: str) -> DataFrame:
    return r.latest_with_ties(view(s, d, "fx_price_bars").withColumn("month", F.trunc("trade_date", "month")), ["stock_code"], "month").select("stock_code", "trade_date")


@register("a4_sector_documents", f"""WITH f AS (SELECT m.sector_code, d.source, d.url, d.id, d.title, d.doc_type, d.relevance_score, d.published_at, d.collected_at, {EVENT} AS t FROM fx_documents d JOIN fx_stock_sector_map m ON m.stock_code = d.stock_code)
  SELECT sector_code, source, url, arg_max(id, (t, id)) AS id, arg_max(doc_type, (t, id)) AS doc_type, arg_max(title, (length(title), t, id)) AS title, max(relevance_score) AS relevance_score,
    arg_min(published_at, (t, id)) FILTER (WHERE published_at IS NOT NULL) AS published_at, arg_min(collected_at, (t, id)) AS collected_at FROM f GROUP BY sector_code, source, url""")  # fmt: skip
def a4(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    fan = docs.withColumn("t", r.event_time(docs)).join(view(s, d, "fx_stock_sector_map").select("stock_code", "sector_code"), "stock_code")
    # Versions are walked from the newest to the oldest.
    seq = F.row_number().over(Window.partitionBy("sector_code", "source", "url").orderBy(F.col("t").desc(), F.col("id").desc()))
    return sinks.merge_richer(fan.withColumn("seq", seq), ["sector_code", "source", "url"], "seq").drop("body")


@register("a5_link_counts", "SELECT m.sector_code, count(d.id) AS linked_documents, count(DISTINCT d.stock_code) AS linked_stocks FROM fx_stock_sector_map m JOIN fx_documents d ON d.stock_code = m.stock_code GROUP BY m.sector_code")
def a5(s: SparkSession, d: str) -> DataFrame:
    joined = view(s, d, "fx_documents").select("id", "stock_code").join(view(s, d, "fx_stock_sector_map"), "stock_code")
    return joined.groupBy("sector_code").agg(F.count("id").alias("linked_documents"), F.count_distinct("stock_code").alias("linked_stocks"))


@register("a6_run_timings", "SELECT source, count(*) AS calls, round(sum(duration_ms), 3) AS total_ms, round(avg(duration_ms), 6) AS mean_ms, max(duration_ms) AS max_ms FROM fx_crawler_run_stats GROUP BY source")
def a6(s: SparkSession, d: str) -> DataFrame:
    v = F.col("duration_ms")
    return view(s, d, "fx_crawler_run_stats").groupBy("source").agg(F.count("*").alias("calls"), F.round(F.sum(v), 3).alias("total_ms"), F.round(F.avg(v), 6).alias("mean_ms"), F.max(v).alias("max_ms"))


@register("a6_slowest_calls", "SELECT id, source, duration_ms FROM fx_crawler_run_stats ORDER BY duration_ms DESC, id LIMIT 8")
def a6_slowest(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "fx_crawler_run_stats").orderBy(F.col("duration_ms").desc(), "id").limit(8).select("id", "source", "duration_ms")


@register("a7_ingest_funnel", "SELECT run_id, count(*) AS fetched, count(*) FILTER (WHERE source = 'purchase') AS inserted, count(*) FILTER (WHERE source = 'error') AS errors, min(created_at) AS started, max(created_at) AS ended FROM fx_crawler_run_stats GROUP BY run_id")
def a7(s: SparkSession, d: str) -> DataFrame:
    src = F.col("source")
    return view(s, d, "fx_crawler_run_stats").groupBy("run_id").agg(F.count("*").alias("fetched"), F.count_if(src == "purchase").alias("inserted"), F.count_if(src == "error").alias("errors"), F.min("created_at").alias("started"), F.max("created_at").alias("ended"))


@register("a12_week_changes", f"""SELECT stock_code, count(*) FILTER (WHERE age BETWEEN 0 AND 6) AS this_week, count(*) FILTER (WHERE age BETWEEN 7 AND 13) AS week_before, count(*) FILTER (WHERE age BETWEEN 0 AND 6 AND doc_type = 'report') AS reports
  FROM (SELECT stock_code, doc_type, CAST({NOW} AS DATE) - CAST({EVENT} AS DATE) AS age FROM fx_documents) AS t GROUP BY stock_code""")  # fmt: skip
def a12(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    age = F.datediff(F.to_date(as_of()), F.to_date(r.event_time(docs)))
    return docs.withColumn("age", age).groupBy("stock_code").agg(
        F.count_if(F.col("age").between(0, 6)).alias("this_week"), F.count_if(F.col("age").between(7, 13)).alias("week_before"), F.count_if(F.col("age").between(0, 6) & (F.col("doc_type") == "report")).alias("reports")
    )


@register("a13_active_by_market", "SELECT market, count(*) FILTER (WHERE is_active) AS active, list(code ORDER BY code) FILTER (WHERE rank = 1) AS leaders FROM fx_stocks GROUP BY market")
def a13(s: SparkSession, d: str) -> DataFrame:
    leaders = F.sort_array(F.collect_list(F.when(F.col("rank") == 1, F.col("code"))))
    return view(s, d, "fx_stocks").groupBy("market").agg(F.count_if("is_active").alias("active"), leaders.alias("leaders"))


@register("a15_freshness", "SELECT coalesce(CAST(max(CAST(collected_at AS DATE)) AS VARCHAR), '') AS updated FROM fx_documents d JOIN fx_stocks s ON s.code = d.stock_code WHERE s.is_active")
def a15(s: SparkSession, d: str) -> DataFrame:
    active = view(s, d, "fx_stocks").where("is_active").select(F.col("code").alias("stock_code"))
    return view(s, d, "fx_documents").join(active, "stock_code").agg(F.coalesce(F.max(F.to_date("collected_at")).cast("string"), F.lit("")).alias("updated"))


@register("w1_latest_per_key", "SELECT entity_id, id, market_cap FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY as_of_date DESC, id DESC) AS n FROM fx_financial_snapshots) AS t WHERE n = 1")
def w1(s: SparkSession, d: str) -> DataFrame:
    return r.top_per_key(view(s, d, "fx_financial_snapshots"), ["entity_id"], [F.col("as_of_date").desc(), F.col("id").desc()]).select("entity_id", "id", "market_cap")


@register("w2_pending_top_n", f"""SELECT stock_code, id FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, relevance_score DESC, {EVENT} DESC, id DESC) AS n FROM fx_documents) AS t WHERE n <= 3""")
def w2(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    order = [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("relevance_score").desc(), r.event_time(docs).desc(), F.col("id").desc()]
    return r.top_per_key(docs, ["stock_code"], order, 3).select("stock_code", "id")


@register("w3_latest_bars", "SELECT stock_code, trade_date FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY trade_date DESC) AS n FROM fx_price_bars) AS t WHERE n <= 30")
def w3(s: SparkSession, d: str) -> DataFrame:
    return r.top_per_key(view(s, d, "fx_price_bars"), ["stock_code"], [F.col("trade_date").desc()], 30).select("stock_code", "trade_date")


@register("w4_rank_assignment", "SELECT code, coalesce(rank, CAST(row_number() OVER (PARTITION BY market ORDER BY price DESC, code) AS INT)) AS rank FROM fx_stocks")
def w4(s: SparkSession, d: str) -> DataFrame:
    placed = r.numbered(keyed_stocks(s, d).select("id", "code", "market", "price", "rank"), [F.col("price").desc(), "code", "id"], "place", ["market"])
    return placed.select("code", F.coalesce("rank", F.col("place").cast("int")).alias("rank"))


@register("w7_newest_of_type", f"SELECT id, lang FROM fx_documents WHERE doc_type = 'filing' AND lang = 'en' ORDER BY {EVENT} DESC, id DESC LIMIT 20")
def w7(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").where("doc_type = 'filing' AND lang = 'en'")
    return docs.orderBy(r.event_time(docs).desc(), F.col("id").desc()).limit(20).select("id", "lang")


@register("u1_cards_of_sectors", """SELECT * FROM (SELECT m.sector_code, d.id, 'stock' AS via FROM fx_documents d JOIN fx_stock_sector_map m ON m.stock_code = d.stock_code WHERE d.published_at >= TIMESTAMP '2024-01-02 00:00:00'
  UNION ALL SELECT 'NEWS', id, 'sector' FROM fx_documents WHERE doc_type = 'news' AND published_at >= TIMESTAMP '2024-01-02 00:00:00') AS t ORDER BY id DESC, sector_code, via LIMIT 200""")  # fmt: skip
def u1(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").where(F.col("published_at") >= F.lit("2024-01-02").cast("timestamp"))
    own = docs.join(view(s, d, "fx_stock_sector_map"), "stock_code").select("sector_code", "id", F.lit("stock").alias("via"))
    direct = docs.where("doc_type = 'news'").select(F.lit("NEWS").alias("sector_code"), "id", F.lit("sector").alias("via"))
    return own.unionByName(direct).orderBy(F.col("id").desc(), "sector_code", "via").limit(200)


@register("u2_union_of_codes", "SELECT p_type AS code FROM part UNION SELECT p_brand FROM part UNION SELECT n_name FROM nation")
def u2(s: SparkSession, d: str) -> DataFrame:
    part = view(s, d, "part")
    return part.select(F.col("p_type").alias("code")).union(part.select("p_brand")).union(view(s, d, "nation").select("n_name")).distinct()


@register("u3_common_dates", "SELECT trade_date FROM fx_price_bars GROUP BY trade_date HAVING count(DISTINCT stock_code) = (SELECT count(DISTINCT stock_code) FROM fx_price_bars)")
def u3(s: SparkSession, d: str) -> DataFrame:
    return r.common_values(view(s, d, "fx_price_bars").select("stock_code", "trade_date"), "stock_code", "trade_date")


@register("u4_new_cards", "SELECT stock_code, id FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY id) AS n FROM fx_documents WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) AS t WHERE n <= 3")
def u4(s: SparkSession, d: str) -> DataFrame:
    old = view(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return r.top_per_key(view(s, d, "fx_documents").join(old, "id", "left_anti"), ["stock_code"], [F.col("id")], 3).select("stock_code", "id")


@register("u5_first_wins", """SELECT code, CAST(row_number() OVER (ORDER BY l, n, code) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY l, n) AS k FROM (
  SELECT 0 AS l, code, rank AS n FROM fx_stocks WHERE market = 'US' AND rank IS NOT NULL UNION ALL SELECT 1, code, CAST(row_number() OVER (ORDER BY price DESC, code) AS INT) FROM fx_stocks) AS u) AS t WHERE k = 1""")  # fmt: skip
def u5(s: SparkSession, d: str) -> DataFrame:
    stocks = view(s, d, "fx_stocks")
    listed = stocks.where("market = 'US' AND rank IS NOT NULL").select("code", "rank")
    by_price = r.numbered(stocks.select("code", "price"), [F.col("price").desc(), "code"], "rank").select("code", F.col("rank").cast("int").alias("rank"))
    return r.first_wins([listed, by_price], "code", "rank").select("code", "rank")


@register("o1_stable_top_k", f"SELECT id, relevance_score FROM fx_documents ORDER BY relevance_score DESC, {EVENT} DESC, id DESC LIMIT 40")
def o1(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    return docs.orderBy(F.col("relevance_score").desc(), r.event_time(docs).desc(), F.col("id").desc()).limit(40).select("id", "relevance_score")


@register("o2_visible_references", f"""SELECT stock_code, list(id ORDER BY n) FILTER (WHERE n <= 5) AS visible, greatest(count(*) - 5, 0) AS extra FROM (SELECT stock_code, id, row_number() OVER (PARTITION BY stock_code ORDER BY t DESC, id DESC) AS n
  FROM (SELECT stock_code, id, {EVENT} AS t, row_number() OVER (PARTITION BY stock_code, source, url ORDER BY id) AS k FROM fx_documents) AS a WHERE k = 1) AS b GROUP BY stock_code""")  # fmt: skip
def o2(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents")
    one = r.top_per_key(docs.withColumn("t", r.event_time(docs)), ["stock_code", "source", "url"], [F.col("id")])
    sorted_ids = F.transform(F.sort_array(F.collect_list(F.struct("t", "id")), asc=False), lambda x: x["id"])
    return one.groupBy("stock_code").agg(sorted_ids.alias("ids")).select("stock_code", F.slice("ids", 1, 5).alias("visible"), F.greatest(F.size("ids") - 5, F.lit(0)).cast("long").alias("extra"))


@register("o3_budget_prefix", """SELECT stock_code, id, CAST(n AS INT) AS n, total FROM (SELECT stock_code, id, row_number() OVER w AS n, sum(length(body)) OVER (PARTITION BY stock_code ORDER BY id ROWS UNBOUNDED PRECEDING) AS total FROM fx_documents WINDOW w AS (PARTITION BY stock_code ORDER BY id)) AS t
  WHERE (total <= 9000 OR n = 1) AND n <= 80""")  # fmt: skip
def o3(s: SparkSession, d: str) -> DataFrame:
    return r.budget_prefix(view(s, d, "fx_documents"), ["stock_code"], [F.col("id")], F.length("body"), 9000).select("stock_code", "id", "n", "total")


@register("o4_run_caps", "SELECT code FROM fx_stocks WHERE is_active ORDER BY market, coalesce(rank, 99999), code LIMIT 80")
def o4(s: SparkSession, d: str) -> DataFrame:
    return r.run_cap(view(s, d, "fx_stocks").where("is_active"), [F.col("market"), F.coalesce("rank", F.lit(99999)), F.col("code")], 80).select("code")


@register("o5_chunks", "SELECT stock_code, id, CAST(chunk AS BIGINT) AS chunk FROM (SELECT stock_code, id, (row_number() OVER (PARTITION BY stock_code ORDER BY id) - 1) // 12 AS chunk FROM fx_documents) AS t WHERE chunk < 8")
def o5(s: SparkSession, d: str) -> DataFrame:
    return r.chunks(view(s, d, "fx_documents"), ["stock_code"], [F.col("id")]).select("stock_code", "id", "chunk")


@register("o6_greedy_batches", """WITH RECURSIVE i AS (SELECT stock_code, id, CAST(length(body) AS BIGINT) AS size, row_number() OVER (PARTITION BY stock_code ORDER BY id) AS k FROM fx_documents),
  b AS (SELECT stock_code, id, size, k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, size AS t FROM i WHERE k = 1
  UNION ALL SELECT i.stock_code, i.id, i.size, i.k, CASE WHEN b.n >= 12 OR b.t + i.size > 6000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.n >= 12 OR b.t + i.size > 6000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 12 OR b.t + i.size > 6000 THEN i.size ELSE b.t + i.size END
  FROM b JOIN i ON i.stock_code = b.stock_code AND i.k = b.k + 1) SELECT stock_code, id, size, batch FROM b""")  # fmt: skip
def o6(s: SparkSession, d: str) -> DataFrame:
    return r.greedy_batches(view(s, d, "fx_documents"), ["stock_code"], "id", F.length("body"))


@register("s7_upsert", "SELECT id, title FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE title END AS title FROM fx_documents WHERE id % 2 = 0 OR id % 3 = 0) AS t")
def s7(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").select("id", "title")
    return sinks.upsert(docs.where("id % 2 = 0"), docs.where("id % 3 = 0").withColumn("title", F.lit("new")), ["id"])


@register("s8_insert_new", "SELECT stock_code, source, url, min(id) AS id FROM fx_documents WHERE (stock_code, source, url) NOT IN (SELECT (stock_code, source, url) FROM fx_documents WHERE id % 4 = 0) GROUP BY stock_code, source, url")
def s8(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").select("stock_code", "source", "url", "id")
    return sinks.insert_new(docs.where("id % 4 = 0"), docs, ["stock_code", "source", "url"], "id")


@register("s9_merge_richer", """SELECT stock_code, source, url, min(id) AS id, arg_min(doc_type, id) AS doc_type, arg_max(title, (length(title), -id)) AS title, max(relevance_score) AS relevance_score,
  arg_max(published_at, id) FILTER (WHERE published_at IS NOT NULL) AS published_at, arg_max(collected_at, id) AS collected_at FROM fx_documents GROUP BY stock_code, source, url""")  # fmt: skip
def s9(s: SparkSession, d: str) -> DataFrame:
    return sinks.merge_richer(view(s, d, "fx_documents").withColumn("seq", F.col("id")), ["stock_code", "source", "url"], "seq").drop("body")


@register("s10_replace_children", "SELECT stock_code, sector_code FROM fx_stock_sector_map WHERE CAST(stock_code AS INT) % 3 <> 0 UNION ALL SELECT code, brand FROM fx_stocks WHERE CAST(code AS INT) % 3 = 0")
def s10(s: SparkSession, d: str) -> DataFrame:
    new = view(s, d, "fx_stocks").where("CAST(code AS INT) % 3 = 0").select(F.col("code").alias("stock_code"), F.col("brand").alias("sector_code"))
    return sinks.replace_children(view(s, d, "fx_stock_sector_map").select("stock_code", "sector_code"), new, "stock_code")


@register("s11_guarded_upsert", "SELECT code, CASE WHEN is_active AND CAST(code AS INT) % 2 = 0 THEN name ELSE brand END AS name, is_active AND CAST(code AS INT) % 2 = 0 AS is_manual FROM fx_stocks")
def s11(s: SparkSession, d: str) -> DataFrame:
    stocks = keyed_stocks(s, d)
    old = stocks.select("id", "code", "name", (F.col("is_active") & (F.col("code").cast("int") % 2 == 0)).alias("is_manual"))
    return sinks.guarded_upsert(old, stocks.select("id", "code", F.col("brand").alias("name"), F.lit(False).alias("is_manual")), ["id"]).drop("id")


@register("s12_universe_refresh", """SELECT coalesce(o.code, n.code) AS code, coalesce(n.rank, o.rank) AS rank, n.code IS NOT NULL AS is_active FROM (SELECT code, rank FROM fx_stocks WHERE CAST(code AS INT) % 2 = 0) AS o
  FULL JOIN (SELECT code, coalesce(rank, CAST(row_number() OVER (ORDER BY price, code) AS INT)) AS rank FROM fx_stocks WHERE CAST(code AS INT) % 3 = 0) AS n ON n.code = o.code""")  # fmt: skip
def s12(s: SparkSession, d: str) -> DataFrame:
    stocks = view(s, d, "fx_stocks")
    new = stocks.where("CAST(code AS INT) % 3 = 0").select("code", "rank", F.struct("price", "code").alias("pos"))
    return sinks.refresh_universe(stocks.where("CAST(code AS INT) % 2 = 0"), new)


@register("s13_long_lines", "SELECT stock_code AS summary_id, CAST(n AS INT) AS line_no, title AS text, unnest([id, id + 1]) AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY id) AS n FROM fx_documents) AS t WHERE n <= 8")
def s13(s: SparkSession, d: str) -> DataFrame:
    top = r.top_per_key(view(s, d, "fx_documents"), ["stock_code"], [F.col("id")], 8)
    line = F.struct(F.col("title").alias("text"), F.array("id", F.col("id") + 1, "id").alias("source_ids"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return sinks.long_lines(top.groupBy(F.col("stock_code").alias("summary_id")).agg(lines.alias("lines")))


@register("d7_canonical_merge", """WITH k AS (SELECT id, arg_max(id, (collected_at, id)) OVER (PARTITION BY source, url) AS keep FROM fx_documents) SELECT DISTINCT keep AS doc_id, quality, toxic FROM labels JOIN k ON id = doc_id""")
def d7(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").withColumn("key", F.concat_ws("|", "source", "url"))
    return sinks.canonical_merge(docs, view(s, d, "labels").join(docs.select(F.col("id").alias("doc_id")), "doc_id"), "key", "doc_id")[1]


def stored(s: SparkSession, rows: DataFrame, keys: list[str], buckets: int = 16) -> Table:
    """A new stored table with the columns of rows, and rows as its first version."""
    table = Table.create(s, scratch(s, "table"), rows.schema, keys, buckets)
    table.commit(rows, lambda old, new: new)
    return table


@register("s7_stored_upsert", "SELECT id, title, CAST(CASE WHEN id % 3 = 0 THEN 3 WHEN id % 5 = 0 THEN 2 ELSE 1 END AS INT) AS version FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'newest' WHEN id % 5 = 0 THEN 'new' ELSE title END AS title FROM fx_documents WHERE id % 2 = 0 OR id % 3 = 0 OR id % 5 = 0) AS t")
def s7_stored(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "fx_documents").select("id", "title")
    put = lambda k, title, n: docs.where(f"id % {k} = 0").select("id", (F.lit(title) if title else F.col("title")).alias("title"), F.lit(n).alias("version"))
    table = stored(s, put(2, None, 1), ["id"])
    table.commit(put(5, "new", 2).unionByName(put(3, "new", 1)), sinks.upserts(["id"], "version"))
    table.commit(put(3, "newest", 3), sinks.upserts(["id"], "version"))
    return table.read()


@register("s8_counted_inserts", """WITH k AS (SELECT stock_code, source, url, bool_or(id % 4 = 0) AS known, count(*) AS n FROM fx_documents GROUP BY ALL)
  SELECT CAST((SELECT count(*) FROM fx_documents) AS BIGINT) AS offered, count(*) FILTER (WHERE NOT known) AS inserted, CAST(sum(n) - count(*) FILTER (WHERE NOT known) AS BIGINT) AS skipped, count(*) AS in_table FROM k""")  # fmt: skip
def s8_counted(s: SparkSession, d: str) -> DataFrame:
    """Counted by the jobs that write."""
    docs, keys = view(s, d, "fx_documents").select("stock_code", "source", "url", "id"), ["stock_code", "source", "url"]
    table = Table.create(s, scratch(s, "table"), docs.schema, keys, 16)
    table.commit(docs.where("id % 4 = 0"), sinks.inserts(keys, "id"))
    done = table.commit(docs, sinks.inserts(keys, "id"))
    return table.history().where(F.col("version") == done.version).select("offered", "inserted", "skipped", F.lit(done.counts["after"]).cast("long").alias("in_table"))


@register("a7_commit_counts", """WITH d AS (SELECT *, row_number() OVER (PARTITION BY stock_code, source, url ORDER BY CASE source WHEN 'naver_news' THEN 1 WHEN 'sec_edgar' THEN 2 ELSE 3 END, id) AS n FROM fx_documents)
  SELECT CAST(CASE source WHEN 'naver_news' THEN 1 WHEN 'sec_edgar' THEN 2 ELSE 3 END AS BIGINT) AS version, count(*) AS offered, count(*) FILTER (WHERE n = 1) AS inserted, count(*) FILTER (WHERE n > 1) AS skipped FROM d GROUP BY source""")  # fmt: skip
def a7_commits(s: SparkSession, d: str) -> DataFrame:
    """The documents of one source after another: what each commit of the table fetched, inserted and skipped."""
    docs, keys = view(s, d, "fx_documents").select("stock_code", "source", "url", "id"), ["stock_code", "source", "url"]
    table = Table.create(s, scratch(s, "table"), docs.schema, keys, 16)
    for source in ("naver_news", "sec_edgar", "naver_finance_research"):
        table.commit(docs.where(F.col("source") == source), sinks.inserts(keys, "id"))
    return table.history().where("version > 0")


@register("s9_stored_merge", """SELECT stock_code, source, url, min(id) AS id, arg_min(doc_type, id) AS doc_type, arg_max(title, (length(title), -id)) AS title, arg_max(body, (length(body), -id)) AS body, max(relevance_score) AS relevance_score,
  arg_max(published_at, id) FILTER (WHERE published_at IS NOT NULL) AS published_at, arg_max(collected_at, id) AS collected_at FROM fx_documents GROUP BY stock_code, source, url""")  # fmt: skip
def s9_stored(s: SparkSession, d: str) -> DataFrame:
    """The documents in three batches, each merged into what the buckets that it touches hold."""
    docs = view(s, d, "fx_documents").withColumn("seq", F.col("id"))
    keys = ["stock_code", "source", "url"]
    shape = sinks.merge_richer(docs, keys, "seq")
    table = Table.create(s, scratch(s, "table"), shape.schema, keys, 16)
    bounds = docs.approxQuantile("id", [1 / 3, 2 / 3], 0.01)
    for part in (F.col("id") < bounds[0], (F.col("id") >= bounds[0]) & (F.col("id") < bounds[1]), F.col("id") >= bounds[1]):
        table.commit(docs.where(part), sinks.richer(keys, "seq"))
    return table.read()


@register("s10_stored_children", "SELECT stock_code, sector_code FROM fx_stock_sector_map WHERE CAST(stock_code AS INT) % 3 <> 0 UNION ALL SELECT code, brand FROM fx_stocks WHERE CAST(code AS INT) % 3 = 0")
def s10_stored(s: SparkSession, d: str) -> DataFrame:
    table = stored(s, view(s, d, "fx_stock_sector_map").select("stock_code", "sector_code"), ["stock_code"])
    table.commit(view(s, d, "fx_stocks").where("CAST(code AS INT) % 3 = 0").select(F.col("code").alias("stock_code"), F.col("brand").alias("sector_code")), sinks.children("stock_code"))
    return table.read()


@register("s11_stored_guard", "SELECT code, CASE WHEN is_active AND CAST(code AS INT) % 2 = 0 THEN name ELSE brand END AS name, is_active AND CAST(code AS INT) % 2 = 0 AS is_manual FROM fx_stocks")
def s11_stored(s: SparkSession, d: str) -> DataFrame:
    stocks = keyed_stocks(s, d)
    table = stored(s, stocks.select("id", "code", "name", (F.col("is_active") & (F.col("code").cast("int") % 2 == 0)).alias("is_manual")), ["id"])
    table.commit(stocks.select("id", "code", F.col("brand").alias("name"), F.lit(False).alias("is_manual")), sinks.guards(["id"]))
    return table.read().drop("id")
