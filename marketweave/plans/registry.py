"""Where queries register. Views named fx_* are derived from the given tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The day that lookbacks of registered queries end on.
AS_OF = "2024-01-04 12:00:00"

VIEWS = {
    "fx_stocks": """SELECT lpad(CAST(p_partkey AS VARCHAR(20)), 6, '0') AS code, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'KR' ELSE 'US' END AS market, p_partkey % 11 <> 0 AS is_active,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS rank, p_type AS sector_code, p_brand AS brand, p_retailprice AS price FROM part""",
    "fx_stock_sector_map": """SELECT code AS stock_code, sector_code, CAST(0.9 AS DOUBLE) AS confidence FROM fx_stocks
        UNION ALL SELECT code, brand, CAST(0.6 AS DOUBLE) FROM fx_stocks WHERE rank IS NOT NULL""",
    "fx_documents": """SELECT d.doc_id AS id, lpad(CAST(d.doc_id % 50 AS VARCHAR(20)), 6, '0') AS stock_code,
        CASE WHEN d.doc_id % 3 = 0 THEN 'naver_news' WHEN d.doc_id % 3 = 1 THEN 'naver_finance_research' ELSE 'sec_edgar' END AS source,
        CASE WHEN d.doc_id % 3 = 0 THEN 'news' WHEN d.doc_id % 3 = 1 THEN 'report' ELSE 'filing' END AS doc_type,
        substr(d.text, 1, 80) AS title, d.text AS body, p.url AS url, d.lang AS lang, CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE e.ts END AS published_at,
        e.ts + INTERVAL '1' DAY AS collected_at, CAST(d.n_chars % 101 AS DOUBLE) / 100 AS relevance_score
        FROM documents d JOIN events e ON e.event_id = d.doc_id JOIN pages p ON p.page_id = d.doc_id % 50""",
    "fx_price_bars": """SELECT p_type AS stock_code, CAST(l_shipdate AS DATE) AS trade_date, min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
        avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0 GROUP BY p_type, CAST(l_shipdate AS DATE)""",
    "fx_financial_snapshots": """SELECT o_custkey AS entity_id, CAST(o_orderdate AS DATE) AS as_of_date, max(o_totalprice) AS market_cap, min(o_orderkey) AS id FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    "fx_crawler_run_stats": """SELECT event_id AS id, user_id % 20 AS run_id, event_type AS source, value AS duration_ms, ts AS created_at FROM events""",
    "fx_aliases": """SELECT ticker, alias, alias_type, weight FROM (
        SELECT lpad(CAST(item_id AS VARCHAR(20)), 6, '0') AS ticker, translate(split_part(replace(text, chr(10), ' '), ' ', 2), '.,', '') AS alias, 'official_name' AS alias_type, CAST(1.0 AS DOUBLE) AS weight FROM benchmark
        UNION ALL SELECT lpad(CAST(item_id AS VARCHAR(20)), 6, '0'), translate(split_part(replace(text, chr(10), ' '), ' ', 3), '.,', ''), 'corp_name', CAST(0.95 AS DOUBLE) FROM benchmark
        UNION ALL SELECT lpad(CAST(item_id AS VARCHAR(20)), 6, '0'), translate(split_part(replace(text, chr(10), ' '), ' ', 5), '.,', ''), 'short', CAST(0.9 AS DOUBLE) FROM benchmark) AS t WHERE length(alias) >= 2""",
    "fx_codes": """SELECT p_type AS code, row_number() OVER (ORDER BY p_type) AS pos FROM (SELECT DISTINCT p_type FROM part) AS t""",
    "fx_portfolios": """SELECT 'equal' AS portfolio_id, pos AS asset_pos, code, CAST(1 AS DOUBLE) AS weight FROM fx_codes
        UNION ALL SELECT 'balanced', pos, lower(code), CAST(CASE WHEN pos = 1 THEN 60 ELSE 40 END AS DOUBLE) FROM fx_codes WHERE pos <= 2
        UNION ALL SELECT 'weather', pos, code, CAST(CASE pos WHEN 1 THEN 30 WHEN 2 THEN 15 WHEN 3 THEN 40 WHEN 4 THEN 7.5 ELSE 7.5 END AS DOUBLE) FROM fx_codes WHERE pos <= 5
        UNION ALL SELECT 'weather', pos, code, CAST(0 AS DOUBLE) FROM fx_codes WHERE pos = 6""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or an fx_ view."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, frames = VIEWS[name], {}
    for dep in (*TABLES, *VIEWS):
        if re.search(rf"\b(FROM|JOIN) {dep}\b", sql):
            frames[dep] = view(spark, sf_dir, dep)
            sql = re.sub(rf"\b(FROM|JOIN) {dep}\b", rf"\1 {{{dep}}}", sql)
    return spark.sql(sql, **frames)


def keyed_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_stocks with id, the key of the part, which alone tells stocks apart: the view cuts codes after six digits, so several stocks share a code from a million parts on."""
    return spark.sql(VIEWS["fx_stocks"].replace(" FROM part", ", p_partkey AS id FROM {part}"), part=view(spark, sf_dir, "part"))


def _needed(sql: str) -> list[str]:
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in (*_needed(VIEWS[name]), name) if x not in found]
    return found


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its SQL gets the fx_ views that it names as common table expressions."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in _needed(sql))
            body = sql.strip()
            if views and body[:15].upper() == "WITH RECURSIVE ":
                body = f"WITH RECURSIVE {views}, {body[15:]}"
            elif views:
                body = f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
            ORACLE_SQL[name] = body
        return f

    return put
