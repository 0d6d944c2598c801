"""Declared schemas of the tables, and typed scans: columns that a stored table lacks are null, others are cast, unknown ones are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stored import Table

#: Tables and columns.
SCHEMAS = {
    "stocks": "code string, name string, market string, is_active boolean, rank int, queries array<string>",
    "stock_sector_map": "stock_code string, sector_code string, confidence double, source string",
    "aliases": "ticker string, alias string, alias_type string, weight double, is_active boolean",
    "documents": "id long, stock_code string, source string, doc_type string, title string, body string, url string, url_hash string, published_at timestamp, collected_at timestamp, relevance_score double, matched_alias string",
    "raw_news_items": "item_id long, source_name string, feed_url string, title string, snippet string, original_url string, original_url_hash string, content_hash string, published_at timestamp, fetched_at timestamp, status string, duplicate_of_item_id long, raw_payload map<string,string>",
    "entity_map": "document_id long, entity_type string, entity_id string, score double, confidence string, is_primary boolean, reason string",
    "financial_snapshots": "stock_code string, as_of_date date, market_cap long, per double, pbr double, roe double, collected_at timestamp",
    "price_bars": "stock_code string, trade_date date, open double, high double, low double, close double, adj_close double, volume long",
    "evidence_cards": "card_id string, item_id long, entity_type string, entity_id string, market string, source_type string, source_url_hash string, published_at timestamp, fact_headline string, facts array<string>, interpretation string, risk_note string, topics array<string>, confidence_weight double",
    "stock_profiles": "stock_code string, market string, description_ko string, description_raw string, source string, source_url string, is_manual boolean, source_updated_at timestamp, collected_at timestamp, updated_at timestamp",
    "sectors": "sector_code string, sector_name_ko string, sector_name_en string, taxonomy_version string, is_active boolean, created_at timestamp, updated_at timestamp",
    "sector_master": "sector_id string, sector_name string, related_keywords array<string>, updated_at timestamp",
    "ticker_master": "ticker string, company_name string, corp_name string, short_code string, isin string, market_type string, base_date date, status string, updated_at timestamp",
    "company_codes": "stock_code string, corp_code string, corp_name string, updated_at timestamp",
    "normalized_news_items": "item_id long, normalized_title string, normalized_snippet string, normalized_body string, lead_paragraph string, body_paragraphs array<string>, journalist string, publisher string, published_at timestamp, normalized_at timestamp",
    "news_entity_map": "item_id long, entity_type string, entity_id string, score double, confidence string, is_primary boolean, reason string, created_at timestamp",
    "report_extracts": "document_id long, parse_status string, page_count int, text_excerpt string, facts array<string>, updated_at timestamp",
    "sector_documents": "id long, sector_code string, source string, doc_type string, title string, url string, published_at timestamp, body string, url_hash string, collected_at timestamp, linked_stock_count long, linked_document_count long",
    "sector_document_links": "sector_document_id long, document_id long, stock_code string, created_at timestamp",
    "summaries": "id long, stock_code string, as_of timestamp, lines array<struct<line_no:int,text:string,source_ids:array<bigint>>>, model string, created_at timestamp",
    "summary_sources": "summary_id long, line_no int, document_id long",
    "sector_summaries": "id long, sector_code string, as_of timestamp, lines array<struct<line_no:int,text:string,source_ids:array<bigint>>>, sentiment_label string, sentiment_confidence double, model string, created_at timestamp",
    "sector_summary_sources": "sector_summary_id long, line_no int, sector_document_id long",
    "item_summaries": "item_id long, short_summary string, impact_label string, feed_one_liner string, detail_bullets array<string>, related_refs array<struct<alias:string,card_id:string,item_id:bigint>>, prompt_version string, created_at timestamp, updated_at timestamp",
    "agent_reports": "entity_type string, entity_id string, market string, period_start date, period_end date, report_md string, refs array<struct<alias:string,card_id:string,item_id:bigint>>, created_at timestamp",
    "pipeline_runs": "id long, started_at timestamp, ended_at timestamp, trigger_type string, requested_stock_codes array<string>, stock_count long, fetched_docs long, inserted_docs long, skipped_docs long, summaries_written long, error_count long, status string, error_message string",
    "crawler_run_stats": "id long, run_id long, stock_code string, source string, doc_type string, fetched_count long, inserted_count long, skipped_count long, error_message string, attempt_count long, duration_ms long, created_at timestamp",
    "daily_digests": "entity_type string, entity_id string, market string, digest_date date, summary_lines array<string>, change_lines array<string>, open_questions array<string>, refs array<struct<alias:string,card_id:string,item_id:bigint>>",
}


def struct(table: str) -> StructType:
    """The declared columns of a table."""
    return StructType.fromDDL(SCHEMAS[table])


def typed(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a declared table, in their order and types."""
    want = struct(table)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table by its declared schema; only declared columns are read."""
    return typed(spark.read.parquet(path), table)


def new_table(spark: SparkSession, path: str, table: str, keys: Sequence[str], buckets: int = 64) -> Table:
    """An empty stored table with the declared columns, for the merges of operators.sinks."""
    return Table.create(spark, path, struct(table), keys, buckets)
