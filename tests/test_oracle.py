"""A few registered queries of each group against DuckDB; the driver compares all of them."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from marketweave.plans.registry import ORACLE_SQL, QUERIES, TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["b5_buy_and_hold", "b6_rebalanced_by_fold", "b9_metrics", "p7_displayable", "j5_pending_items", "a4_sector_documents", "w2_pending_top_n", "o6_greedy_batches", "s9_merge_richer", "f7_sentences", "d4_similar_titles", "r6_ticker_scores", "r10_routes", "e1_facts", "s2_price_payload", "t3_marked_duplicates", "e10_stock_summaries", "f23_packed_lines", "b7_contributions_with_costs", "b11_ledger", "b11_turnover"]


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    equals_sql(spark, name, DATA)


def equals_sql(spark, name, data):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(repr([plain(v) for v in row]) for row in cursor.fetchall())
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr([plain(row[c]) for c in columns]) for row in df.collect()) == expected


#: Queries of a row per stock.
PER_STOCK = ["e17_profile_priority", "s11_guarded_upsert", "s11_stored_guard", "s14_listings", "s15_company_codes"]


@pytest.fixture(scope="module")
def shared_codes(tmp_path_factory):
    """The test tables with parts of six to eight digits, whose codes are cut to six."""
    folder = tmp_path_factory.mktemp("shared")
    for table in TABLES:
        if table != "part":
            os.symlink(f"{DATA}/{table}.parquet", folder / f"{table}.parquet")
    duckdb.sql(f"""COPY (SELECT p.* REPLACE (k AS p_partkey) FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM '{DATA}/part.parquet') AS p
      JOIN (SELECT k, row_number() OVER (ORDER BY k) AS n FROM (SELECT unnest([1, 100000, 100001, 100002, 1000000, 1000001, 1000002, 1000013, 1000017, 1000020, 10000000, 10000011, 10000205]) AS k)) USING (n)) TO '{folder}/part.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", PER_STOCK)
def test_stocks_that_share_a_code_stay_apart(spark, shared_codes, name):
    equals_sql(spark, name, shared_codes)


def test_equal_stocks_are_placed_by_their_key(spark, tmp_path):
    keys = [1000006 + 14 * k for k in range(8)]  # without a rank of their own, in one market
    values = ", ".join(f"({k}, 'n', 't', 'b', 5, 9.5)" for k in [*reversed(keys), 100000])
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) AS t(p_partkey, p_name, p_type, p_brand, p_size, p_retailprice)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    got = sorted((x["code"], x["rank"]) for x in QUERIES["w4_rank_assignment"](spark, str(tmp_path)).collect())
    assert got == [("100000", 2), ("100000", 5), *[(str(k)[:6], n) for n, k in enumerate(keys[1:], 3)]]


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    """The test tables with documents without text, with texts that begin with 80 blanks or hold nothing else, and with one that stands twice."""
    folder = tmp_path_factory.mktemp("odd")
    for table in TABLES:
        if table != "documents":
            os.symlink(f"{DATA}/{table}.parquet", folder / f"{table}.parquet")
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE doc_id % 50 WHEN 1 THEN NULL WHEN 2 THEN repeat(' ', 80) || 'demand and orders' WHEN 3 THEN '' WHEN 4 THEN repeat(chr(10), 90) ELSE text END AS text) FROM '{DATA}/documents.parquet'
      UNION ALL SELECT * FROM '{DATA}/documents.parquet' WHERE doc_id = 7 UNION ALL SELECT * REPLACE ('revenue and dispute' AS text) FROM '{DATA}/documents.parquet' WHERE doc_id = 8) TO '{folder}/documents.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["a8_report_ready", "a9_top_topics"])
def test_documents_without_title_count(spark, odd_documents, name):
    equals_sql(spark, name, odd_documents)


@pytest.mark.parametrize("name", ["d8_title_degrees", "d4_title_classes"])
def test_titles_of_one_id_are_classes_of_their_own(spark, odd_documents, name):
    equals_sql(spark, name, odd_documents)


def test_no_cartesian_product_in_text_joins(spark):
    for name in ("j9_alias_matches", "r6_ticker_scores", "d4_similar_titles", "d8_title_graph"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
