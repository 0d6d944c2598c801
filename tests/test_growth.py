"""Steps whose cost grew too fast: what they compute, move and hold."""

import datetime as dt
import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketweave.functions import text as t
from marketweave.operators import dedup, resolve, similar
from marketweave.plans.registry import QUERIES
import marketweave.plans.all  # noqa: F401  registers the queries
from marketweave.streaming import jobs

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_are_worked_out_once(spark):
    assert not [x for x in plan(QUERIES["e18_sections"](spark, DATA)).splitlines() if "Filter" in x and "split(" in x]


def test_one_liner_tries_no_line_behind_the_first_that_fits(spark):
    df = spark.createDataFrame([(["the title", "first", "second"], "The  Title")], "lines array<string>, title string")
    tried = t.first_of(F.col("lines"), lambda x: F.when(x == "second", F.raise_error(F.lit("tried")).cast("boolean")).otherwise(x == "first"))
    assert df.select(tried).first()[0] == "first"
    assert df.select(t.one_liner(F.lit(None).cast("string"), F.col("lines"), F.col("title"), F.lit("x"))).first()[0] == "first"


def test_dates_are_parsed_as_by_all_patterns(spark):
    texts = ["2024.1.2.", "2024.1.2", "2024-1-2", "2024/1/2", "2024-13-1", "2024.2.30", "2024-01-02T03:04:05", "+12024-1-2", " 2024/01/02 ", "2024.1.2x", "3분 전", "", "2024-1", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    base = F.lit("2024-05-05 00:00:00").cast("timestamp")
    every = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(p)) for p in t.DATES], F.trim("x").try_cast("timestamp"))
    rows = df.select("x", t.parse_datetime(F.col("x"), base).cast("string").alias("a"), every.cast("string").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows if r["x"] != "3분 전") and [r["a"] for r in rows if r["x"] == "3분 전"] == ["2024-05-04 23:57:00"]


def test_feeds_move_rows_that_they_keep(spark):
    rows = [(None if k % 3 == 0 else "f", k % 40, dt.datetime(2024, 1, 1 + k % 7), "b" * k) for k in range(90)]
    docs = spark.createDataFrame(rows, "feed string, id long, event_time timestamp, body string")
    kept = dedup.newest(docs, "feed", 2)
    n = F.row_number().over(Window.partitionBy("feed").orderBy(F.col("event_time").desc(), F.col("id").desc()))
    expected = docs.withColumn("n", n).where("n <= 8").drop("n")
    assert sorted(map(str, kept.select("feed", "id", "event_time").collect())) == sorted(map(str, expected.select("feed", "id", "event_time").collect()))
    assert "LeftSemi" in plan(kept)


def test_workers_get_texts_in_batches_by_size(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    resolve.alias_matches(spark.createDataFrame([(1, "a b")], "id long, title string"), spark.createDataFrame([("a",)], "alias_l string"), ["title"])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(resolve.BATCH_BYTES)


def test_stocks_are_dealt_before_they_become_aliases(spark):
    lines = plan(QUERIES["r1_stock_aliases"](spark, DATA)).splitlines()
    at = lambda word: min(k for k, x in enumerate(lines) if word in x)
    assert at("Exchange") > at("Generate") and sum("Exchange hash" in x for x in lines) == 1


def test_leads_are_worked_out_after_texts_are_dealt(spark):
    assert "lead" not in QUERIES["j9_alias_matches"].__globals__["items"](spark, DATA).columns
    rows = [(1, "Title", "\n \nFirst  part\nrest"), (2, "Title", " \n"), (3, "T", None)]
    got = resolve._lowered(spark.createDataFrame(rows, "id long, title string, body string")).collect()
    assert {r["id"]: r["lead"] for r in got} == {1: "first part", 2: "title", 3: "t"}


def test_duplicates_are_marked_by_rows(spark):
    assert not hasattr(jobs, "pd")  # a frame for each content cost more than its state


def test_fuzzy_scores_move_hits_once_and_no_texts(spark):
    lines = plan(QUERIES["r7_fuzzy_ticker_scores"](spark, DATA)).splitlines()
    assert not [x for x in lines if "FullOuter" in x or ("Exchange" in x and "ticker" in x and "alias_l" in x)]
    scans = [k for k, x in enumerate(lines) if "FileScan" in x and "documents" in x and "text#" in x]
    depth = lambda k: len(lines[k]) - len(lines[k].lstrip(" :+-|"))
    for k in scans:  # a join above a text, on the way to its scan, has lost the text
        for j in range(k, -1, -1):
            if "MapInArrow" in lines[j] or "Generate" in lines[j]:
                break
            assert not (depth(j) < depth(k) and "Join" in lines[j])


def test_repeated_ids_count_as_often_as_they_stand(spark):
    rows = [(1, "alpha 5% up", "alpha"), (2, "beta", "gamma delta")]
    aliases = spark.createDataFrame([("T", "alpha", "short", 0.2), ("U", "delta", "corp_name", 0.5), ("V", "microsoft", "short", 1.0)], "ticker string, alias string, alias_type string, weight double")
    items = spark.createDataFrame(rows, "id long, title string, body string")
    own = spark.createDataFrame([(1,), (1,), (3,)], "id long")
    repeated = items.join(own, "id")
    expected = sorted(map(str, resolve.ticker_scores(repeated, aliases).collect()))
    assert expected and sorted(map(str, resolve.ticker_scores(items, aliases, among=own).collect())) == expected
    # Fuzzy hits multiplied a repeated text with itself.
    assert sorted(map(str, resolve.ticker_scores(repeated, aliases, fuzzy=True).collect())) == expected
    assert sorted(map(str, resolve.ticker_scores(items, aliases, fuzzy=True, among=own).collect())) == expected


def test_fuzzy_hits_join_those_of_other_fields(spark):
    items = spark.createDataFrame([(1, "microsofft", "about microsoft 5%"), (2, "microsofft", "none"), (3, "microsoft microsofft", "")], "id long, title string, body string")
    aliases = spark.createDataFrame([("T", "microsoft", "short", 1.0)], "ticker string, alias string, alias_type string, weight double")
    got = {r["id"]: r["score"] for r in resolve.ticker_scores(items, aliases, fuzzy=True).collect()}
    # 1: lead 4, body 2, fuzzy 2, numbers 2; 2: fuzzy alone; 3: title 5 and, as the lead is the title, 4, and no fuzzy points beside the title's.
    assert got == {1: 10.0, 2: 2.0, 3: 9.0}


def test_numbers_of_a_body_are_those_of_the_whole(spark):
    parts = ["", "up 5", "원", "5", "% x", "조 a", "ep", "s", "eps", "전", "망", "7 만", "a 3%", "x"]
    rows = [(a, b, c) for a in parts for b in parts for c in parts]
    df = spark.createDataFrame(rows, "title string, lead string, body string")
    assert df.where(resolve._numbers() != t.numeric_context(F.concat_ws(" ", "title", "lead", "body"))).count() == 0


def test_decisions_send_no_events_to_all(spark):
    for name in ("r9_status_counts", "r9_mapping_decisions", "r10_routes", "r8_sector_scores"):
        assert not [x for x in plan(QUERIES[name](spark, DATA)).splitlines() if "BroadcastHashJoin" in x and ("event_id" in x or "doc_id" in x.split("]")[0])]


def test_degrees_make_no_pairs_and_move_no_texts(spark):
    lines = plan(QUERIES["d8_title_degrees"](spark, DATA)).splitlines()
    assert [x for x in lines if "FlatMapGroupsInArrow" in x] and not [x for x in lines if "array_intersect" in x or "posexplode" in x]
    lines = plan(QUERIES["d8_title_degrees"].__globals__["titles"](spark, DATA)).splitlines()
    at = lambda word: min(k for k, x in enumerate(lines) if word in x)
    assert at("substring(text") > at("SortMergeJoin")  # below it


def test_degrees_of_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 9)
    rng = random.Random(4)
    words = [a + b for a in "abcdefg" for b in "xyz"]
    rows = [(rng.choice("ssst"), k // 2 if k > 190 else k, " ".join(sorted(rng.sample(words, rng.choice((1, 2, 3, 6, 9, 12)))))) for k in range(200)] + [("u", 1, "ax bx"), ("v", 1, "ax"), ("v", 2, "ax")]
    classes = {}
    for s, i, x in rows:
        classes.setdefault((s, x), []).append(i)
    want = {}
    for (s, x), held in classes.items():
        for (z, y), others in classes.items():
            o, k = len(set(x.split()) & set(y.split())), min(len(x.split()), len(y.split()))
            if s == z and min(held) != min(others) and o >= 2 and o / k >= 0.34:
                want[s, min(held)] = want.get((s, min(held)), 0) + len(others) * o / k
    found = similar.title_classes(spark.createDataFrame(rows, "stock string, id long, title string"), "stock")[1]
    got = {(x["stock"], x["class_id"]): x["beyond"] for x in similar.class_degrees(found, "stock").collect()}
    assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
