import datetime as dt
import random
import re
from difflib import SequenceMatcher
from html.parser import HTMLParser

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marketweave.functions import text as t
from marketweave.operators import dedup, evidence, resolve, similar, sinks, stored, summaries
from marketweave.operators import relational as r
from marketweave.operators.stored import Table
from marketweave.sources import logs, payloads, schemas
from marketweave.streaming import jobs

T0 = dt.datetime(2024, 1, 4, 12)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_lookback_counts_the_whole_boundary_day(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 0, 1), T0), (2, dt.datetime(2024, 1, 1, 23, 59), T0), (3, None, dt.datetime(2024, 1, 3))], "id long, published_at timestamp, collected_at timestamp")
    assert {x["id"] for x in r.within_days(rows, F.lit("2024-01-04 12:00:00").cast("timestamp"), 2).collect()} == {1, 3}


def test_latest_keeps_ties_only_where_asked(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4)], "k string, id long, ts long")
    assert r.latest_with_ties(rows, ["k"], "ts").count() == 2
    assert [x["id"] for x in r.top_per_key(rows, ["k"], [F.col("ts").desc(), F.col("id").desc()]).collect()] == [2]


def test_normalized_urls(spark):
    cases = {
        "HTTPS://Example.com//a//b?b=2&utm_source=x&a=1&a=9&c=#frag": "https://example.com/a/b?a=1&b=2", "http://example.com": "http://example.com/", "": "", None: "",
        "https://n.news.naver.com/mnews/article/001/0012?sid=1": "https://n.news.naver.com/article/001/0012", "https://news.naver.com/main/read.nhn?oid=022&aid=77": "https://n.news.naver.com/article/022/77",
        "https://finance.naver.com/research/Company_Read.naver?nid=5&page=3": "https://finance.naver.com/research/company_read.naver?nid=5",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", t.normalize_url(F.col("u")).alias("n")).collect()
    assert {x["u"]: x["n"] for x in rows} == cases


def test_korean_titles_lose_particles_and_stop_words(spark):
    assert value(spark, t.title_tokens(F.lit("[속보] 삼성전자가 (종합) 실적을 발표했다 한국전력은"))) == ["삼성전자", "실적", "발표", "전력"]


def test_relative_times(spark):
    base = F.lit("2024-01-04 12:00:00").cast("timestamp")
    got = [value(spark, t.parse_datetime(F.lit(x), base)) for x in ("5분 전", "2 시간 전", "3일전", "2024.01.02.", "2024-1-2", "2024-01-02T03:04:05Z", "soon", "")]
    assert got == [dt.datetime(2024, 1, 4, 11, 55), dt.datetime(2024, 1, 4, 10), dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), None, None]


def test_advice_is_replaced_and_lines_differ(spark):
    got = value(spark, t.sanitize_lines(F.array(*[F.lit(x) for x in ("Strong Buy now", "a  b", "A B", "", "c")])))
    assert got == [t.ADVICE_REPLACEMENT, "a b", "c"]


def test_upsert_is_idempotent_and_the_last_version_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, version long")
    once = sinks.upsert(old, new, ["id"], "version")
    twice = sinks.upsert(once, new, ["id"], "version")
    assert sorted(once.collect()) == sorted(twice.collect()) == [Row(id=1, v="a", version=0), Row(id=2, v="d", version=2), Row(id=3, v="e", version=1)]


def some_table(spark, path, rows, buckets=8):
    table = Table.create(spark, path, spark.createDataFrame([], "id long, v string, version long").schema, ["id"], buckets)
    table.commit(spark.createDataFrame(rows, "id long, v string, version long"), sinks.upserts(["id"], "version"))
    return table


def test_commits_touch_their_buckets_only_and_readers_keep_their_version(spark, tmp_path):
    table = some_table(spark, f"file://{tmp_path}/t", [(i, "a", 0) for i in range(40)])
    before = table.read()
    old = table.snapshot()
    done = table.commit(spark.createDataFrame([(1, "b", 1), (1, "c", 2), (99, "d", 1)], "id long, v string, version long"), sinks.upserts(["id"], "version"))
    changed = {b for b in done.folders if done.folders[b] != old.folders.get(b)}
    assert 1 <= len(changed) <= 2 and len(old.folders) == 8
    assert sorted(tuple(x) for x in before.collect()) == [(i, "a", 0) for i in range(40)]
    now = {x["id"]: x["v"] for x in table.read().collect()}
    assert now == {**{i: "a" for i in range(40)}, 1: "c", 99: "d"} and table.read(1).count() == 40
    assert done.counts["offered"] == 3 and done.counts["after"] - done.counts["before"] == 1
    assert {x["id"] for x in table.changed(1).collect()} >= {1, 99} and len(set(table.changed(1).inputFiles())) == len(changed)
    assert [tuple(x) for x in table.history().orderBy("version").collect()] == [(0, 0, 0, 0), (1, 40, 40, 0), (2, 3, 1, 2)]
    assert table.vacuum(keep=1) > 0 and {x["id"]: x["v"] for x in table.read().collect()} == now and table.versions() == [2]


def test_a_writer_that_dies_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = some_table(spark, f"file://{tmp_path}/t", [(1, "a", 0), (2, "b", 0)])

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(stored, "_put", dies)
        with pytest.raises(OSError, match="gone"):
            table.commit(spark.createDataFrame([(1, "x", 5)], "id long, v string, version long"), sinks.upserts(["id"]))
    assert sorted(x["v"] for x in table.read().collect()) == ["a", "b"] and table.versions() == [0, 1]
    with pytest.raises(Exception, match="no such"):  # nor does one that fails while it merges
        table.commit(spark.createDataFrame([(1, "x", 5)], "id long, v string, version long"), lambda old, new: old.withColumn("v", F.raise_error(F.lit("no such")).cast("string")))
    assert sorted(x["v"] for x in table.read().collect()) == ["a", "b"]


def test_commits_that_meet_are_both_kept(spark, tmp_path):
    schema = "id long, v string, version long"
    table = some_table(spark, f"file://{tmp_path}/t", [(i, "a", 0) for i in range(20)], 4)
    calls = []

    def meets(old, new):
        if not calls:
            calls.append(1)
            Table(spark, table.path).commit(spark.createDataFrame([(i, "other", 1) for i in range(20)], schema), sinks.upserts(["id"], "version"))
        calls.append(2)
        return sinks.upserts(["id"], "version")(old, new)

    table.commit(spark.createDataFrame([(3, "mine", 2)], schema), meets)
    assert {x["id"]: x["v"] for x in table.read().collect()} == {**{i: "other" for i in range(20)}, 3: "mine"} and calls == [1, 2, 2]
    again = table.commit(spark.createDataFrame([(4, "once", 3)], schema), sinks.upserts(["id"]), "feed", 7)
    assert table.commit(spark.createDataFrame([(4, "twice", 3)], schema), sinks.upserts(["id"]), "feed", 7).version == again.version
    assert table.read().where("id = 4").first()["v"] == "once"
    emptied = table.commit(spark.createDataFrame([(i, "", 0) for i in range(20)], schema), lambda old, new: old.where("false"))
    assert emptied.folders == {} and table.read().count() == 0 and table.commit(table.read(), sinks.upserts(["id"])).counts["offered"] == 0


def test_first_rows_are_the_same_in_any_order_of_batches(spark, tmp_path):
    rng, schema = random.Random(3), "url string, published long, item long"
    rows = [(f"u{rng.randint(0, 9)}", rng.randint(0, 5), i) for i in range(60)]
    want = {u: min((p, i) for x, p, i in rows if x == u) for u in {r[0] for r in rows}}
    for n in range(2):
        rng.shuffle(rows)
        table = Table.create(spark, f"file://{tmp_path}/t{n}", spark.createDataFrame([], schema).schema, ["url"], 4)
        for k in range(0, 60, 20):
            table.commit(spark.createDataFrame(rows[k : k + 20], schema), sinks.firsts(["url"], ["published", "item"]))
        assert {x["url"]: (x["published"], x["item"]) for x in table.read().collect()} == want


def test_places_over_ranges_of_tasks(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("ab"), rng.randint(0, 9), i) for i in range(500)] + [(None, 1, 1_000), (None, 0, 1_001)]
    df = spark.createDataFrame(rows, "k string, v int, id long")
    plain = r.numbered(df, [F.col("v").desc(), "id"], "n")
    assert [x["id"] for x in plain.orderBy("n").collect()] == [i for _, _, i in sorted(rows, key=lambda x: (-x[1], x[2]))] and plain.agg(F.max("n")).first()[0] == 502
    assert "SinglePartition" not in plain._jdf.queryExecution().executedPlan().toString()
    by = {}
    for k, _, i in sorted(rows, key=lambda x: (-x[1], x[2])):
        by.setdefault(k, []).append(i)
    keyed = r.numbered(df, [F.col("v").desc(), "id"], "n", ["k"])
    assert {(x["k"], x["id"]): x["n"] for x in keyed.collect()} == {(k, i): n + 1 for k, ids in by.items() for n, i in enumerate(ids)}
    assert r.numbered(df.limit(0), ["id"], "n").count() == 0


def test_packing_goes_on_across_arrow_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), i, rng.choice([0, 10, 500, 3000, 7000, None])) for i in range(400)]
    expected = {}
    for key in {k for k, _, _ in rows}:
        batch, n, total = 0, 0, 0
        for i, s in sorted((i, s or 0) for k, i, s in rows if k == key):
            if n and (n >= 12 or total + s > 6000):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + s
            expected[key, i] = batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = r.greedy_batches(spark.createDataFrame(rows, "k string, id long, s int"), ["k"], "id", F.col("s")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x["k"], x["id"]): x["batch"] for x in got} == expected


def test_richer_text_wins_and_ties_keep_the_older(spark):
    rows = spark.createDataFrame([(1, "u", "news", "ab", None, 0.5, T0, T0, 1), (2, "u", "report", "cd", "x", 0.2, None, T0, 2)], "id long, url string, doc_type string, title string, body string, relevance_score double, published_at timestamp, collected_at timestamp, seq long")
    got = sinks.merge_richer(rows, ["url"], "seq").first()
    assert (got["id"], got["title"], got["body"], got["relevance_score"], got["published_at"], got["doc_type"]) == (1, "ab", "x", 0.5, T0, "news")


def test_manual_rows_stay_unless_forced(spark):
    old = spark.createDataFrame([("a", "mine", True)], "k string, v string, is_manual boolean")
    new = spark.createDataFrame([("a", "theirs", False)], "k string, v string, is_manual boolean")
    assert sinks.guarded_upsert(old, new, ["k"]).first()["v"] == "mine" and sinks.guarded_upsert(old, new, ["k"], force=True).first()["v"] == "theirs"


def test_children_move_to_the_newest_document_of_a_key(spark):
    docs = spark.createDataFrame([(1, "k", T0), (2, "k", T0), (3, "k", T0 - dt.timedelta(1)), (4, "l", T0)], "id long, key string, collected_at timestamp")
    children = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x"), (9, "z")], "doc_id long, v string")
    kept, moved = sinks.canonical_merge(docs, children, "key", "doc_id")
    assert {x["id"] for x in kept.collect()} == {2, 4}
    assert sorted((x["doc_id"], x["v"]) for x in moved.collect()) == [(2, "x"), (2, "y"), (4, "x"), (9, "z")]


def test_aliases_match_at_word_borders(spark):
    for text, alias, hit in [("sk hynix up", "sk", True), ("risk up", "sk", False), ("삼성전자가", "삼성전자", True), ("a.b", "a.b", True), ("005930x", "005930", False)]:
        assert value(spark, resolve.contains_alias(F.lit(text), F.lit(alias))) is hit
    texts = spark.createDataFrame([(1, "sk hynix and 삼성전자가")], "id long, title string")
    aliases = spark.createDataFrame([("sk hynix",), ("삼성전자",), ("lg",), ("전자",)], "alias_l string")
    assert {x["alias_l"] for x in resolve.alias_matches(texts, aliases, ["title"]).collect()} == {"sk hynix", "삼성전자", "전자"}


def test_alias_matches_equal_brute_force_at_any_size(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = ["a", "b", "1", ".", "-", " ", "가", "나", "é", "&"]
    texts = [(i, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2))) for i in range(80)]
    texts += [(90, "국가 b 정책 발표", "가 b 발표"), (91, None, ""), (92, "abababababababab", None), (90, "국가 b 정책 발표", "가 b 발표")]
    aliases = ["가 b", "가", "b", "1", "ab", "abab", ".", "a.b", "-", "&", "나가", "é", "", "1b", "abababababababab"] + ["".join(rng.choice(alphabet[:8]) for _ in range(rng.randint(1, 3))) for _ in range(30)]
    rows = [(a, f"T{k}", "xy"[k % 2]) for k, a in enumerate(aliases)] + [("가 b", "other", "x")]
    left = spark.createDataFrame(texts, "id long, title string, body string")
    right = spark.createDataFrame(rows, "alias_l string, ticker string, body_hit string").drop("body_hit")

    def holds(text, alias):
        if not text or not alias:
            return False
        return bool(re.search(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9])", text)) if re.fullmatch(r"[a-z0-9.\-]+", alias) else alias in text

    expected = sorted((i, k, a, holds(t, a), holds(b, a)) for i, t, b in texts for a, k, _ in rows if holds(t, a) or holds(b, a))
    for most in (200_000, 7):
        monkeypatch.setattr(resolve, "MOST_ALIASES", most)
        got = resolve.alias_matches(left, right, ["title", "body"]).select("id", "ticker", "alias_l", "title_hit", "body_hit")
        assert sorted(tuple(x) for x in got.collect()) == expected
    codes = spark.createDataFrame([("005930", resolve.NUMBER), ("ab1", resolve.ANYWHERE)], "alias_l string, border string")
    held = spark.createDataFrame([(1, "x005930y"), (2, "1005930"), (3, "cab12"), (4, "005930 0059301")], "id long, title string")
    assert sorted((x["id"], x["alias_l"]) for x in resolve.alias_matches(held, codes, ["title"]).collect()) == [(1, "005930"), (3, "ab1"), (4, "005930")]


def test_points_are_capped_on_the_way(spark):
    items = spark.createDataFrame([(1, "alpha beta group", "alpha beta group", "alpha beta group")], "id long, title string, lead string, body string")
    aliases = spark.createDataFrame([("T", "alpha", "official_name", 1.0), ("T", "beta", "short", 1.0), ("U", "group", "short", 1.0)], "ticker string, alias string, alias_type string, weight double")
    got = {x["ticker"]: x["score"] for x in resolve.ticker_scores(items, aliases).collect()}
    assert got == {"T": 12.0, "U": 5.0 + 4.0 + 2.0 - 3.0 - 2.0}


def test_decisions_at_their_edges(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    tickers = spark.createDataFrame([(1, "A", 10.0, 1), (1, "B", 7.0, 2), (2, "A", 9.0, 1), (2, "B", 7.0, 2), (3, "A", 9.0, 1), (3, "B", 6.5, 2), (4, "A", 5.0, 1)], "id long, ticker string, score double, place int")
    sectors = spark.createDataFrame([(3, "X", 9.0), (4, "X", 6.0), (5, "X", 5.9)], "id long, sector string, score double")
    got = {x["id"]: (x["status"], x["primary"]) for x in resolve.decisions(items, tickers, sectors).collect()}
    assert got == {1: ("mapped_ticker", "A"), 2: ("mapped_ticker_multi", "A"), 3: ("unassigned", None), 4: ("mapped_sector", "X"), 5: ("unassigned", None)}


def test_fuzzy_titles_find_near_spellings(spark):
    texts = spark.createDataFrame([(1, "shares of microsofft rise"), (2, "microscope")], "id long, title string")
    aliases = spark.createDataFrame([("microsoft",)], "alias_l string")
    assert [(x["id"], x["alias_l"]) for x in resolve.fuzzy_titles(texts, aliases).collect()] == [(1, "microsoft")]


def test_fuzzy_titles_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["abababababababab", "aaaaaaaaaaaaa", "samsungelectronics", "microsoft", "abcabcabcabc", "hynixhynix", "aaaa"] + ["".join(rng.choice("ab") for _ in range(rng.randint(2, 30))) for _ in range(40)]

    def changed(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + rng.choice("abx") + w[k:], w[:k] + w[k + 1 :], w[:k] + "x" + w[k + 1 :], w])

    titles = [(i, " ".join(changed(changed(rng.choice(words))) for _ in range(6))) for i in range(60)]
    titles.append((99, "ababababababababa other"))
    alike = lambda a, b: abs(len(a) - len(b)) <= 2 and SequenceMatcher(a=a, b=b).ratio() >= 0.92
    expected = {(i, w) for i, x in titles for w in words if len(w) >= 4 and any(len(y) >= 2 and alike(w, y) for y in x.split())}
    got = {(x["id"], x["alias_l"]) for x in resolve.fuzzy_titles(spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame([(w,) for w in words], "alias_l string")).collect()}
    assert got == expected and (99, "abababababababab") in got


def alike_titles(x, y):
    u, v = set(x.split()), set(y.split())
    o, small, large = len(u & v), min(len(u), len(v)), max(len(u), len(v))
    return x == y or (min(len(x), len(y)) >= 12 and (x in y or y in x)) or (o >= 3 and o / small >= 0.8) or (o >= 4 and o / large >= 0.67)


def test_similar_titles_of_whole_tables_equal_brute_force(spark):
    rng = random.Random(8)
    words = [a + b for a in ("al", "be", "ga", "de") for b in ("pha", "ta", "mma", "lta", "zeta")]
    rows = []
    for i in range(220):
        base = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        rows.append((rng.choice("st"), i, " ".join(base)))
        if rng.random() < 0.4:
            k = rng.randrange(len(base))
            rows.append((rows[-1][0], 1_000 + i, rng.choice([" ".join(base), " ".join(base[:k] + [rng.choice(words)] + base[k + 1 :]), " ".join([*base, rng.choice(words)]), "x" + " ".join(base) + "y"])))
    rows += [("s", 5_000, None), ("s", 5_001, ""), ("s", 5_002, "a"), ("t", 5_003, "onesinglelongword"), ("t", 5_004, "theonesinglelongwords"), ("s", 5_005, rows[0][2])]
    docs = spark.createDataFrame(rows, "stock string, id long, title string")
    norm = {(s, i): " ".join((x or "").split()) for s, i, x in rows if any(len(w) > 1 for w in (x or "").split())}
    want = {}
    for (s, i), x in norm.items():
        want[s, i] = (min(j for (r_, j), y in norm.items() if r_ == s and y == x), sum(alike_titles(x, y) for (r_, j), y in norm.items() if r_ == s) - 1)
    assert {(x["stock"], x["id"]): (x["class_id"], x["links"]) for x in similar.title_links(docs, "stock").collect()} == want
    weight = lambda x, y: (lambda o, n: o / n if o >= 2 and o / n >= 0.34 else 0.0)(len(set(x.split()) & set(y.split())), min(len(set(x.split())), len(set(y.split()))))
    degree = {(s, i): sum(weight(x, y) for (r_, j), y in norm.items() if r_ == s and j != i) for (s, i), x in norm.items()}
    got = {(x["stock"], x["id"]): x["degree"] for x in similar.title_degrees(docs, "stock").collect()}
    assert got.keys() == degree.keys() and all(abs(got[k] - degree[k]) < 1e-9 for k in got)


def test_a_word_in_a_third_of_all_titles_makes_no_candidates(spark):
    def met(n):
        rows = [("s", i, ("common " if i % 3 == 0 else "") + " ".join(f"w{(i * 7 + k) % (n * 4)}x{k}" for k in range(5))) for i in range(n)]
        _, classes = similar.title_classes(spark.createDataFrame(rows, "stock string, id long, title string"), "stock")
        pairs = similar.candidates(classes, "stock", lambda x: F.greatest(F.lit(2), F.ceil(0.34 * x)))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        return classes.where(F.array_contains("w", "common")).count(), pairs.count()

    small, large = met(150), met(600)
    assert large[0] == 4 * small[0] == 200 and large[1] <= 4 * max(small[1], 5)  # of 200 titles with the word, all pairs would be 19,900


def test_candidate_titles_meet_once_and_are_not_shuffled(spark):
    rows = [("s", i, f"alpha beta gamma own{i % 40}") for i in range(80)]
    classes = similar.title_classes(spark.createDataFrame(rows, "stock string, id long, title string"), "stock")[1]
    pairs = similar.candidates(classes, "stock", lambda n: F.lit(2))
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert pairs.count() == pairs.distinct().count() == 40 * 39 // 2


def test_logs_are_read_by_period_and_by_arrival(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1 + i % 6, 1 + i % 28, 3)) for i in range(120)] + [(500, None)]
    schema = "id long, at timestamp"
    log = logs.PeriodLog(spark, f"file://{tmp_path}/log", spark.createDataFrame([], schema).schema, "at")
    assert log.read().count() == 0 and log.new_rows("r", lambda x: None) == -1
    for k in range(3):
        assert log.append(spark.createDataFrame(rows[40 * k : 40 * k + 40 + k // 2], schema)) == k
    assert log.append(spark.createDataFrame(rows, schema), 1) == 1 and log.read().count() == 121  # offered again
    lit = lambda x: F.lit(x).cast("timestamp")
    some = log.between(lit("2024-02-10 00:00:00"), lit("2024-03-05 12:00:00"))
    assert {x["id"] for x in some.collect()} == {i for i, at in rows if at and dt.datetime(2024, 2, 10) <= at <= dt.datetime(2024, 3, 5, 12)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "PushedFilters: [IsNotNull(at)" in plan
    seen = []
    work = lambda x: seen.append((sorted(r["id"] for r in x.collect()), {f.split("batch=")[1][0] for f in x.inputFiles()}))
    assert log.new_rows("r", work) == 2 and seen[-1][0] == sorted(i for i, _ in rows)
    log.append(spark.createDataFrame([(900, T0)], schema))
    with pytest.raises(RuntimeError):
        log.new_rows("r", lambda x: (_ for _ in ()).throw(RuntimeError("late")))
    assert log.new_rows("r", work) == 3 and seen[-1] == ([900], {"3"}) and log.new_rows("r", work) == 3 and len(seen) == 2
    assert log.new_rows("other", work, F.col("period") >= F.lit("2024-06-01").cast("date")) == 3 and set(seen[-1][0]) == {i for i, at in rows if at and at.month == 6}


FEED = "market string, stock string, id long, rank_score double, hour int, url string, title string, line string, source string, doc_type string, relevance_score double, matched_alias string"


def feed(spark, rows):
    """Rows (stock, id, rank_score, hours after T0, url, title, line[, relevance]) of one feed, displayable unless relevance says otherwise."""
    full = [("m", r[0], r[1], r[2], r[3], r[4], r[5], r[6], "naver_news", "report", r[7] if len(r) > 7 else 0.9, None) for r in rows]
    return spark.createDataFrame(full, FEED).withColumn("event_time", F.lit(T0) + F.make_dt_interval(hours=F.col("hour")))


def shown(spark, rows, limit):
    return {x["id"]: (x["place"], x["similar_count"]) for x in dedup.curated(feed(spark, rows), "market", "stock", limit).collect()}


def test_curation_counts_repeats_at_their_representative(spark):
    story = "alpha beta gamma delta"
    rows = [
        ("s", 1, 0.95, 0, "http://x/1", story, "one line about nothing else at all"),
        ("s", 2, 0.90, 0, "http://x/2", story + " extra", "second summary with quite other words"),  # title within a title
        ("s", 3, 0.85, 0, "http://x/1#top", "unlike any other title here", "third summary differs from all of them"),  # same address
        ("t", 4, 0.80, 0, "http://x/1", story, "another stock's story stays its own"),
        ("s", 5, 0.75, 0, "http://x/5", "fifth headline stands alone", "merger of north and south works approved today"),
        ("s", 6, 0.70, 100, "http://x/6", "sixth headline is different", "merger approved for north and south plants of works"),  # one-liner, within a week
        ("s", 7, 0.65, 24 * 30, "http://x/7", "seventh title has own words", "north wind and south wind merger story told elsewhere again"),
        ("s", 8, 0.60, 0, "http://x/8", "short", "hidden since its title is too short"),
        ("s", 9, 0.55, 0, "http://x/9", "ninth title with little relevance", "hidden for its relevance", 0.01),
        ("s", 10, 0.50, 0, "http://x/2", "tenth has the address of the second", "its address was never shown"),
    ]
    assert shown(spark, rows, 10) == {1: (1, 2), 4: (2, 0), 5: (3, 1), 7: (4, 0), 10: (5, 0)}
    assert shown(spark, rows, 2) == {1: (1, 2), 4: (2, 0)}
    assert shown(spark, [("s", i, 0.5 - i / 100, 0, f"http://y/{i}", story, "") for i in range(3)], 5) == {0: (1, 2)}
    assert shown(spark, rows[:0], 5) == {}


def test_related_documents_leave_out_the_item_and_repeats(spark):
    titles = ["alpha beta gamma delta", "alpha beta gamma delta more", "third story of the day", "fourth story here now", "fifth thing entirely"]
    rows = [("s", i, T0 - dt.timedelta(hours=i), f"http://x/{i if i != 3 else 2}", x) for i, x in enumerate(titles)] + [("t", 9, T0, "http://x/9", "other stock")]
    docs = spark.createDataFrame(rows, "stock string, id long, event_time timestamp, url string, title string")
    got = {x["id"]: x["related"] for x in dedup.related(docs, docs, "stock", 3).collect()}
    assert got == {0: [1, 2, 4], 1: [0, 2, 4], 2: [0, 3, 4], 3: [0, 2, 4], 4: [0, 2], 9: []}
    old = docs.unionByName(spark.range(20).select(F.lit("s").alias("stock"), (F.col("id") + 100).alias("id"), (F.lit(T0) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("event_time"), F.lit("http://same").alias("url"), F.lit("equal headline again").alias("title")))
    assert {x["id"]: x["related"] for x in dedup.related(old, docs.where("id = 4"), "stock", 3).collect()} == {4: [119]}  # of the twelve newest


def test_newest_rows_of_a_feed_come_first(spark):
    docs = spark.range(50).select((F.col("id") % 2).alias("market"), "id", (F.lit(T0) + F.make_dt_interval(hours=(F.col("id") / 4).cast("int"))).alias("event_time"))
    assert sorted(x["id"] for x in dedup.newest(docs, "market", 2).collect()) == list(range(34, 50))


def test_ranking_equals_its_formula(spark):
    titles = ["alpha beta gamma", "alpha beta delta", "alpha beta gamma delta", "lonely words here", "gamma delta epsilon"]
    docs = spark.createDataFrame([("s", i, x, "naver_news" if i % 2 else "sec_edgar", "report" if i == 2 else "news", i / 4, T0 + dt.timedelta(hours=i)) for i, x in enumerate(titles)], "stock string, id long, title string, source string, doc_type string, relevance_score double, event_time timestamp")
    words = [set(x.split()) for x in titles]
    weight = {(i, j): len(words[i] & words[j]) / 3 if min(len(words[i]), len(words[j])) == 3 else 0 for i in range(5) for j in range(5) if i != j and len(words[i] & words[j]) >= 2}
    degree, v = [sum(w for (i, _), w in weight.items() if i == k) for k in range(5)], [0.2] * 5
    for _ in range(30):
        new = [sum(w * v[j] for (i, j), w in weight.items() if i == k) for k in range(5)]
        norm = sum(x * x for x in new) ** 0.5
        new = [x / norm for x in new]
        done, v = sum(abs(x - y) for x, y in zip(new, v)) < 1e-6, new
        if done:
            break
    scale = lambda xs: [(x - min(xs)) / (max(xs) - min(xs)) for x in xs]
    prior = [0.9 if i == 2 else 0.55 if i % 2 else 0.8 for i in range(5)]
    expected = [round(0.45 * i / 4 + 0.35 * (0.65 * scale(v)[i] + 0.35 * scale(degree)[i]) + 0.15 * i / 4 + 0.05 * prior[i], 6) for i in range(5)]
    got = {x["id"]: x["rank_score"] for x in dedup.ranked(docs, "stock").collect()}
    assert all(abs(got[i] - expected[i]) < 2e-6 for i in range(5))


def test_centrality_of_a_star(spark):
    nodes = spark.createDataFrame([("m", i) for i in range(4)], "m string, id long")
    edges = spark.createDataFrame([("m", 0, i, 1.0) for i in (1, 2)], "m string, a long, b long, weight double")
    got = {x["id"]: x["eigen"] for x in dedup.centrality(nodes, edges, "m").collect()}
    assert got[3] == 0.0 and max(got.values()) == 1.0


def test_boilerplate_lines_go(spark):
    docs = spark.createDataFrame([("a\nb\na\nA\na\n***\nc",), (None,)], "text string")
    assert [x["text"] for x in dedup.without_boilerplate(docs).collect()] == ["b\nc", ""]


def test_facts_prefer_numbers_and_are_filled_up(spark):
    assert value(spark, evidence.facts(F.lit("Nothing numeric here. Revenue rose 12% on demand. Short."), F.lit(""))) == ["Revenue rose 12% on demand.", "Nothing numeric here.", "Nothing numeric here."]
    assert value(spark, evidence.facts(F.lit(None).cast("string"), F.lit(""))) == []


def test_fact_tokens_and_how_many_a_summary_keeps(spark):
    text = "On 2024-03-05 EPS rose 12.5% to 3,400 in Q2"
    assert value(spark, t.fact_tokens(F.lit(text))) == ["2024-03-05", "EPS", "12.5%", "3,400"]
    assert value(spark, t.preservation(F.lit(text), F.lit("EPS at 3400"))) == 0.5 and value(spark, t.preservation(F.lit("none here"), F.lit(""))) == 1.0


def test_a_fact_cut_at_a_blank_is_compared_as_it_stands(spark):
    cut = ("Shti " * 44)[:220]
    card = spark.createDataFrame([(1, [cut], "Eriner thanea. Shti Shti", "none", ["general"], "x")], "item_id long, facts array<string>, fact_headline string, risk_note string, topics array<string>, interpretation string")
    assert evidence.item_lines(card).first()["one_liner"] == cut[:120]


def test_words_are_packed_into_lines(spark):
    text = " ".join(f"word{i}" for i in range(200))
    lines = value(spark, t.pack_words(F.lit(text)))
    assert len(lines) == 5 and all(len(x) <= 110 for x in lines) and text.startswith(" ".join(lines)) and all(len(a) + 1 + len(b.split()[0]) > 110 for a, b in zip(lines, lines[1:]))


def test_payloads_of_all_kinds(spark):
    payload = '{"a": "x", "n": 5, "none": null, "list": ["' + "y" * 600 + '", 2], "many": [' + ",".join(map(str, range(20))) + '], "object": {"k": "' + "z" * 2000 + '"}}'
    got = value(spark, t.compact_payload(F.lit(payload)))
    assert (got["a"], got["n"], got["none"]) == ("x", "5", None) and got["list"] == '["' + "y" * 500 + '","2"]' and got["many"].count(",") == 9 and len(got["object"]) == 1000
    assert value(spark, t.compact_payload(F.lit("[1, 2]"))) == {"raw": "[1, 2]"} and value(spark, t.compact_payload(F.lit("no json"))) is None


def test_a_failing_batch_is_marked_and_the_stream_goes_on(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(10 * n + i,) for i in range(3)], "item_id long").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    calls = []

    def work(batch):
        calls.append(1)
        ok = batch.withColumn("status", F.lit("mapped"))
        return ok if len(calls) > 1 else ok.withColumn("status", F.raise_error(F.lit("bad batch")).cast("string"))

    stream = spark.readStream.schema("item_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.per_batch(stream, f"{tmp_path}/out", ["item_id"], work, f"{tmp_path}/state", ["item_id"]).trigger(availableNow=True).start().awaitTermination(120)
    got = {x["item_id"]: x["status"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 6 and sorted(got.values()) == ["error"] * 3 + ["mapped"] * 3 and len(calls) == 2
    lost = jobs.failed(spark, f"{tmp_path}/out").collect()
    assert len(lost) == 3 and all("bad batch" in x["error"] for x in lost)


def test_errors_of_storage_stop_the_stream(spark, tmp_path):
    spark.createDataFrame([(1,)], "item_id long").write.parquet(f"{tmp_path}/in")

    def work(batch):
        raise RuntimeError("java.io.IOException: No space left on device")

    stream = spark.readStream.schema("item_id long").parquet(f"{tmp_path}/in")
    query = jobs.per_batch(stream, f"{tmp_path}/out", ["item_id"], work, f"{tmp_path}/state", ["item_id"]).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="No space left"):
        query.awaitTermination(120)


def test_items_without_a_date_do_not_stop_the_stream(spark, tmp_path):
    rows = [(1, "t", "s", "http://x/1", None, None), (2, "t", "s", "http://x/2", T0, None), (3, "u", "s", "http://x/1", None, None), (4, "t", "s", "http://x/4", None, None)]
    for k in range(0, 4, 2):
        spark.createDataFrame(rows[k : k + 2], "item_id long, title string, snippet string, link string, published timestamp, updated timestamp").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = lambda: jobs.feed_items(spark.readStream.schema("item_id long, title string, snippet string, link string, published timestamp, updated timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    marked = jobs.mark_duplicates(stream())
    marked.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    got = {x["item_id"]: x["status"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 4 and sorted(got.values()) == ["new", "new", "skipped", "skipped"] and got[3] == "new"
    jobs.first_items(stream(), f"{tmp_path}/first", f"{tmp_path}/first-state", 4).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(x["item_id"] for x in Table(spark, f"{tmp_path}/first").read().collect()) == [1, 2, 4]

def test_bars_are_corrected_in_their_buckets(spark, tmp_path):
    for n in range(5):
        rows = [("A", dt.date(2024, 1, d), float(10 * n + d), n) for d in range(1, 4) if (d + n) % 2] + [("B", dt.date(2024, 1, 1), float(-n), -n)]
        spark.createDataFrame(rows, "stock_code string, trade_date date, close double, version int").coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema("stock_code string, trade_date date, close double, version int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.upsert_bars(stream, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    got = {(x["stock_code"], x["trade_date"].day): x["close"] for x in jobs.bars(spark, f"{tmp_path}/out").collect()}
    assert got == {("A", 1): 41.0, ("A", 2): 32.0, ("A", 3): 43.0, ("B", 1): 0.0}
    table = Table(spark, f"{tmp_path}/out")
    assert table.versions() == list(range(6)) and all(len(table.snapshot(v).folders) <= 2 for v in range(6))


def test_typed_scans_add_and_leave_out_columns(spark, tmp_path):
    spark.createDataFrame([("5", "x", 1)], "id string, title string, other int").write.parquet(f"{tmp_path}/d")
    got = schemas.scan(spark, f"{tmp_path}/d", "documents")
    assert got.columns[:2] == ["id", "stock_code"] and "other" not in got.columns and got.first()["id"] == 5 and got.first()["url"] is None


def test_primary_ticker_with_hint_ambiguity_and_gates(spark):
    docs = spark.createDataFrame([(1, "plain", "text", "B"), (2, "unsure words", "", None), (3, "plain", "", "C"), (4, "plain", "", None)], "id long, title string, body string, hint string")
    scores = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.88), (2, "A", 1.0), (3, "A", 0.5), (3, "C", 0.86), (4, "A", 0.0)], "id long, code string, score double")
    got = {x["id"]: (x["ticker"], x["score"]) for x in resolve.primary_ticker(scores, docs, ["unsure"]).collect()}
    assert got == {1: ("B", 0.82), 2: ("A", 0.92), 3: ("C", 0.88)}


def test_like_lines_of_one_scope(spark):
    base = "merger of north and south works approved today"
    rows = [("s", 1, base, 0), ("s", 2, base + " again", 0), ("s", 3, "merger of north and far western plants told by an office", 24), ("s", 4, "merger of north and far western plants told by an office", 24 * 30), ("t", 5, base, 0), ("s", 6, "nothing in common", 0)]
    docs = spark.createDataFrame(rows, "stock string, id long, line string, hour int").withColumn("event_time", F.lit(T0) + F.make_dt_interval(hours=F.col("hour")))
    got = {(x["a"], x["b"]) for x in dedup.similar_lines(docs, "stock", "line", "event_time").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (3, 4)}


def test_digests_take_the_first_card_of_each_kind(spark):
    cards = spark.createDataFrame([
        ("ticker", "A", 1, "C1", "c1", 11, "", ["no number here"], "", "", ["general"]), ("ticker", "A", 2, "C2", "c2", 12, "Second headline", ["plain", "up 5%"], "It may rise.", "Some risk.", ["demand", "macro"]),
        ("ticker", "A", 3, "C3", "c3", 13, "Third headline", ["down 7%"], "It may fall.", "Other risk.", ["macro"]),
    ], "entity_type string, entity_id string, n int, alias string, card_id string, item_id long, fact_headline string, facts array<string>, interpretation string, risk_note string, topics array<string>")
    got = evidence.digests(cards, ["entity_type", "entity_id"]).first()
    assert got["cards"] == 3 and tuple(got["headline"]) == ("Second headline", "C2") and tuple(got["evidence"]) == ("up 5%", "C2") and tuple(got["demand"]) == ("plain", "C2")
    assert tuple(got["risk"]) == ("Some risk.", "C2") and tuple(got["checkpoint"]) == ("general", "C1") and tuple(got["final"]) == ("It may rise.", "C2") and [tuple(x) for x in got["refs"]] == [("C1", "c1", 11), ("C2", "c2", 12), ("C3", "c3", 13)]


def test_stock_summaries_have_six_lines_with_sources(spark):
    docs = spark.createDataFrame([("A", 1, "Old title", "Old title The plant faces a risk of delay this year. More.", T0 - dt.timedelta(hours=2)), ("A", 2, "New title", "Sales rose strongly in the quarter. Next steps follow.", T0)], "stock_code string, id long, title string, body string, event_time timestamp")
    got = summaries.stock_summaries(docs, ["risk"], ["next"], ["rose"], ["fell"]).orderBy("line_no").collect()
    assert [(x["line_no"], x["source_id"]) for x in got] == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 2), (6, 2)]
    assert [x["text"].split(": ", 1)[0] for x in got] == summaries.STOCK_LABELS and got[0]["text"].endswith("Sales rose strongly in the quarter.") and got[3]["text"].endswith("The plant faces a risk of delay this year.") and "긍정" in got[5]["text"]


def test_focus_takes_keyword_lines_and_the_next(spark):
    text = "first\nhas Key word\nfollows it\nother\n\nkey again\nlast one"
    docs = spark.createDataFrame([(text,), ("\n".join(f"line {i}" for i in range(20)),), (None,)], "text string")
    got = [x["focus"] for x in evidence.focus(docs, "text", ["key"], longest=40).collect()]
    assert got == [["has Key word", "follows it", "key again"], [f"line {i}" for i in range(10)], []]


def test_lines_that_copy_their_title(spark):
    rows = spark.createDataFrame([("Profit rises at the works", "Profit rises at the work"), ("Something else", "Profit rises"), ("", "x"), (None, "x")], "a string, b string")
    assert [round(x["r"], 2) for x in rows.select(dedup.sequence_ratio("a", "b").alias("r")).collect()] == [0.98, 0.38, 0.0, 0.0]


def test_article_containers_in_their_order():
    inside = lambda tag, words: f"<{tag}><p>{words} of the article text</p></{tag.split()[0]}>"
    page = inside('div id="dic_area"', "dic area") + inside('div class="x article-body y"', "article body") + inside('div class="news_cnt_detail_wrap"', "detail wrap")
    assert payloads.article_text(page) == "dic area of the article text"
    assert payloads.article_text(inside('div id="articletxt"', "articletxt") + page) == "articletxt of the article text"
    assert payloads.article_text(page.replace("dic_area", "other")) == "article body of the article text"
    assert payloads.article_text("<main><p>too short</p></main>" + page) == "dic area of the article text"  # a container without paragraphs is passed over
    assert payloads.article_text("<article><p>first article of the page</p></article><article><p>second article of the page</p></article>") == "first article of the page"
    assert payloads.article_text("<body><p>only the body has a paragraph</p></body>") == "only the body has a paragraph"
    assert payloads.article_text("<article><p>one<br>two <b>thr</b>ee four five<p>unclosed paragraph here</article><p>outside of the article") == "one two thr ee four five unclosed paragraph here\nunclosed paragraph here"
    assert payloads.article_text("<div>a</div></p></article><script>var x = '<p>no</p>'</script><p>b &amp; c</p>") == "a b & c"


def test_article_text_equals_a_tree(spark):
    """Against a tree that is built whole and searched selector by selector."""
    rng = random.Random(11)
    tags = ["article", "main", "p", "p", "p", "b", "div", 'div id="dic_area"', 'div id="articletxt"', 'section class="a article-body"', 'div class="news_cnt_detail_wrap"', "br", "script", "article"]

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(tags)
            body = made(depth - 1) if depth and tag not in ("br", "script") else f"words {rng.randint(0, 999)} here"
            closed = "" if tag == "br" or rng.random() < 0.1 and tag != "script" else f"</{tag.split()[0]}>"
            out.append(f"text {rng.randint(0, 99)} <{tag}>{'' if tag == 'br' else body}{closed}")
        return "".join(out)

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = {"tag": "", "attrs": {}, "kids": [], "up": None}
            self.at = self.root

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "attrs": dict(attrs), "kids": [], "up": self.at}
            self.at["kids"].append(node)
            self.at = self.at if tag == "br" else node

        def handle_endtag(self, tag):
            node = self.at
            while node["up"] is not None and node["tag"] != tag:
                node = node["up"]
            self.at = node["up"] if node["up"] is not None else self.at

        def handle_data(self, data):
            self.at["kids"].append(data)

    every = lambda n: [n] + [y for k in n["kids"] if isinstance(k, dict) for y in every(k)]
    strings = lambda n: [s for k in n["kids"] for s in (strings(k) if isinstance(k, dict) else [k] if n["tag"] != "script" else [])]
    text = lambda n: " ".join(" ".join(s.strip() for s in strings(n) if s.strip()).split())
    for _ in range(150):
        html = made(4)
        tree = Tree()
        tree.feed(html)
        tree.close()
        want = None
        for c in payloads.CONTAINERS:
            hit = next((n for n in every(tree.root)[1:] if n["tag"] == c or f"#{n['attrs'].get('id')}" == c or c[0] == "." and c[1:] in (n["attrs"].get("class") or "").split()), None)
            found = [x for x in (text(n) for n in every(hit)[1:] if n["tag"] == "p") if len(x) >= 12] if hit else []
            if found:
                want = "\n".join(found[:10])
                break
        assert payloads.article_text(html) == (text(tree.root)[:3000] if want is None else want), html


def test_company_codes_from_real_xml(spark):
    one = lambda corp, name, stock: f'<list kind="x"><corp_code>{corp}</corp_code><corp_name>{name}</corp_name><stock_code> {stock} </stock_code></list>'
    xml = f"<?xml version='1.0'?><result>{one('00000001', 'A&amp;B  <![CDATA[<C>]]>', '000001')}{one('00000002', 'old', '000002')}{one('00000003', 'new', '000002')}{one('123', 'bad', '000003')}{one('00000004', 'idle', '000004')}<!-- {one('00000005', 'no', '000001')} --></result>"
    stocks = spark.createDataFrame([(f"00000{k}", k != 4) for k in range(1, 6)], "code string, is_active boolean")
    got = {x["stock_code"]: (x["corp_code"], x["corp_name"]) for x in payloads.company_codes(spark.createDataFrame([(xml,), (None,), ("no xml",), ("<result></result>",)], "xml string"), stocks).collect()}
    assert got == {"000001": ("00000001", "A&B <C>"), "000002": ("00000003", "new")}


def test_declared_schemas(spark, tmp_path):
    assert len(schemas.SCHEMAS) >= 26 and all(len(schemas.struct(n)) >= 3 for n in schemas.SCHEMAS)
    table = schemas.new_table(spark, f"file://{tmp_path}/t", "summary_sources", ["summary_id"], 2)
    table.commit(schemas.typed(spark.createDataFrame([(1, "2")], "summary_id long, line_no string"), "summary_sources"), sinks.children("summary_id"))
    assert [tuple(x) for x in table.read().collect()] == [(1, 2, None)]


def test_article_text_takes_the_innermost_container():
    html = "<body><p>outer paragraph text</p><article><p>short</p><p>inner <b>paragraph</b> text</p><script>x</script></article></body>"
    assert payloads.article_text(html) == "inner paragraph text"
    assert payloads.article_text("<div>only   plain text</div>") == "only plain text" and payloads.article_text(None) == ""


def test_first_bar_of_a_local_day_wins(spark):
    rows = [("A", "Asia/Seoul", [0, 3600, 90000], [1.0] * 3, [1.0] * 3, [1.0] * 3, [None, 5.0, 6.0], [None] * 3, [1, 2, 3])]
    payload = spark.createDataFrame(rows, "stock_code string, tz string, timestamp array<long>, open array<double>, high array<double>, low array<double>, close array<double>, adjclose array<double>, volume array<long>")
    got = payloads.price_bars(payload).orderBy("trade_date").collect()
    assert [(x["trade_date"], x["close"]) for x in got] == [(dt.date(1970, 1, 1), 5.0), (dt.date(1970, 1, 2), 6.0)]


def test_whole_words_are_found_without_the_automaton_and_hits_move_once(spark):
    known = [(a, b) for a in ("the", "a1", "x-1", "été", "12") for b in (resolve.WORD, resolve.NUMBER, resolve.ANYWHERE)]
    find = resolve._finder("whole words", known)
    runs, automaton = resolve._automata["whole words"]
    assert set(runs) == {"the", "a1", "12"} and sum(len(e) for _, e in automaton.values()) == len(known) - 3
    outside = {resolve.WORD: "[a-z0-9]", resolve.NUMBER: r"\d", resolve.ANYWHERE: "(?!)"}
    for text in ("the", "other the.", "thea1 a1", "x-1", "x-12", "ététhe", "éa1é", "112 12a", "", "12", "a1-the-x-1y"):
        hits: dict[int, int] = {}
        find(text, hits, 2)
        assert hits == {k: 2 for k, (a, b) in enumerate(known) if re.search(f"(?<!{outside[b]}){re.escape(a)}(?!{outside[b]})", text)}, text
    items = spark.createDataFrame([(1, "the a1", "body")], "id long, title string, body string")
    aliases = spark.sql("SELECT * FROM VALUES ('T', 'the', 'short', 0.9D), ('U', 'the', 'short', 0.9D) AS t(ticker, alias, alias_type, weight)")
    scores = resolve.ticker_scores(items, aliases)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(id#\d+L?, ticker#", plan)
    assert [r["ticker"] for r in scores.orderBy("place").collect()] == ["T", "U"]
