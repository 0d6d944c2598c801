import gzip
import math
import os
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import vptree, warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5\nx%", "é" * 70_000), (None, "http://a/n", "<p>same</p>"), (6, "http://a/6", "WARC/1.1\r\n\r\n\x1f\x8b\x08"), (2, "http://a/2", "<p>same</p>")]


def test_archive_round_trip(spark, tmp_path):
    got = sorted(([r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]] for r in warc.archive(pages(spark, ROWS)).collect()), key=repr)
    same, empty = warc.digest(b"<p>same</p>"), warc.digest(b"")
    expected = [[1, 11, same, "revisit", 2], [2, 11, same, "response", None], [2, 11, same, "response", None], [None, 11, same, "response", None], [3, 0, empty, "revisit", 4], [4, 0, empty, "response", None]]
    expected += [[i, len(h.encode()), warc.digest(h.encode()), "response", None] for i, _, h in (ROWS[4], ROWS[6])]
    assert got == sorted(expected, key=repr)
    assert warc.archive(pages(spark, [])).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    warc.write(pages(spark, ROWS), str(tmp_path / "w"), least_bytes=5)
    got = warc.read(spark, str(tmp_path / "w")).where("record_type = 'revisit'").collect()
    assert [r["page_id"] for r in got] == [1] and got[0]["payload"] is None


def test_ranges_filters_and_foreign_archives(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i} " + "text " * 200) for i in range(300)]
    warc.write(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    df = warc.read(spark, str(tmp_path / "w"), split=3000)
    assert df.rdd.getNumPartitions() > 5 and sorted(r["page_id"] for r in df.collect()) == list(range(300))
    some = warc.read(spark, str(tmp_path / "w"), payload=False).where("url = 'http://x/7' OR url = 'x'").collect()
    assert [r["page_id"] for r in some] == [7] and some[0]["payload"] is None and some[0]["payload_bytes"] == len(rows[7][2])
    assert warc.read(spark, str(tmp_path / "w")).where("headers['WARC-Type'] = 'revisit'").count() == 0
    raw = b"".join(warc.record(i, u, h.encode(), None, "2024-01-01T00:00:00Z") for i, u, h in rows)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(raw)
    (tmp_path / "plain" / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(i, u, h.encode(), None, "2024-01-01T00:00:00Z")) for i, u, h in rows))
    got = warc.read(spark, str(tmp_path / "plain")).collect()
    assert sorted(r["page_id"] for r in got) == sorted(2 * list(range(300))) and {bytes(r["payload"]) for r in got} == {h.encode() for _, _, h in rows}


def stored(raw):
    """A gzip member without compression and without the extra field, so that its payload stands in the file as it is."""
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def test_bytes_that_look_like_members(spark, tmp_path):
    """Payloads full of gzip magic, read in ranges that begin inside them."""
    false = [b"\x1f\x8b\x08\xff", b"\x1f\x8b\x08\0", b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0MW\x08\0" + b"\xff" * 8, b"\x1f\x8b\x08"]
    for name, make in (("stored", stored), ("own", warc.member)):
        (tmp_path / name).mkdir()
        raw = [(random.Random(i).randbytes(3000) + false[i % 4]) * 3 for i in range(40)]
        (tmp_path / name / "a.warc.gz").write_bytes(b"".join(make(warc.record(i, None, x, None, "2024-01-01T00:00:00Z")) for i, x in enumerate(raw)))
        got = warc.read(spark, str(tmp_path / name), split=1700).collect()
        assert {r["page_id"]: bytes(r["payload"]) for r in got} == dict(enumerate(raw)) and len(got) == 40


def test_damaged_records_do_not_stop_a_reader(spark, tmp_path):
    records = [warc.record(i, f"http://x/{i}", random.Random(i).randbytes(100_000), None, "2024-01-01T00:00:00Z") for i in range(4)]
    (tmp_path / "w").mkdir()
    for name, make in (("own", warc.member), ("other", gzip.compress)):
        parts = [make(r) for r in records]
        at = len(parts[1]) // 2
        parts[1] = parts[1][:at] + b"\xff" * 40 + parts[1][at + 40 :]
        (tmp_path / "w" / f"{name}.warc.gz").write_bytes(b"".join(parts) + parts[0][:9])
    plain = records[0] + b"WARC/1.1\r\nContent-Length: many\r\n\r\n" + b"no record\r\n\r\n" + records[2] + b"WARC/1.1\r\n"
    (tmp_path / "w" / "c.warc").write_bytes(plain)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    whole = sorted(r["page_id"] for r in got if r["payload"] is not None)
    assert whole == sorted(2 * [0, 2, 3] + [0, 2]) and [r["url"] for r in got if r["payload"] is None] == 2 * ["http://x/1"]


def test_cut_and_short_records_are_told(spark, tmp_path):
    raw = [random.Random(i).randbytes(50_000) for i in range(2)]
    records = [warc.record(i, f"http://x/{i}", x, None, "2024-01-01T00:00:00Z") for i, x in enumerate(raw)]
    half = lambda x: x[: len(x) * 3 // 4]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "own.warc.gz").write_bytes(half(b"".join(map(warc.member, records))))
    (tmp_path / "w" / "other.warc.gz").write_bytes(half(b"".join(map(gzip.compress, records))))
    (tmp_path / "w" / "plain.warc").write_bytes(half(b"".join(records)))
    (tmp_path / "w" / "wrong.warc").write_bytes(records[0].replace(raw[0], raw[1]))  # not the payload of its digest
    for payload in (True, False):
        got = warc.read(spark, str(tmp_path / "w"), payload).collect()
        assert sorted((r["page_id"], r["damaged"]) for r in got) == [(0, False)] * 3 + [(0, payload)] + [(1, True)] * 3 if payload else len(got) == 7
        assert all(r["payload"] is None for r in got if r["damaged"]) and {r["payload_bytes"] for r in got} == {50_000}
    assert warc.read(spark, str(tmp_path / "w")).where("damaged AND page_id = 1").count() == 3


def test_unwanted_payloads_are_not_read(tmp_path):
    class Counted:
        def __init__(self, f):
            self.f, self.read_bytes = f, 0

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            got = self.f.read(n)
            self.read_bytes += len(got)
            return got

    raw = [random.Random(i).randbytes(4 << 20) for i in range(4)]
    whole = b"".join(warc.member(warc.record(i, None, x, None, "2024-01-01T00:00:00Z")) for i, x in enumerate(raw))
    (tmp_path / "a.warc.gz").write_bytes(whole)
    for payload, most in ((True, len(whole) * 2), (False, 8 * warc.STEP)):
        with open(tmp_path / "a.warc.gz", "rb") as f:
            counted, reader, ids = Counted(f), warc._Reader(f"file://{tmp_path}", payload, 1 << 40), []
            s = warc._Stream(counted, 0, len(whole))
            while reader._seek(s, len(whole), True):
                m = warc._Member(s)
                h, at, size = warc._head(m)
                ids.append(warc._columns(h)["page_id"])
                if payload:
                    assert len(m.until(at + size)) == at + size
                m.end()
        assert ids == [0, 1, 2, 3] and counted.read_bytes <= most


def test_large_payloads_are_read_in_linear_time(tmp_path):
    raw = random.Random(0).randbytes(64 << 20)
    (tmp_path / "a.warc.gz").write_bytes(stored(warc.record(1, None, raw, None, "2024-01-01T00:00:00Z")))
    reader = warc._Reader(f"file://{tmp_path}", True, 1 << 40)
    began = time.process_time()
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows[0]["payload"] == raw and time.process_time() - began < 5


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in queries:
        v = next(x for i, x in good if i == q)
        d = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, round(x, 9)) for r, (x, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [150, 10_000])
def test_factor_one_is_exact(spark, shard_rows):
    rng = random.Random(0)
    vectors = [[float(np.float32(rng.gauss(0, 1))) for _ in range(6)] for _ in range(400)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0]) for i in range(200)]
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, []), (None, vectors[1]), (2005, [1.0, 2.0]), (2006, [float("inf")] * 6)]
    df = table(spark, rows)
    queries = [0, 5, 100, 1003, 2005]
    index = vptree.build_index(df, shard_rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vptree.nearest(index, df.where(df.vec_id.isin(*queries, 2001)), 10, 1.0, block=3).collect())
    assert got == brute(rows, queries, 10)


@pytest.mark.parametrize("shard_rows", [150, 10_000])
def test_repeated_rows_and_ids_with_several_vectors(spark, shard_rows):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(4)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(15)]
    queries = [0, 5, 100, 299]

    def found(rows):
        df = table(spark, rows)
        return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vptree.nearest(vptree.build_index(df, shard_rows), table(spark, [rows[q] for q in queries])).collect())

    assert found(rows + rows) == found(rows) == brute(rows, queries, 10)
    # Ids 350 and 400 stand many times beside query 0 and query 5; only their nearest vectors count, once each.
    near = [(350, [x + 0.001 * j for x in rows[0][1]]) for j in range(1, 40)] + [(400, rows[5][1])] * 12 + [(7, [x + 0.01 for x in rows[5][1]])]
    least = {}
    for q in queries:
        for i, v in rows + near:
            if i != q:
                d = float(np.sqrt(((np.array(v, np.float32).astype(float) - np.array(rows[q][1])) ** 2).sum()))
                least[q, i] = min(d, least.get((q, i), d))
    expected = [(q, r + 1, i, round(d, 9)) for q in queries for r, (d, i) in enumerate(sorted((d, i) for (p, i), d in least.items() if p == q)[:10])]
    assert found(rows + near) == sorted(expected)


def test_cells_are_left_out_and_lose_nothing(spark, monkeypatch):
    """Thirty far clusters: queries go to few cells. One vector has a third of all ids, some vectors have a length that no pivot has, some clusters hold fewer rows than k."""
    rng = random.Random(8)
    centres = [[rng.uniform(-100, 100) for _ in range(6)] for _ in range(30)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 1))) for x in centres[min(29, i % 40)]]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000 + i, [500.0 + i] * 6) for i in range(3)] + [(3000 + i, [float(i + 1), 2.0]) for i in range(14)]
    monkeypatch.setattr(vptree, "LEAF", 16)
    df = table(spark, rows)
    index = vptree.build_index(df, 30)
    cells = vptree._directory(index)
    assert set(cells) <= {2, 6} and len(cells[6].number) > 15
    assert index.agg({"rows": "max"}).first()[0] < 100
    ids = [0, 3, 7, 39, 1000, 2001, 3005]
    queries = df.where(df.vec_id.isin(ids))
    found = vptree.nearest(index, queries).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found) == brute(rows, ids, 10)
    limited = queries.selectExpr("vec_id AS query_id", "cast(embedding AS array<double>) AS v").join(spark.createDataFrame(found).groupBy("query_id").agg(F.max("score").alias("far")), "query_id")
    visited = vptree._visits(limited.where("size(v) = 6 AND query_id < 2000"), cells, 10, 1.0, False).count()
    assert visited < 5 * len(cells[6].number) / 3


def test_lengths_without_a_pivot(spark, monkeypatch):
    monkeypatch.setattr(vptree, "PIVOTS", 1)
    rows = [(i, [float(i), 1.0] if i % 2 else [float(i), 1.0, 2.0]) for i in range(200)]
    index = vptree.build_index(table(spark, rows), 20)
    assert {r["cell"] for r in index.select("cell").collect()} == {0, -1}
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vptree.nearest(index, table(spark, [rows[4], rows[5]])).collect())
    assert got == sorted(brute([r for r in rows if r[0] % 2 == 0], [4], 10) + brute([r for r in rows if r[0] % 2], [5], 10))


def test_relaxed_search_keeps_most_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(2000)]
    df = table(spark, rows)
    queries = list(range(0, 2000, 100))
    truth = {(q, i) for q, _, i, _ in brute(rows, queries, 10)}
    found = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(vptree.build_index(df), df.where("vec_id % 100 = 0"), factor=1.5).collect()}
    assert len(truth & found) / len(truth) >= 0.9


def test_relaxed_search_on_the_test_data(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    df = spark.read.parquet(path)
    index, queries = vptree.build_index(df), df.where("vec_id % 20 = 0")
    pairs = lambda factor: {(r["query_id"], r["vec_id"]) for r in vptree.nearest(index, queries, factor=factor).collect()}
    exact = pairs(1.0)
    assert exact == {(q, i) for q, _, i, _ in brute([(r["vec_id"], r["embedding"]) for r in df.collect()], [r["vec_id"] for r in queries.collect()], 10)}
    assert len(exact & pairs(2.0)) / len(exact) >= 0.9


def test_distances_that_overflow_and_clashing_columns(spark):
    rows = [(i, [1e200 * (i + 1), 0.0], 1, 2.0, "x") for i in range(4)] + [(10 + i, [float(i + 1), 1.0], 1, 2.0, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim int, score double, shard string").withColumn("v", F.lit(1)).withColumn("query_id", F.lit(5))
    got = vptree.nearest(vptree.build_index(df), df.where("vec_id IN (0, 10)"), 3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, math.inf), (0, 2, 2, math.inf), (0, 3, 3, math.inf), (10, 1, 11, 1.0), (10, 2, 12, 2.0), (10, 3, 13, 3.0)]


def test_no_vectors(spark):
    none = table(spark, [])
    assert vptree.nearest(vptree.build_index(none), none).count() == 0
