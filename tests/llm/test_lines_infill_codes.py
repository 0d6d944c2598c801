"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketweave.llm import codes, infill, lines

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def docs(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "h", 3) for i, t in rows], "doc_id long, text string, output string, n long, at int, text_hash string, n_lines int")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts(seed=1, n=150):
    rng = random.Random(seed)
    parts = ["word", "Éa", "日本", "😀", " ", "  ", "\n", "\t", "\x0b", " ", "<", "P>", "a<", "x" * 40]
    rows = [(i * 7, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    rows += [(2_000 + k, t) for k, t in enumerate([None, "", " ", "\n\n", "a", "holds <P> a mark", "<S>", "<M>", "ab <P", "<S <S>"])]
    return rows + [rows[3], rows[3], (rows[5][0], "same id"), (None, "no id at all"), (3_000, "long 日本 word " * 20_000), (3_001, "x" * 100_000), (3_002, " " * 50_000 + "y ")]


def infilled(i, t):
    t = t or ""
    u = UNIT.findall(t)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, len(u), "plain", None, None, sha(t), sha(t))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (i, len(u), form, len(x), len(y), sha(f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"), sha(t))


def test_infilling_equals_brute_force(spark):
    rows = texts()
    got = infill.digests(docs(spark, rows)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(infilled(i, t)) for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.digests(docs(spark, [])).count() == 0


def test_cuts_are_found_in_any_block():
    for _, t in texts(2, 40):
        encoded = (t or "").encode()
        if len(encoded) > 20_000:
            continue
        units = UNIT.findall(t or "")
        for block in (1, 3, 16, 4096):
            tree = infill.BlockTree(np.frombuffer(encoded, np.uint8), block)
            assert tree.units == len(units)
            for k in {0, 1, len(units) // 2, len(units)} & set(range(len(units) + 1)):
                head = "".join(units[:k])
                assert tree.cut(k) == (len(head.encode()), len(head))


def lines_left(rows, chars=20, least=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if len(holders.get(key(x), ())) < least or i == max((j for j in holders[key(x)] if j is not None), default=None)]
        out.append((i, len(every), len(every) - len(left), sha("\n".join(left))))
    return out


def some_lines(seed=4):
    rng = random.Random(seed)
    pool = [f"line number {k} of the common pool" for k in range(12)] + ["short", "", "exactly twenty chars", "nineteen characters", "日本語の行" * 4, "日本語の行" * 3 + "日本語", "Ümlaut line that is long enough", "ümlaut line that is long enough"]
    dress = lambda x: rng.choice([x, f"  {x}\t", x.upper(), x + "\r", f" {x}"])
    rows = [(i, "\n".join(dress(rng.choice(pool)) if rng.random() < 0.6 else f"own line {i} number {k} of this text" for k in range(rng.randint(1, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "trailing line break here\n"), (None, pool[0]), (None, f"{pool[1]}\n{pool[1]}"), rows[4], rows[4], (4, "another text\n" + pool[2])]
    return rows + [(200 + k, "a line that two documents hold\n" + "x" * 20) for k in range(2)] + [(300, "\n".join(["one line many times in one text"] * 500)), (301, "\n".join(["one line many times in one text"] * 3)), (302, "One line many times in one text")]


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    rows = some_lines()
    expected = sorted(map(repr, lines_left(rows)))
    for most in (lines.MAX_LINES, 0):
        monkeypatch.setattr(lines, "MAX_LINES", most)
        monkeypatch.setattr(lines, "MAX_DOCS", most)
        kept = lines.dedup(docs(spark, rows))
        got = kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
        assert sorted(repr(tuple(r)) for r in got) == expected
    assert kept.columns == ["doc_id", "text", "output", "n", "at", "text_hash", "n_lines", "n_dropped"] and kept.where("text IS NULL").count() == 1
    assert lines.dedup(docs(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, c, "q", 7) for i, e, c in rows], "vec_id long, embedding array<float>, label int, q string, error int")


def quantised(rows, parts=8, entries=16, rounds=6):
    """Everything in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in e], c) for i, e, c in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return [], ""
    w = max(1, -(-max(len(q) for _, q, _ in kept) // parts))
    kept = [(i, q + [0] * (parts * w - len(q)), c) for i, q, c in kept]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    first = [min(q for j, q, _ in kept if j == i) for i in ids]
    if len(first) < entries and any(i is None for i, _, _ in kept):
        first.append(min(q for i, q, _ in kept if i is None))
    books = [[q[p * w : p * w + w] for q in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda q, p: min(range(len(first)), key=lambda k: (far(q[p * w : p * w + w], books[p][k]), k))
    for _ in range(rounds):
        new = [[[] for _ in first] for _ in range(parts)]
        for _, q, _ in kept:
            for p in range(parts):
                new[p][pick(q, p)].append(q[p * w : p * w + w])
        books = [[[sum(x) // len(m) for x in zip(*m)] if m else books[p][k] for k, m in enumerate(new[p])] for p in range(parts)]
    out = []
    for i, q, c in kept:
        best = [pick(q, p) for p in range(parts)]
        out.append((i, c, "".join(f"{k:02x}" for k in best), sum(far(q[p * w : p * w + w], books[p][k]) for p, k in enumerate(best))))
    total = {}
    for _, c, _, e in out:
        total[c] = total.get(c, 0) + e
    return [(i, code, e, total[c]) for i, c, code, e in out], sha(",".join(str(x) for p in books for e in p for x in e))


def some_vectors(dims=16, n=120, seed=9, size=0.4):
    rng = random.Random(seed)
    rows = [(k * 3 - 30, [rng.gauss(0, size) for _ in range(dims)], rng.choice([None, 1, 2])) for k in range(n)]
    rows += [rows[2], rows[2], (rows[0][0], rows[5][1], 1), (None, rows[4][1], 2), (900, None, 1), (901, [None] * dims, 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] * dims, 1), (904, [0.0] * dims, 5)]
    return rows


@pytest.mark.parametrize("rows", [some_vectors(), some_vectors(16, 30, 3, 3000.0), some_vectors(13, 40, 5) + [(7_000, [0.5], 1), (7_001, [], None)], some_vectors(8, 7, 6), [(1, None, 1)], []])
def test_vector_codes_equal_brute_force(spark, rows):
    expected, digest = quantised(rows)
    got = codes.compressed(vectors(spark, rows)).collect()
    assert sorted(repr((r["vec_id"], r["code"], r["error"], r["label_error"])) for r in got) == sorted(map(repr, expected))
    assert {r["codebooks_sha256"] for r in got} == ({digest} if expected else set())


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(1)
    for bits, top in ((None, 1 << 28), (5, 1 << 20), (2, 1000), (None, 3)):
        a, b = rng.integers(-top, top + 1, (50, 9)), rng.integers(-top, top + 1, (7, 9))
        a[0], b[0] = top, -top
        expected = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
        assert codes.products(a, b, bits).tolist() == expected
    book = np.array([[1, 1], [0, 0], [1, 1], [2, 2]])
    assert codes.nearest(np.array([[1, 1], [3, 3], [1, 0]]), book)[0].tolist() == [0, 3, 0] and codes.nearest(np.array([[1, 0]]), book)[1].tolist() == [1]


def test_codes_decode_and_large_components_are_refused(spark):
    q, width = codes.integers(vectors(spark, some_vectors()))
    books = codes.fit(q)
    row = codes.encode(q, books).join(q.select("vec_id", F.col("q").alias("mine")).distinct(), "vec_id").where("vec_id = 33").first()
    assert width == 2 and sum((x - y) ** 2 for x, y in zip(codes.decode(row["code"], books).tolist(), row["mine"])) == row["error"]
    with pytest.raises(ValueError, match="too large"):
        codes.compressed(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_rare_pairs_hold_all_links(spark):
    from marketweave.llm import copies

    rng = random.Random(12)
    base = [rng.getrandbits(40) for _ in range(60)]
    sets = [base] + [[rng.getrandbits(40) if rng.random() < p else x for x in base] for p in (0.02, 0.05, 0.08, 0.1, 0.15, 0.3) for _ in range(12)]
    sets += [sets[k][: rng.randint(48, 60)] for k in range(20)] + [[1], [1], [1, 2], [3, 4, 5, 6, 7], [3, 4, 5, 6, 8], [3, 4, 5, 6], [rng.getrandbits(40)]]
    sets = [sorted(set(s)) for s in sets]
    sets = [s for k, s in enumerate(sets) if s not in sets[:k]]
    roots = [0 if len(set(s) & set(base)) > 54 else k for k, s in enumerate(sets)]
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9
    want = {(i, j) for j in range(len(sets)) for i in range(j) if roots[i] != roots[j] and alike(sets[i], sets[j])}
    df = spark.createDataFrame(list(enumerate(sets)), "sig long, s array<long>")
    got = {(r["a"], r["b"]) for r in copies.rare_pairs(df, spark.createDataFrame(list(enumerate(roots)), "sig long, root long")).collect()}
    assert want <= got and len(want) > 20 and len(got) < len(sets) * (len(sets) - 1) / 8
