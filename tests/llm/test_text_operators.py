"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketweave.llm import bpe, common, copies, decontaminate, pii, quality, simhash, spans, tokens, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, pos int, fp long, score double"


def docs(spark, rows):
    """Documents with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 0.5) for i, t in rows], SCHEMA)


def some_texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma,", "delta", "Épsilon", "zeta.", "eta", "theta!", "iota", "kappa"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, rows[5][1]), (103, rows[5][1]), (5, "another text for the id five"), (None, rows[7][1]), (104, "word " * 20_000)]
    return rows


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_contamination_equals_brute_force(spark):
    rows = some_texts()
    items = [(1, " ".join(rows[3][1].split()[:14])), (2, rows[9][1]), (3, "beta"), (4, None), (5, ""), (6, "never anywhere in these texts"), (2, "gamma delta"), (None, "kappa iota"), (7, "word " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, t in rows:
        w, hit, ids = item_words(t), set(), set()
        for item, text in items:
            x = item_words(text)
            n = min(10, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            at = [k for k in range(len(w) - n + 1) if n and tuple(w[k : k + n]) in grams]
            if at:
                hit |= {p for k in at for p in range(k, k + n)}
                ids |= {str(item)} if item is not None else set()
        expected.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r)[:6] for r in decontaminate.contamination(docs(spark, rows), bench).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    clean = decontaminate.decontaminate(docs(spark, rows), bench)
    assert clean.columns == docs(spark, rows).columns and clean.count() == sum(not e[-1] for e in expected)


def test_contamination_of_documents_that_begin_inside_an_item(spark):
    item = [f"item{k}" for k in range(40)]
    rows = [(1, " ".join(item[5:35])), (2, " ".join(item[5:16] + ["other", "words"])), (3, " ".join(item[31:] + ["too", "short"]))]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs(spark, rows), bench).collect()}
    assert got == {1: (30, 30, 1, True), 2: (13, 11, 1, True), 3: (11, 0, 0, False)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()] == [3]


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs(spark, []), none).count() == 0
    assert decontaminate.contamination(docs(spark, [(1, "a b")]), none).first()["contaminated"] is False


def test_proximity_finds_terms_in_any_order(spark):
    d = docs(spark, [(1, "red far away from the green door"), (2, "green door is red"), (3, "door green")])
    items = spark.createDataFrame([(1, "red green door")], "item_id long, text string")
    w = decontaminate.phrases(items)
    got = decontaminate.proximity_matches(decontaminate.build_index(d), w, 3).collect()
    assert {r["doc_id"] for r in got} == {2}


def fingerprint(t):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark):
    rows = some_texts(8, 40)
    rng = random.Random(1)
    long = " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(400))
    rows += [(200 + k, long.replace(" ", f" x{k} ", 1)) for k in range(12)]
    fps = {(i, t): fingerprint(t) for i, t in rows}
    values = sorted(set(fps.values()))
    at = groups(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for (i, t), f in fps.items():
        if i is not None:
            least[at[f]] = min(least.get(at[f], i), i)
    expected = sorted([(i, f"{fps[i, t]:016x}", least.get(at[fps[i, t]])) for i, t in rows], key=repr)
    got = sorted([tuple(r)[:3] for r in simhash.near_duplicates(docs(spark, rows)).collect()], key=repr)
    assert got == expected


def test_links_connect_all_fingerprints_two_bits_apart(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(3)]
    values = sorted(set(base + near + [0, 1, (1 << 63), (1 << 64) - 1, (1 << 63) | 1]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = groups(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2])
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in edges)
    got = groups(values, edges)
    assert len(set(got.values())) == len(set(expected.values())) and all((got[a] == got[b]) == (expected[a] == expected[b]) for a in values for b in values)


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)]
    rng = random.Random(4)
    rng.shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}


def test_a_round_of_components_takes_seven_jobs_at_most(spark):
    context, before = spark.sparkContext, len(simhash.common._made)
    context.setJobGroup("components", "")
    try:
        simhash.components(spark.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long"))
        jobs = len(context.statusTracker().getJobIdsForGroup("components"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    rounds = len(simhash.common._made) - before - 1  # the first table is that of the edges
    assert jobs <= 2 + 7 * rounds  # every job costs the driver memory
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_row_of_each_group(spark):
    rows = some_texts(8, 20)
    kept = simhash.dedup(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, [r for r in rows if r[0] not in (5, None)])).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(103) <= 1 and all(found.get(i, i) == i for i in ids if i not in (5, None))
    assert simhash.dedup(docs(spark, [])).count() == 0


def shingle_sets(rows):
    out = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        out.append(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    return out


def near_copies(rows):
    """The component of each row: sets of five-word runs with a Jaccard similarity of 0.8 or more, by comparing all with all that share a run."""
    sets, holders = shingle_sets(rows), {}
    kinds = sorted(set(sets), key=sorted)
    for k, s in enumerate(kinds):
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}
    at = groups(range(len(kinds)), [(a, b) for a, b in pairs if 5 * len(kinds[a] & kinds[b]) >= 4 * len(kinds[a] | kinds[b])])
    number = {s: k for k, s in enumerate(kinds)}
    return [at[number[s]] for s in sets]


def test_pipeline_stage_drops_near_copies_that_simhash_misses(spark):
    import corpus_pipeline as cp

    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 9999))
    common, rows = " ".join(word() for _ in range(30)), some_texts(8, 20)
    for g in range(12):
        w = [word() for _ in range(rng.choice((12, 60, 150, 400)))] + common.split()
        for c in range(12):
            x = list(w)
            for _ in range(c % 5 * len(w) // 60):
                x[rng.randrange(len(x))] = word()
            rows.append((1000 + 20 * g + c, " ".join(x)))
    at, least = near_copies(rows), {}
    for (i, _), c in zip(rows, at):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    expected = sorted([(i, least.get(c)) for (i, _), c in zip(rows, at)], key=repr)
    assert sorted([tuple(r)[:2] for r in copies.groups(docs(spark, rows)).collect()], key=repr) == expected
    kept = {r["doc_id"] for r in cp.near_duplicates(spark, docs(spark, rows), "").collect()}
    assert kept == {i for i, c in expected if i == c} | {None}
    assert copies.groups(docs(spark, [])).count() == 0


def test_pipeline_stage_links_fingerprints(spark, monkeypatch):
    """The stage takes candidates from the links of operator 10, and an exact check follows: texts of like fingerprints alone stay."""
    import corpus_pipeline as cp

    sets = [(1, 0b1), (2, 0b1), (3, 0b111), (4, 0b1 << 40 | 0b111), (5, 0b1111 << 20), (6, 0b111)]
    pairs = {tuple(sorted(p)) for p in copies.fingerprint_pairs(spark.createDataFrame(sets, "sig long, fp long")).collect()}
    near = {(a, b) for a, x in sets for b, y in sets if a < b and bin(x ^ y).count("1") <= 2}
    assert pairs <= near and len(set(groups(range(1, 7), pairs).values())) == len(set(groups(range(1, 7), near).values())) == 2
    linked, met = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda fps: met.append({r["fp"] for r in fps.collect()}) or linked(fps))
    words = [f"w{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(words[::-1])), (4, None)]
    assert {r["doc_id"] for r in cp.near_duplicates(spark, docs(spark, rows), "").collect()} == {1, 3, 4}
    assert met == [{simhash.fingerprint(t) for _, t in rows}]


def test_every_link_of_fingerprints_is_checked(spark):
    """No band is shared here: near copies meet by their fingerprints alone, also where the least text of these is like none of them, and by each fingerprint of texts that have the same runs."""
    rng = random.Random(3)
    text = lambda: [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(60)]
    y = text()
    y, z = " ".join(y), " ".join([*y[:-1], "end"])
    sig = lambda x: copies._signature(copies.shingles(x))
    u = min((" ".join(text()) for _ in range(40)), key=sig)
    assert sig(u) < min(sig(y), sig(z))
    for rows, fps in (([(1, u), (2, y), (3, z)], {1: 5, 2: 5, 3: 5}), ([(1, u), (2, y), (3, z)], {1: 5, 2: 7, 3: 13}), ([(1, y), (2, y), (3, z)], {1: 0, 2: 0b11111 << 20, 3: 0b11101 << 20})):
        own = copies.bands(docs(spark, rows)).withColumn("keys", F.array(F.xxhash64("doc_id"))).withColumn("fp", F.element_at(F.create_map(*[F.lit(v).cast("long") for kv in fps.items() for v in kv]), F.col("doc_id")))
        got = copies.links(docs(spark, rows), common.store(own, "own")).collect()
        at = groups({sig(x) for _, x in rows}, [(r["a"], r["b"]) for r in got])
        assert at[sig(y)] == at[sig(z)] and (sig(u) not in at or at[sig(u)] != at[sig(y)])


def test_near_copies_of_the_test_data(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    table = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    at, least = near_copies(rows), {}
    for (i, _), c in zip(rows, at):
        least[c] = min(i, least.get(c, i))
    assert sorted(tuple(r)[:2] for r in copies.groups(table).collect()) == sorted((i, least[c]) for (i, _), c in zip(rows, at))


def units(text):
    """The units of a text, word by word: sentences, cut again behind words that a hash of their length and last two bytes picks."""
    parts, unit = re.findall(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text), ""
    for p in parts:
        unit += p
        w = p.strip(" \t\n\x0b\x0c\r").encode().lower()
        last, before = w[-1], w[-2] if len(w) > 1 else 0
        x = (last + before * 256 + len(w) * 65536) * 0x9E3779B1 % (1 << 32)
        x = (x ^ x >> 15) * 0x85EBCA6B % (1 << 32)
        if re.search(rb"[.!?][\"')\]]?$", w) or (x >> 16) % spans.INNER_BORDERS == 0:
            yield unit
            unit = ""
    if unit:
        yield unit


def without_spans(rows):
    """Text and number of removed units of each different row, by comparing all runs of all documents."""
    where, runs = {}, {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0]))
    for d in order:
        u = list(units(d[1]))
        n = [len(x.split()) for x in u]
        for a in range(len(u)):
            e = next((e for e in range(a + spans.LEAST_UNITS, len(u) + 1) if sum(n[a:e]) >= spans.LEAST_WORDS), None)
            if sum(n) < spans.LEAST_WORDS:  # the whole text is one run
                e = None if a else len(u)
            if e:
                words = tuple(w for x in u[a:e] for w in re.sub("[A-Z]", lambda m: m[0].lower(), x).split())
                where.setdefault(words, []).append((d, a))
                runs[d, a] = words, e
    out = {}
    for d in order:
        u, gone = list(units(d[1])), set()
        for a in range(len(u)):
            words, e = runs.get((d, a), (None, 0))
            if words and len({x for x, _ in where[words]}) > 1:
                first, at = where[words][0]
                gone |= set(range(max(a, at + e - a) if first == d else a, e))
        out[d] = "".join(x for k, x in enumerate(u) if k not in gone) if u else d[1], len(gone)
    return out


def prose(rng, n):
    """Sentences of 1 to 40 words, some with line breaks behind them."""
    out = []
    while len(out) < n:
        s = [rng.choice("bdfgklmnprst") + "".join(rng.choice("aeiounrst") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 40))]
        out += [*s[:-1], s[-1] + rng.choice([".", "!", "?", '."', ".\n", ".\n\n"])]
    return " ".join(out[:n]).capitalize()


def test_repeated_spans_equal_brute_force(spark):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (20, 30, 60, 60, 200)]
    rows = [(i, " ".join([prose(rng, rng.randint(1, 80)), rng.choice(shared), prose(rng, rng.randint(1, 80))])) for i in range(60)]
    rows += [(100, shared[2]), (101, shared[2].upper().replace(" ", "  ")), (102, None), (103, ""), (104, " \n "), rows[7], (8, rows[9][1]), (None, rows[10][1]), (105, "  \n" + shared[4]), (106, "tel  " * 60), (107, prose(rng, 20_000))]
    rows += [(110, " ".join([prose(rng, 40)] * 5))]
    expected = without_spans(rows)
    table = docs(spark, rows).withColumn("n_removed", F.lit("old")).withColumn("changed", F.lit(1))
    found = spans.dedup(table)
    assert found.columns == [*docs(spark, rows).columns, "n_removed", "changed"]
    got = [(r["doc_id"], r["text"], r["n_removed"], r["changed"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted([(i, *expected.get((i, t), (t, 0)), expected.get((i, t), (t, 0))[1] > 0) for i, t in rows], key=repr)
    assert sum(g[2] > 0 for g in got) > 30 and next(g for g in got if g[0] == 110)[2] == 0
    assert spans.dedup(docs(spark, [])).count() == 0


def test_repeats_inside_one_document_go_where_asked(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 60), prose(rng, 60)
    rows = [(1, " ".join([passage] * 5)), (2, other), (2, other), (3, "word " * 60)]
    got = {r["doc_id"]: (r["text"], r["changed"]) for r in spans.dedup(docs(spark, rows), alone=True).collect()}
    assert got[1][1] and 60 <= len(got[1][0].split()) < 120 and got[1][0].startswith(passage[:200])
    assert got[2] == (other, False)
    assert got[3][1] and spans.LEAST_WORDS <= got[3][0].count("word") < 60


def test_passages_of_over_fifty_words_are_caught_anywhere(spark):
    """Passages that begin and end inside sentences, long sentences, and sentences of a word."""
    rng = random.Random(5)
    rows, planted = [], set()
    for i in range(150):
        style = i % 3
        words = prose(rng, 90).split() if style else prose(rng, 90).replace(".", "").replace("!", "").replace("?", "").split()
        passage = " ".join(w + "." if style == 2 else w for w in words[13:70])
        for d in (i, 1000 + i):
            rows.append((d, " ".join([prose(rng, 60), passage, prose(rng, 70)])))
        planted.add(1000 + i)
    changed = {r["doc_id"] for r in spans.dedup(docs(spark, rows)).where("changed").collect()}
    assert changed <= planted and len(changed) / len(planted) >= 0.97


def test_short_copies_texts_without_blanks_and_periodic_texts(spark):
    japanese = "".join(chr(0x4E00 + k * 37 % 5000) + ("。" if k % 20 == 19 else "") for k in range(160))
    seventeen = "seventeen words that stand in two documents and are no more than these few words at all here"
    rows = [(1, seventeen), (2, seventeen.upper()), (3, japanese), (4, japanese), (5, "ほかの文章です。" + japanese[20:120] + "終わりの文です。"), (6, "other short words"), (7, ""), (8, "word " * 60), (9, "word " * 60), (10, "one"), (11, "one"), (12, "それは違う文章です。")]
    got = {r["doc_id"]: r["text"] for r in spans.dedup(docs(spark, rows)).collect()}
    assert (got[1], got[2], got[3], got[4], got[6], got[7], got[10], got[11], got[12]) == (seventeen, "", japanese, "", "other short words", "", "one", "", "それは違う文章です。")
    assert got[5].startswith("ほかの文章です。") and got[5].endswith("終わりの文です。") and len(got[5]) < 100
    assert got[8].count("word") >= spans.LEAST_WORDS and got[9] == ""  # the first keeps a whole run


ODD = list("aaab  \n\n\t'sté한국😀1 9!!.-_<|>\x1c\x85\xa0᠎​　ABthe")


def odd_texts(n=400):
    rng = random.Random(1)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 300, "!" * 999, "<|endoftext|> x", "", None]


def lists(found):
    flat, counts = found
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    assert lists(bpe.encode_texts(pa.array(texts), path, pattern)) == [library.encode_ordinary(t or "") for t in texts]
    rows = list(enumerate(texts[:50])) + [(900, None), (None, "x"), (3, texts[3])]
    got = bpe.decode(bpe.encode(docs(spark, rows), path, pattern), path, pattern)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in got.where("doc_id IS NOT NULL").collect()) == sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    assert bpe.round_trip(docs(spark, []), path, pattern).count() == 0


def test_merges_of_a_rank_file_that_is_not_nested():
    """Where a merge opens a pair of lower rank than its own, pieces are merged one pair at a time."""
    vocab = {bytes([b]): b for b in range(256)} | {b"cd": 256, b"bcd": 257, b"abcd": 258, b"ab": 259, b"aa": 260, b"aaa": 261}
    r = bpe.Ranks(vocab)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)] + [b"a" * 9, b"abcdabcd"]
    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, i = min((vocab.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [vocab[p] for p in parts]

    flat, counts = r.replay(pieces)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [plain(p) for p in pieces] == [r.one(p) for p in pieces]
    assert len(r.one(b"abcd" * 50_000)) == 50_000  # long pieces take no square of their length


def test_token_words_equal_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = odd_texts()
    for _ in range(2):  # with and without remembered words
        assert lists(tokens.encode_texts(pa.array(texts), path)) == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 1 << bits, 10_001).astype(np.uint32)
    raw = tokens.pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8) and (tokens.unpack(raw, len(ids), bits) == ids).all()
    with pytest.raises(ValueError):
        tokens.pack(np.array([1 << bits], np.uint64), bits)


def test_token_files_round_trip_and_random_access(spark, tmp_path):
    path, where = tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t"
    rows = [(i, t) for i, t in enumerate(odd_texts(60))] + [(7, "again seven"), (None, "no id")]
    tokens.write(docs(spark, rows), where, path, 50_257, 0)
    got = sorted(tokens.read(spark, where).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] + sorted(i for i, _ in rows if i is not None)
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got])
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    for a, b in ((0, 5), (100, 101), (50, len(stream)), (len(stream), len(stream) + 5)):
        assert (tokens.read_range(common.qualified(spark, where), a, b) == stream[a:b]).all()
    one = next(r for r in got if r["doc_id"] is None)
    assert zlib.crc32(one["ids"]) == zlib.crc32(np.array(lists(tokens.encode_texts(pa.array(["no id"]), path))[0] + [0], "<u4").tobytes())
    assert tokens.digests(docs(spark, []), path, 50_257, 0).count() == 0


def labelled(spark, n=400):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        bad, junk = i % 4 == 0, i % 5 == 0
        w[rng.randrange(60)] = "scoundrel" if bad else "gentleman"
        rows.append((i, " ".join(x + "%%%" if junk else x for x in w)))
        labels.append((i, int(not junk), int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,mod,left", [(toxicity, "toxic", 5, 0), (quality, "quality", 4, 2)])
def test_classifiers_on_held_out_rows(spark, module, label, mod, left):
    rows, labels = labelled(spark)
    rows += [(1000, None), (1001, ""), (1002, "x" * 300_000), (None, "no id"), (3, rows[3][1])]
    got = module.scores(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == left) for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95
    none = labels.limit(0)
    assert len({r["score"] for r in module.scores(docs(spark, rows), none).collect()}) == 1
    assert module.scores(docs(spark, []), none).count() == 0


def test_surrogates_keep_identity_format_and_distinctness(spark):
    mails = [f"user{i}@corp{i % 7}.example.net" for i in range(300)]
    rows = [(i, f"Write to {m} or call +1 (555) 010-{i:04d}.") for i, m in enumerate(mails)]
    rows += [(500, "USER7@CORP0.EXAMPLE.NET and user7@corp0.example.net, +1-555-010-0007"), (501, "4111 1111 1111 1111 / 4111111111111111"), (502, 'token = "186661156f3f9905942d70850a01cbf23a203f82"'),
             (503, "Mr. John Smith met Mrs. Anna Smith; Mr. Smith left. господин Иван Петров пришёл."), (504, None), (505, ""), (506, "2024-01-01, 3.14 and 12345 stay"), (None, "mail a@b.org"), (3, rows[3][1])]
    got = pii.replace(docs(spark, rows), "key").collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[504] is None and text[505] == "" and text[506] == rows[-3][1]
    new = [re.search(r"\S+@\S+", text[i]).group() for i in range(300)]
    assert len(set(new)) == 300 and not set(new) & set(mails) and all(n.endswith(".net") for n in new)
    phones = [re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[i]).group() for i in range(300)]
    assert len(set(phones)) == 300
    a, b, c = re.match(r"(\S+) and (\S+), (\S+)", text[500]).groups()
    assert a.lower() == b and a == a.upper() and b == new[7] and re.sub(r"\D", "", c) == re.sub(r"\D", "", phones[7])
    card, same = text[501].split(" / ")
    digits = [int(x) for x in same]
    assert card.replace(" ", "") == same != "4111111111111111" and sum(sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', text[502]) and "186661156f3f" not in text[502]
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) left\. господин ([А-Яа-я-]+) ([А-Яа-я]+) пришёл\.", text[503]).groups()
    assert names[1] == names[3] == names[4] and names[0] in pii.GIVEN["male", "latin"] and names[2] in pii.GIVEN["female", "latin"] and "Smith" not in names
    assert pii.replace(docs(spark, []), "key").count() == 0


def replaced(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in pii.replace(docs(spark, rows), "key").collect()}
    return [got[i] for i, _ in rows]


def test_secrets_of_any_length_and_make(spark):
    rng = random.Random(3)
    letters = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16))
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-_") for _ in range(1000)) + "x"
    hexadecimal = "".join(rng.choice("0123456789abcdef") for _ in range(126)) + "a1"
    pem = "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(64))
    secrets = ["AKIA" + letters, "ghp_" + "a" * 36, "gho_" + "b" * 50, "github_pat_" + "c" * 30, "sk-proj-" + long[:60] + "q", hexadecimal]
    quoted = ['password = "********"', "secret: '------'", f'api_key="{long[:150]}"', f'token = "{long}"', 'passwd="......"', 'token="......"']
    texts = [f"before {x} after" for x in secrets] + quoted + [f"-----BEGIN RSA PRIVATE KEY-----\n{pem}\n{pem}\n-----END RSA PRIVATE KEY-----"] + [f"word {k} {x}" for k, x in enumerate(secrets)]
    got = replaced(spark, texts)
    for x, old, new in zip(secrets, texts, got):
        assert x not in new and re.fullmatch(r"before \S+ after", new) and len(new) >= len(old)
    for old, new in zip(quoted, got[len(secrets) :]):
        head = re.match(r".*?[\"']", old)[0]
        assert new != old and new.startswith(head) and new[-1] == old[-1] and len(new) >= len(old)
    key = got[len(secrets) + len(quoted)]
    assert pem not in key and re.fullmatch(r"-----BEGIN RSA PRIVATE KEY-----\n.{64}\n.{64}\n-----END RSA PRIVATE KEY-----", key)
    assert [g.split()[1] for g in got[: len(secrets)]] == [g.split()[2] for g in got[-len(secrets) :]]  # the same surrogate everywhere
    assert len({g.split('"')[1] for g in got if g.startswith(("passwd", "token=")) and "......" not in g}) == 1


def test_numbers_addresses_and_titles(spark):
    texts = ["call 555.123.4567 or 06131/123456 or 0171 1234567 or 010-1234-5678 now", "host 2001:db8:85a3::8a2e:370:7334 and fe80::1, time 12:34:56, std::vector a::b", "Dr. Anna Lee and Prof. Bruno Lee met Mr. 김철수 and Mrs. 김철수", "v 1.2.3.4567 and 3.141592653 stay, 12/2024 and 2024/123456 too"]
    a, b, c, d = replaced(spark, texts)
    assert re.fullmatch(r"call \d{3}\.\d{3}\.\d{4} or \d{5}/\d{6} or \d{4} \d{7} or \d{3}-\d{4}-\d{4} now", a) and not any(x in a for x in ("555.123.4567", "06131/123456", "0171 1234567", "010-1234-5678"))
    assert "2001:db8:85a3::8a2e:370:7334" not in b and "fe80::1," not in b and b.endswith("time 12:34:56, std::vector a::b")
    names = re.fullmatch(r"Dr\. (\w+) (\w+) and Prof\. (\w+) (\w+) met Mr\. ([가-힣]{3}) and Mrs\. ([가-힣]{3})", c).groups()
    assert names[1] == names[3] != "Lee" and names[4] == names[5] != "김철수" and {names[0], names[2]} <= set(pii.GIVEN["both", "latin"])
    assert d == texts[3]


LEAKS = [
    '{"password": "hunter2secret"} ', "password=hunter2secret ", 'password: "pass word secret"', "slack xoxb-2345678901-abcdefghijkl", "key AIza" + "SyA-b_" * 6, "jwt eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmN",
    "addr fdab::cd:ef", "addr FE80::1", "addr 2001:DB8::ff01 or 2600:1406::17", "met Mr. O'Brien there", "lives at 221 Baker Street", "lives at 7 Rose Hill Ave.",
]


def test_leaks(spark):
    got = replaced(spark, LEAKS)
    forms = [r'\{"password": "([a-z]{6}\d[a-z]{6})"\} ', r"password=([a-z]{6}\d[a-z]{6}) ", r'password: "([a-z]{4} [a-z]{4} [a-z]{6})"', r"slack ([a-z]{4}-\d{10}-[a-z]{12})", r"key (\S{40})", r"jwt (\w+\.\w+\.\w+)",
             "addr (fdab::[a-f]{2}:[a-f]{2})", r"addr (FE80::\d)", r"addr (2001:db8::[a-f]{2}\d\d) or 2001:db8::\d\d", "met Mr. ([A-Z][a-z]+) there", r"lives at (\d{3} [A-Z][a-z]+) Street", r"lives at (\d [A-Z][a-z]+) Ave\."]
    for old, new, form in zip(LEAKS, got, forms):
        found = re.fullmatch(form, new)
        assert found and found[1] not in old, (old, new)
    assert got[0].split('"')[3] == got[1].split("=")[1].strip()
    stay = ["password: required", "if token == 12345678 and x", "secret='short'", "std::vector a::b, 12:34:56", "42 items on the Main Street", 'say "hello world" and go', "Mr. who's there", "It's O'Brien"]
    assert replaced(spark, stay) == stay


@pytest.mark.parametrize("seed", range(3))
def test_cheap_marks_lose_no_entity(spark, seed):
    rng = random.Random(seed)
    bits = ["fdab", "::", ":", "cd", "Mr. ", "O'", "Brien", "password", "=", '"', "abcdef", "xoxb-", "eyJ", ".", "AIza", "a" * 12, " ", "@", "b.org", "sk-", "Street", "Rose ", "1", "FC00"]
    table = docs(spark, [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))) for i in range(3000)])
    both = table.select(pii.private(F.col("text")).alias("a"), F.col("text").rlike(pii.ANY).alias("b")).groupBy("a", "b").count().collect()
    assert {(r["a"], r["b"]) for r in both} == {(True, True), (False, False)}


JAVA_ONLY = [("(?<sep>", "(?P<sep>"), (r"\k<sep>", "(?P=sep)"), (r"\p{IsHangul}", r"\p{Hangul}")]


def kind_of(prefix, mention):
    digits = re.sub(r"\D", "", mention)
    if prefix:
        return "secret" if prefix.rstrip()[-1] in "\"'=:>-" else "name"
    if re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\W\d_]+", mention):
        return "email"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", mention, re.ASCII):
        return "ip"
    if re.match(r"\d{1,5} [^\W\d_]", mention):
        return "street"
    if ":" in mention and re.fullmatch("[0-9A-Fa-f:]+", mention):
        return "ipv6"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", mention, re.ASCII):
        return "ssn"
    if re.fullmatch(r"\d[\d -]*", mention, re.ASCII) and 13 <= len(digits) <= 19:
        return "card"
    if re.fullmatch(r"[+(]?\d[\d ()./-]*", mention, re.ASCII) and not mention.isdigit():
        return "phone"
    return "iban" if re.fullmatch(r"[A-Z]{2}\d{2}[ 0-9A-Z]{11,36}", mention) and 15 <= len(mention.replace(" ", "")) <= 34 else "secret"


def spelled(kind, word, new):
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(new)
        keep = (lambda c: c == " ") if kind == "iban" else (lambda c: not c.isdigit())
        return "".join(c if keep(c) else next(left) for c in word) + "".join(left)
    if kind == "secret":
        return "".join((c or "").upper() if m and m.isupper() else c or "" for m, c in itertools.zip_longest(word, new))
    if word == word.upper() != word.lower():
        return new.upper()
    return new.title() if kind == "street" else new[0].upper() + new[1:].lower() if kind == "name" and word[0].isupper() else new


def test_replacement_equals_another_implementation(spark):
    """Entities found by another pattern engine and put in from the dictionary, whose surrogates differ from one another and from all entities."""
    import regex

    pattern, head = pii.ANY, pii.PREFIX
    for a, b in JAVA_ONLY:
        pattern, head = pattern.replace(a, b), head.replace(a, b)
    find, prefix, women, both = regex.compile(pattern), regex.compile(head), regex.compile(f"(?:{pii.WOMEN}) "), regex.compile(f"(?:{pii.BOTH}) ")
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()] if os.path.exists(path) else []
    rows += [(10_000, "word " * 20_000 + "a@b.org"), (10_001, "x" * 100_000 + " +1 555 010 0007"), (10_004, LEAKS[0] + LEAKS[1] + "Mr. O'Brien, Mrs. Mary O'Brien, 12 Long Hill Road"), (10_002, "Mr. John Smith, Dr. Smith"), (10_002, "Mr. John Smith, Dr. Smith"), (10_003, None), (None, "")]
    table = docs(spark, rows).withColumn("n_entities", F.lit("old")).withColumn("entity_kinds", F.lit(1)).withColumn("kind", F.lit("k")).withColumn("surrogate", F.lit("s"))
    book = {tuple(r)[:4]: r["surrogate"] for r in pii.dictionary(pii._words(pii.mentions(table)), "key").collect()}
    for kind in {k[0] for k in book}:
        real, new = {k[1] for k in book if k[0] == kind}, [v for k, v in book.items() if k[0] == kind]
        assert len(set(new)) == len(new) and not real & set(new)
    canonical = lambda k, w: re.sub(r"\D", "", w) if k in ("card", "ssn", "phone") else w.replace(" ", "") if k == "iban" else w.lower()
    expected = []
    for i, text in rows:
        kinds = set()

        def new(m):
            before = (prefix.match(m[0]) or [""])[0]
            mention, kind = m[0][len(before) :], kind_of(before, m[0][len(before) :])
            kinds.add(kind)
            if kind != "name":
                return before + spelled(kind, mention, book[kind, canonical(kind, mention), "", ""])
            gender = "female" if women.fullmatch(before) else "both" if both.fullmatch(before) else "male"
            words = regex.findall(r"\p{L}+(?:['’]\p{L}+)*|\P{L}+", mention)
            last = max(k for k, w in enumerate(words) if w[0].isalpha())
            return before + "".join(spelled(kind, w, book[kind, w.lower(), "family" if k == last else "given", "" if k == last else gender]) if w[0].isalpha() else w for k, w in enumerate(words))

        done = None if text is None else find.sub(new, text)
        expected.append((i, done, len(find.findall(text or "")), sorted(kinds)))
    got = [(r["doc_id"], r["text"], r["n_entities"], r["entity_kinds"]) for r in pii.replace(table, "key").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_surrogates_are_drawn_again_until_they_differ(spark):
    """Two-digit domains do not exist, so short secrets make collisions likely."""
    words = spark.createDataFrame([("name", f"n{i}", "given", "male", "latin") for i in range(60)], "kind string, entity string, part string, gender string, script string")
    got = pii.dictionary(words, "k").collect()
    assert len(got) == 60 and len({r["surrogate"] for r in got}) == 60


def test_pipeline_equals_its_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline as cp

    rows, labels = labelled(spark, 120)
    rows = [(i, f"{t} unique{i} words{i} end{i}") for i, t in rows]
    passage = "this benchmark passage of more than ten words must never be trained on"
    rows += [(300, rows[1][1]), (301, f"before {passage} after"), (302, "write to someone.else@mail.example.org about it today please")]
    table = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    toxic = {r["doc_id"] for r in toxicity.scores(table, labels).collect() if r["predicted"] == 1}
    at = groups(sorted({fingerprint(t) for i, t in rows if i not in toxic}), [])
    values = list(at)
    at = groups(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 2])
    first = {}
    for i, t in rows:
        if i not in toxic:
            first[at[fingerprint(t)]] = min(i, first.get(at[fingerprint(t)], i))
    assert set(got) == set(first.values()) - {301} and 300 not in got and 302 in got
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    text = {int(b): a for a, b in ranks.items()}
    decoded = b"".join(text[x] for x in got[302]["ids"])
    assert b"someone.else@" not in decoded and b"@mail" in decoded and hashlib.sha256(decoded).hexdigest() == got[302]["decoded_sha256"]


def test_pipeline_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, "a text of its own with some words"), (1, "a text of its own with some words"), (2, None), (3, ""), (4, " \n "), (5, "another text that stands alone here"), (None, "no id but a text"), (6, 'password = "********" in it')]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    for where in (tmp_path, tmp_path / "none"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 2, 5, 6] and {r["doc_id"]: r["n_tokens"] for r in got}[2] == 0
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    table = docs(spark, rows)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns


def test_token_files_of_one_doc_id_and_long_texts(spark, tmp_path):
    """Ties of doc_id are written in the order of their texts, whatever partition they are in."""
    path, where = tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/t"
    rng = random.Random(2)
    rows = [(7, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for _ in range(300)] + [(None, None), (None, "x"), (8, "word " * 100_000), (6, "six")]
    tokens.write(docs(spark, rows), where, path, 50_257, 0)
    got = sorted(tokens.read(spark, where).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in got] == [i for i, _ in order]
    assert [np.frombuffer(r["ids"], "<u4")[:-1].tolist() for r in got] == lists(tokens.encode_texts(pa.array([t for _, t in order]), path))


def test_paths_of_spark_and_of_python_workers(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://127.0.0.1:9")
        assert common.qualified(spark, "/shared/ck") == "hdfs://127.0.0.1:9/shared/ck"  # not a folder of each machine
        assert common.qualified(spark, "file:///a/b").startswith("file:/")
    finally:
        conf.set("fs.defaultFS", before)
    assert common.arrow_uri("s3a://bucket/a b/c") == "s3://bucket/a%20b/c" and common.arrow_uri("file:/a/b") == "file:///a/b"
    where, path = common.arrow_fs(common.qualified(spark, str(tmp_path / "a b%20")))
    assert where.type_name == "local" and path == str(tmp_path / "a b%20")
    with pytest.raises(ValueError, match="names no file system"):
        common.arrow_fs("/shared/ck")
    with pytest.raises(ValueError, match="cannot reach dbfs"):
        common.arrow_fs("dbfs:/shared/ck")
