"""Byte-level BPE encoding and decoding by merge replay (operator 7).

A worker gathers the different pieces of its documents that it hasn't met before into one vocabulary and merges all of them together: an index leads from the rank of a pair to the
places where it stands in any piece, the ranks are worked off from the lowest, each at all its places at once, and only the neighbours of a merged place get new
index entries. Pieces in which a merge opens a pair of lower rank than its own are merged again one pair at a time, as their order could differ.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, words

NONE = np.int64(1 << 40)


class Ranks:
    """A rank file: token bytes by rank, and the rank of every pair of tokens that is a token."""

    def __init__(self, tokens: dict[bytes, int]):
        self.rank = tokens
        self.size = max(tokens.values()) + 1
        self.byte = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        keys, vals = [], []
        for t, r in tokens.items():
            for i in range(1, len(t)):
                a, b = tokens.get(t[:i]), tokens.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    vals.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.vals = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(vals, np.int64)[order], NONE)
        text = [b""] * self.size
        for t, r in tokens.items():
            text[r] = t
        self.length = np.array([len(t) for t in text], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.text = np.frombuffer(b"".join(text), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it isn't a token."""
        key = a * self.size + b
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.vals[i], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.text[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def one(self, piece: bytes) -> list[int]:
        """A single piece, pair by pair: the lowest rank first, of equal ones the first from the left."""
        parts = [bytes([b]) for b in piece]
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or not parts[i] or self.rank.get(parts[i] + parts[j]) != r:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.rank.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [self.rank[p] for p in parts if p]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and the number of each; pieces aren't empty."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(pieces)), sizes)
        last = np.cumsum(sizes) - 1
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        after[last] = -1
        before[np.concatenate([[0], last[:-1] + 1])] = -1
        odd = np.zeros(len(pieces), bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks < NONE
            at, ranks = at[keep], ranks[keep]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edge = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for a, b, r in zip(edge, [*edge[1:], len(ranks)], ranks[edge].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(at[a:b])

        p = np.flatnonzero(after >= 0)
        enter(p, self.pair(sym[p], sym[after[p]]))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[alive[p]]
            p = p[after[p] >= 0]
            p = p[self.pair(sym[p], sym[after[p]]) == r]
            if not len(p):
                continue
            if len(p) > 1 and (touch := after[p[:-1]] == p[1:]).any():  # of overlapping places the first, third, ... are merged
                i = np.arange(len(p))
                p = p[(i - np.maximum.accumulate(np.where(np.append(False, touch), 0, i))) % 2 == 0]
            gone = after[p]
            sym[p], alive[gone] = r, False
            beyond = after[gone]
            after[p] = beyond
            before[beyond[beyond >= 0]] = p[beyond >= 0]
            left = before[p]
            at = np.unique(np.concatenate([left[left >= 0], p[beyond >= 0]]))
            ranks = self.pair(sym[at], sym[after[at]])
            odd[word[at[ranks < r]]] = True
            enter(at, ranks)
        ids, counts = sym[alive], np.bincount(word[alive], minlength=len(pieces))
        if odd.any():
            apart = np.split(ids, np.cumsum(counts)[:-1])
            for k in np.flatnonzero(odd):
                apart[k] = np.array(self.one(pieces[k]), np.int64)
            ids, counts = np.concatenate(apart), np.array([len(x) for x in apart])
        return ids, counts

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces: those that are tokens themselves are not merged."""
        rank = np.array([self.rank.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(rank < 0)
        ids, counts = self.replay([pieces[k] for k in rest]) if len(rest) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        place = np.arange(len(pieces))
        place[rest] = len(pieces) + np.arange(len(rest))
        return words.gather(np.concatenate([rank, ids]).astype(np.int32), np.concatenate([np.ones(len(pieces), np.int64), counts]), place)


_loaded: dict[tuple[str, str], tuple] = {}


def _load(path: str, pattern: str):
    """Ranks and compiled pattern of this Python worker, and the words that it has met."""
    if (path, pattern) not in _loaded:
        import regex

        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = Ranks(tokens), regex.compile(pattern), words.Known()
    return _loaded[path, pattern]


def encode_texts(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, end to end, and the number of each."""
    ranks, find, known = _load(path, pattern)

    def of(found: list[str], per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = pa.array(found, pa.large_string()).dictionary_encode()
        ids, counts = ranks.pieces([p.encode("utf-8") for p in code.dictionary.to_pylist()])
        flat, n = words.gather(ids, counts, code.indices.to_numpy())
        return flat, words.sums(n, per_word)

    def single(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [find.findall(w) for w in some]
        return of([p for ps in found for p in ps], np.array([len(ps) for ps in found], np.int64))

    def joined(some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = find.findall("\n".join(some.to_pylist()) + "\n") if len(some) else []  # before a blank, a line break is a piece of its own
        breaks = np.array([k for k, p in enumerate(found) if p == "\n"], np.int64)
        return of([p for p in found if p != "\n"], np.diff(breaks, prepend=-1) - 1)

    return words.by_word(texts, lambda some: known.encoded(some, joined), single)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ids (array of int) in place of text. Null texts count as empty; repeated rows are encoded alike; a column called ids is replaced."""
    common.narrow_batches(docs.sparkSession)
    kept = docs.drop("ids")
    names = [c for c in kept.columns if c != "text"]
    fields = [f for f in kept.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _lists(*encode_texts(b.column("text"), path, pattern))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], ids], [*names, "ids"])

    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))]))


def _decoded(ids: pa.Array, path: str, pattern: str) -> pa.Array:
    ranks = _load(path, pattern)[0]
    flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
    return pa.array([ranks.decode(flat[i - ends[0] : j - ends[0]]) for i, j in zip(ends, ends[1:])], pa.binary())


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with another column, decoded (binary): the bytes of its ids. A column called decoded is replaced."""
    kept = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("decoded", _decoded(b.column("ids"), path, pattern))

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, ids. Empty docs give an empty result. Both ways are taken by one worker of a task, as each takes memory of its own."""
    common.narrow_batches(docs.sparkSession)
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = _lists(*encode_texts(b.column("text"), path, pattern))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, _decoded(ids, path, pattern)], ["doc_id", "ids", "decoded"])

    fields = [kept.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    return kept.mapInArrow(run, T.StructType(fields)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "ids",
    )
