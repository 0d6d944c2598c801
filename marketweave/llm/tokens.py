"""Token ids as packed binary files (operator 2): a PySpark data source that writes and reads them.

One shard per task, in the order of doc_id over all shards, and ``manifest.json`` with the committed shards and the number of ids before each. A shard holds
    header   "MWTB", version, bits per id, ids per block (little-endian uint16, uint16, uint32, after the 4 letters)
    blocks   ids packed in the fewest bits that hold the vocabulary, lowest bit first; each block starts at a whole byte
    footer   doc_id, null flag and number of ids of each document, byte offset of each block
    trailer  number of documents, ids, blocks, footer offset (uint64 each)
so that numpy unpacks whole blocks at once and any range of ids is found without reading what stands before it.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import common, words

HEAD, TAIL, BLOCK_IDS = struct.Struct("<4sHHI"), struct.Struct("<QQQQ"), 8192
WRITE_SCHEMA, READ_SCHEMA = "doc_id long, ids binary", "doc_id long, start long, n_tokens long, ids binary"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id of {int(ids.max())} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


@dataclass
class Shard(WriterCommitMessage, InputPartition):
    name: str
    task: int
    docs: int
    ids: int
    base: int = 0


class ShardWriter:
    """Streams documents into one shard; holds one block and the footer's columns."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, HEAD.size
        self.left, self.doc_ids, self.nulls, self.counts, self.offsets = np.zeros(0, np.uint32), [], [], [], []
        out.write(HEAD.pack(b"MWTB", 1, bits, BLOCK_IDS))

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.at += len(raw)
        self.out.write(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.left = np.concatenate([self.left, ids])
        whole = len(self.left) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._block(self.left[i : i + BLOCK_IDS])
        self.left = self.left[whole:]

    def close(self) -> int:
        if len(self.left):
            self._block(self.left)
        n_ids = int(sum(self.counts))
        for values, kind in ((self.doc_ids, "<i8"), (self.nulls, "u1"), (self.counts, "<i8"), ([*self.offsets, self.at], "<i8")):
            self.out.write(np.asarray(values, kind).tobytes())
        self.out.write(TAIL.pack(len(self.counts), n_ids, len(self.offsets), self.at))
        return n_ids


class ShardReader:
    """Random access to one shard through a seekable file."""

    def __init__(self, f):
        self.f = f
        magic, _, self.bits, self.block = HEAD.unpack(f.read(HEAD.size))
        if magic != b"MWTB":
            raise ValueError("not a file of packed token ids")
        f.seek(f.size() - TAIL.size)
        n, self.n_ids, blocks, at = TAIL.unpack(f.read(TAIL.size))
        f.seek(at)
        self.doc_ids, self.nulls = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(n), "u1").astype(bool)
        self.counts, self.offsets = np.frombuffer(f.read(8 * n), "<i8"), np.frombuffer(f.read(8 * (blocks + 1)), "<i8")

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks first to last - 1."""
        self.f.seek(int(self.offsets[first]))
        raw = self.f.read(int(self.offsets[last] - self.offsets[first]))
        size = -(-self.block * self.bits // 8)
        parts = [unpack(raw[(k - first) * size : (k - first + 1) * size], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(first, last)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the shard; reads their blocks only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        return self.blocks(first, (stop - 1) // self.block + 1)[start - first * self.block : stop - first * self.block]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        from pyspark import TaskContext

        fs, where = common.arrow_fs(self.path)
        fs.create_dir(where, recursive=True)
        task = TaskContext.get().partitionId()
        name, docs = f"part-{task:06d}-{uuid.uuid4().hex}.tokens", 0
        with fs.open_output_stream(f"{where}/{name}") as out:
            shard = ShardWriter(out, self.bits)
            for b in iterator:
                for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                    shard.add(doc_id, np.frombuffer(raw.as_buffer() or b"", "<u4"))
                    docs += 1
            return Shard(name, task, docs, shard.close())

    def commit(self, messages: list) -> None:
        fs, where = common.arrow_fs(self.path)
        base, shards = 0, []
        for s in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            shards.append({"name": s.name, "docs": s.docs, "ids": s.ids, "base": base})
            base += s.ids
        fs.create_dir(where, recursive=True)
        with fs.open_output_stream(f"{where}/manifest.json") as out:
            out.write(json.dumps({"bits": self.bits, "shards": shards}).encode())

    def abort(self, messages: list) -> None:
        fs, where = common.arrow_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{where}/{m.name}")


def manifest(path: str) -> list[dict]:
    fs, where = common.arrow_fs(path)
    with fs.open_input_stream(f"{where}/manifest.json") as f:
        return json.loads(f.read())["shards"]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Shard]:
        return [Shard(s["name"], k, s["docs"], s["ids"], s["base"]) for k, s in enumerate(manifest(self.path))] or [Shard("", 0, 0, 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, where = common.arrow_fs(self.path)
        with fs.open_input_file(f"{where}/{partition.name}") as f:
            r = ShardReader(f)
            ends = np.cumsum(r.counts)
            first = 0
            while first < len(ends):  # documents of about 64 blocks at a time, one at least
                begin = int(ends[first] - r.counts[first])
                last = max(first + 1, int(np.searchsorted(ends, begin + 64 * r.block, "right")))
                ids = r.ids(begin, int(ends[last - 1])).astype("<u4")
                cut = [0, *(ends[first:last] - begin)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r.doc_ids[first:last], pa.int64(), mask=r.nulls[first:last]), pa.array(ends[first:last] - r.counts[first:last] + partition.base, pa.int64()),
                    pa.array(r.counts[first:last], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])
                first = last


class PackedTokens(DataSource):
    """Format "packed_tokens": option path (with its scheme), and for writing vocabulary (number of different ids)."""

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], bits_for(int(self.options["vocabulary"])))


def read_range(path: str, start: int, stop: int) -> np.ndarray:
    """Ids start to stop - 1 of the whole corpus at path, which names its file system; opens only the shards and blocks that hold them."""
    fs, where = common.arrow_fs(path)
    parts = []
    for s in manifest(path):
        a, b = max(start, s["base"]), min(stop, s["base"] + s["ids"])
        if a < b:
            with fs.open_input_file(f"{where}/{s['name']}") as f:
                parts.append(ShardReader(f).ids(a - s["base"], b - s["base"]))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_loaded: dict[str, tuple] = {}


def _encoder(path: str):
    """The tokenizer of this Python worker, the id of a line break, whether words may be encoded apart, and the words met before."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        state = json.loads(t.to_str())
        pre = state.get("pre_tokenizer") or {}
        line = t.encode("\n", add_special_tokens=False).ids
        apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not state.get("normalizer") and len(line) == 1
        _loaded[path] = (t, line[0] if line else -1, apart, words.Known())
    return _loaded[path]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts by the tokenizers library, one after another, and how many each text has.

    Where the pattern of the tokenizer allows it, each different word of the texts is encoded once, thousands of them in one call with line breaks between.
    """
    t, line, apart, known = _encoder(path)

    def plain(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(some, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def joined(some: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        some = some.to_pylist()
        flat, _ = plain(["\n".join(some[i : i + 2000]) + "\n" for i in range(0, len(some), 2000)])
        breaks = np.flatnonzero(flat == line)
        return np.delete(flat, breaks), np.diff(breaks, prepend=-1) - 1

    if not apart:
        return plain(pc.fill_null(texts, "").to_pylist())
    return words.by_word(texts, lambda some: known.encoded(some, joined), plain)


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, end_id appended) of each row; null texts count as empty, other columns are ignored."""
    common.narrow_batches(docs.sparkSession)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = encode_texts(b.column("text"), tokenizer)
            ends = np.cumsum(counts)
            ids = [np.concatenate([flat[e - n : e], tail]).astype("<u4").tobytes() for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, WRITE_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int | None = None) -> None:
    """Encodes docs and writes them to path in ascending order of doc_id (nulls first, ties by text).

    The rows are dealt by ranges before they are encoded: finding the ranges must not encode twice. The first characters of the text count, too, so that many rows of one doc_id are spread.
    """
    docs.sparkSession.dataSource.register(PackedTokens)
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.left("text", F.lit(32))).sortWithinPartitions("doc_id", "text")
    encode(dealt, tokenizer, end_id).write.format("packed_tokens").option("vocabulary", vocabulary).mode("append").save(common.qualified(docs.sparkSession, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    spark.dataSource.register(PackedTokens)
    return spark.read.format("packed_tokens").load(common.qualified(spark, path))


def digests(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int) -> DataFrame:
    """Writes docs, reads the files back and returns doc_id, start, n_tokens, ids_crc32. Empty docs give an empty result; repeated rows are written as often as they stand."""
    path = common.scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, vocabulary, end_id)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
