"""Fill-in-the-middle transformation (operator 11).

A text is a sequence of units: words with the white space before them, and white space at the end. Two cuts behind whole units, drawn from a hash of the document's id, give
prefix, middle and suffix, which are put together in another order behind marks. A Fenwick tree over fixed blocks of the text's bytes holds how many units end and how many
code points begin in each block; a binary-lifting descent finds the block of a cut, and only that block is searched for the place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED, RATE, SPM_RATE = 42, 50, 80
#: Before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a block.
BLOCK = 4096
VISIBLE = np.ones(256, bool)
VISIBLE[list(b" \t\n\x0b\x0c\r")] = False


class BlockTree:
    """Fenwick tree over blocks of a text's bytes: units that end and code points that begin in them."""

    def __init__(self, raw: np.ndarray, block: int = BLOCK):
        self.raw, self.block = raw, block
        starts = np.arange(0, len(raw), block)
        self.blocks = len(starts)
        per_block = np.zeros((2, self.blocks), np.int64)
        if self.blocks:
            per_block[0] = np.add.reduceat(self._ends(0, len(raw)), starts, dtype=np.int64)
            per_block[1] = np.add.reduceat((raw & 0xC0) != 0x80, starts, dtype=np.int64)
        total = np.concatenate([np.zeros((2, 1), np.int64), per_block.cumsum(1)], axis=1)
        at = np.arange(self.blocks + 1)
        self.tree = total - total[:, at & (at - 1)]  # a node sums as many blocks as its lowest set bit tells
        self.units = int(total[0, -1])

    def _ends(self, a: int, b: int) -> np.ndarray:
        """Which bytes from a to b - 1 end a unit: visible ones before white space, and the text's last one."""
        seen = VISIBLE[self.raw[a : b + 1]]
        if b < len(self.raw):
            return seen[:-1] & ~seen[1:]
        return np.append(seen[:-1] & ~seen[1:], True)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first units units."""
        if units <= 0 or not self.blocks:
            return 0, 0
        at, rest, points = 0, units, 0
        for step in (1 << k for k in reversed(range(self.blocks.bit_length()))):
            if at + step <= self.blocks and self.tree[0, at + step] < rest:
                at += step
                rest -= int(self.tree[0, at])
                points += int(self.tree[1, at])
        a = at * self.block
        place = a + int(np.flatnonzero(self._ends(a, min(a + self.block, len(self.raw))))[rest - 1]) + 1
        return place, points + int(((self.raw[a:place] & 0xC0) != 0x80).sum())


@dataclass
class Infilled:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def infill(text: str | None, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, block: int = BLOCK) -> Infilled:
    """One text transformed. rate in a hundred of the texts are, spm_rate in a hundred of these with the suffix first."""
    text = text or ""
    encoded = text.encode("utf-8", "surrogatepass")
    tree = BlockTree(np.frombuffer(encoded, np.uint8), block)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return Infilled(tree.units, "plain", None, None, text)
    low, high = sorted(x % (tree.units + 1) for x in h[:2])
    (a, points_a), (b, points_b) = tree.cut(low), tree.cut(high)
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (encoded[:a], encoded[a:b], encoded[b:]))
    spm = h[3] % 100 < spm_rate
    output = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if spm else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return Infilled(tree.units, "spm" if spm else "psm", points_a, points_b - points_a, output)


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output of each row of docs; other columns are ignored.

    Null texts count as empty and are plain, as are texts that hold a mark. The cuts of a null doc_id are drawn from the seed alone. Repeated rows each give a row, and rows that
    share a doc_id share its draws. Empty docs give an empty result.
    """
    common.narrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [infill(t, i, seed, rate, spm_rate) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            longs = [pa.array([getattr(m, c) for m in made], pa.int64()) for c in ("n", "prefix_chars", "middle_chars")]
            texts = [pa.array([getattr(m, c) for m in made], pa.string()) for c in ("form", "output")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), longs[0], texts[0], longs[1], longs[2], texts[1]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark is found across the border of a text and a mark, as marks begin with < and hold no other."""
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    body = F.substr(output, F.length(first) + 1)
    at = lambda text, mark: F.call_function("instr", text, mark)
    left = F.substr(body, F.lit(1), at(body, second) - 1)
    rest = F.substr(body, at(body, second) + F.length(second))
    right = F.substr(rest, F.lit(1), at(rest, F.lit(MIDDLE)) - 1)
    middle = F.substr(rest, at(rest, F.lit(MIDDLE)) + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def digests(docs: DataFrame) -> DataFrame:
    """transform() with hashes of the output and of the text that restored() makes of it, in place of output."""
    made = transform(docs)
    return made.withColumn("output_sha256", F.sha2("output", 256)).withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256)).drop("output")
