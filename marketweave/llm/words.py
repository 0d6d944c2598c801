"""Encoding texts word by word: each different word of a batch is encoded once, and the ids are gathered per text by numpy.

A blank between two visible characters always starts a new piece of a byte-level pattern, so texts may be cut there. Everything between two
such blanks, together with the blank before it, is called a word here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that one of the pattern engines takes for white space; no cut next to them.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
CUT = re.compile(f"(?<=[^{BLANKS}]) (?=[^{BLANKS}])")
#: For Arrow: a blank beside white space or at an end; any white space.
HARD, INNER = f"^ | $| [{BLANKS}]|[{BLANKS}] ", f"[{BLANKS}]"

#: From words of visible characters, all behind one blank (which they hold), to their ids, one after another, and the number of ids of each; and the same for any texts.
Many = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
Single = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


#: Words whose ids a Python worker remembers, the first that it meets: some 40 bytes each.
KNOWN_WORDS = 600_000


def gather(flat: np.ndarray, counts: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists laid end to end in flat, those numbered take, end to end, and their lengths."""
    starts, n = (np.cumsum(counts) - counts)[take], counts[take]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat((starts - (ends - n)).astype(kind), n)
    place += np.arange(total, dtype=kind)
    return flat[place], n


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class Known:
    """Words that a worker has met and their ids, one after another, in flat arrays."""

    def __init__(self):
        self.words, self.ids, self.counts = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encoded(self, some: pa.Array, new: Many) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words; those not met before are encoded by new, and remembered while there is room."""
        place = np.array(pc.fill_null(pc.index_in(some, self.words), -1), np.int64)
        missing = place < 0
        fresh = some.filter(pa.array(missing))
        ids, counts = new(fresh)
        place[missing] = len(self.words) + np.arange(len(counts))
        found = gather(np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.counts, counts]), place)
        n = min(len(fresh), KNOWN_WORDS - len(self.words))
        if n > 0:
            self.words = pa.concat_arrays([self.words, fresh[:n]])
            self.ids, self.counts = np.concatenate([self.ids, ids[: counts[:n].sum()].astype(np.uint32)]), np.concatenate([self.counts, counts[:n]])
        return found


def _encoded(lists: pa.ListArray, many: Many, single: Single) -> tuple[np.ndarray, np.ndarray]:
    flat = lists.flatten().dictionary_encode()
    inner = pc.match_substring_regex(flat.dictionary, INNER).to_numpy(zero_copy_only=False)
    n = len(flat.dictionary)
    sizes = pc.list_value_length(lists).to_numpy()
    code = flat.indices.to_numpy().astype(np.int64) * 2 + 1
    code[np.cumsum(sizes) - sizes] -= 1  # the first word of a text has no blank before it
    used = np.flatnonzero(np.bincount(code, minlength=2))
    number = np.zeros(2 * n + 2, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    odd = (used % 2 == 0) | inner[used >> 1] if n else np.zeros(0, bool)
    few = zip(flat.dictionary.take(pa.array(used[odd] >> 1)).to_pylist(), used[odd].tolist())
    apart = single([" " + w if c & 1 else w for w, c in few])
    blank = pa.scalar(" ", pa.large_string())
    parts = [many(pc.binary_join_element_wise(blank, flat.dictionary.take(pa.array(used[~odd] >> 1)), pa.scalar("", pa.large_string()))), apart]
    ids, counts = (np.concatenate([parts[0][k], parts[1][k]]) for k in (0, 1))
    place = np.zeros(len(used), np.int64)
    place[~odd], place[odd] = np.arange(len(used) - odd.sum()), np.arange(odd.sum()) + (len(used) - odd.sum())
    out, n = gather(ids, counts, place[number[code]])
    return out, sums(n, sizes)


def by_word(texts: pa.Array, many: Many, single: Single) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the number of ids of each. many gets different words of visible characters behind one blank, single the others."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    hard = pc.match_substring_regex(texts, HARD).to_numpy(zero_copy_only=False)
    if not hard.any():
        return _encoded(pc.split_pattern(texts, " "), many, single)
    plain = pc.split_pattern(texts.filter(pa.array(~hard)), " ")
    cut = pa.array([CUT.split(t) for t in texts.filter(pa.array(hard)).to_pylist()], pa.large_list(pa.large_string()) if pa.types.is_large_list(plain.type) else plain.type)
    parts = [_encoded(x, many, single) for x in (plain, cut)]
    ids, counts = (np.concatenate([parts[0][k], parts[1][k]]) for k in (0, 1))
    place = np.zeros(len(texts), np.int64)
    place[~hard], place[hard] = np.arange((~hard).sum()), np.arange(hard.sum()) + (~hard).sum()
    return gather(ids, counts, place)
