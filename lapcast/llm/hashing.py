"""Words of a batch of texts as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits separates words.
_MARKS = np.ones(256, dtype=bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """``hashes[i]`` is word i of the batch, ``text[i]`` its row; ``start`` and ``end`` are byte places in ``data``."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def of_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """For every row the first and one past the last word."""
        rows = np.arange(len(self.bounds) - 1)
        return np.searchsorted(self.text, rows, "left"), np.searchsorted(self.text, rows, "right")


def hashed(column: pa.Array, alphanumeric: bool = False) -> Words:
    """The words of a column of strings; nulls are empty.

    Words are runs of ``[^\\x20\\x09-\\x0D]``, or, if ``alphanumeric``, of characters other than ASCII marks and blanks;
    A-Z count as a-z. Equal words have equal hashes; words of up to eight bytes never share one with another of
    their length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    first, last = int(bounds[0]), int(bounds[-1])
    raw = column.buffers()[2]
    data = np.zeros(last - first + 8, dtype=np.uint8)
    if last > first:
        data[:-8] = _LOWER[np.frombuffer(raw, dtype=np.uint8, count=last - first, offset=first)]
    bounds = bounds - first
    size = last - first
    inside = ~(_MARKS if alphanumeric else _BLANK)[data[:size]]
    edge = np.zeros(size + 1, dtype=bool)
    edge[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(bounds, start, "right") - 1
    return Words(data, text, start, end, _hashes(data, start, end), bounds)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    lanes = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    length = end - start
    h = length.astype(np.uint64) * _A
    todo, at = np.arange(len(start)), start
    while len(todo):
        left = end[todo] - at
        keep = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        lane = lanes[at] & (~np.uint64(0) >> (np.uint64(64) - keep))
        h[todo] = mixed(h[todo] ^ lane)
        more = left > 8
        todo, at = todo[more], at[more] + 8
    return h


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence where it is shorter, none for no words."""
    width = min(width, len(words))
    if not width:
        return words
    h = np.full(len(words) - width + 1, width, dtype=np.uint64) * _A
    for k in range(width):
        h = mixed(h ^ words[k : len(words) - width + 1 + k])
    return h
