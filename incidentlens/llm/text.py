"""Whole Arrow batches of texts as numpy arrays: words, hashes of words and of word sequences.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text. Hashes are polynomial over the bytes (one random number
for each byte value), taken modulo 2**64 with prefix sums, so that a slice of many documents costs a few
array operations and no Python loop. Batches are cut at document ends into slices of about ``SLICE_BYTES``;
a longer document is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the sequences [start, end) from the prefix sums."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


@dataclass
class Slice:
    """Documents ``lo`` to ``hi`` of a batch: their bytes and the offsets of each."""

    lo: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and the range of word numbers of each document."""

    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_doc)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (null: empty) into slices of whole documents."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Slice(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def spans(part: Slice, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of words and, for each document, its first word's number."""
    inside = ~white[part.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = part.offsets[:-1][part.offsets[:-1] < len(inside)]
    begins[at] = inside[at]
    at = part.offsets[1:][part.offsets[1:] > 0] - 1
    ends[at] = inside[at]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, part.offsets)


def words(part: Slice, fold: np.ndarray | None = None, white: np.ndarray = WHITE) -> Words:
    """Words of a slice with their hashes; ``fold`` maps bytes before hashing (``LOWER``: A-Z to a-z)."""
    start, end, first = spans(part, white)
    prefix = _prefix((_SYMBOL if fold is None else _SYMBOL[fold])[part.data])
    return Words(start, end, span_hashes(prefix, start, end), first)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` words from each word on, and whether all of them lie in one document."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(hashes))
    whole = at + n <= last
    end = np.minimum(at + n, len(hashes))
    return span_hashes(_prefix(hashes), at, end), whole


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text (null: 0)."""
    out = [np.diff(spans(part)[2]) for part in slices(column)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as the type that Spark has."""
    return x.view(np.int64)
