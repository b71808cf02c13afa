"""Periodic runs of words by online dyadic square catching.

Words are appended one after another. For every power of two L, each completed block of L words gets a catcher. While
the last L appended words begin between 2L - 1 and 4L - 2 words after the block, the catcher compares them with its
block; at any time two catchers of each size are on duty, so an appended word costs two comparisons for each size. The
distances of all sizes together are all periods, each once, and the first half of a square holds a whole block of its
period's size, so every square is caught. A hit at distance p is a stretch of words that equal the words p further on;
hits of neighbouring blocks merge, both ends are extended by suffix comparisons of halving sizes, and a stretch of at
least p words is a run. A run that is also caught at multiples of its period has the same ends there: the smallest stays.

Words are compared in groups: sequences of 2, 4, 8 ... words have 64-bit names made from the names of their halves, for all
places of an appended piece at once. The runs are then checked on the words themselves; if two sequences should ever
share a name, the text is done again with other names.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import blake2b
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.frames import column, map_arrow
from incidentlens.llm.text import mix

PIECE = 1 << 16  # words appended at once; documents are held together up to so many words
MIN_WORDS = 12


class Catchers:
    """The squares of one sequence of words, found while words are appended."""

    def __init__(self, size: int, longest_period: int, least: int = MIN_WORDS, seed: int = 0):
        self.size, self.n, self.least = size, 0, least  # places in all, words so far
        salt = np.frombuffer(blake2b(str(seed).encode(), digest_size=16).digest(), np.uint64) | np.uint64(1)
        self.salt, self.factor = salt[0], salt[1]
        self.words = np.empty(size, np.int64)
        self.names, self.done, self.hits = [], [], []
        while 2 * (1 << len(self.names)) - 1 <= longest_period:  # the shortest period of the next block size
            self.names.append(np.empty(max(0, size - (1 << len(self.names)) + 1), np.uint64))
            self.done.append(0)
            self.hits.append([])

    def append(self, words: np.ndarray) -> None:
        """Append words; each size names the sequences that they complete and lets its catchers compare them."""
        self.words[self.n:self.n + len(words)] = words
        self.n += len(words)
        for k, names in enumerate(self.names):
            block, lo, hi = 1 << k, self.done[k], self.n - (1 << k) + 1  # sequences that begin in [lo, hi) are new
            if hi <= lo:
                break
            if k == 0:
                names[lo:hi] = mix(self.words[lo:hi].view(np.uint64) * self.factor + self.salt)
            else:
                half, step = self.names[k - 1], block >> 1
                names[lo:hi] = mix(half[lo:hi] * self.factor + half[lo + step:hi + step])
            self.done[k] = hi
            first = max(lo, 2 * block - 1)
            if first < hi:
                at = np.arange(first, hi)
                near = (at - (2 * block - 1)) & -block  # the two blocks that are on duty
                for begin in (near, near - block):
                    hit = np.flatnonzero((names[np.maximum(begin, 0)] == names[at]) & (begin >= 0))
                    if len(hit):
                        self.hits[k].append((at[hit] - begin[hit], begin[hit]))

    def _grown(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of size ``k``: period, first word and the word after the last that equals the one a period on."""
        block = 1 << k
        period = np.concatenate([p for p, _ in self.hits[k]])
        begin = np.concatenate([b for _, b in self.hits[k]])
        order = np.lexsort((begin, period))
        period, begin = period[order], begin[order]
        heads = np.flatnonzero(np.r_[True, (np.diff(period) != 0) | (np.diff(begin) != block)])
        blocks = np.diff(np.r_[heads, len(begin)])
        # Each end can still grow by less than a block, as the next block differs.
        keep = blocks * block + 2 * (block - 1) >= np.maximum(period[heads], self.least - period[heads])
        period, begin, end = period[heads][keep], begin[heads][keep], (begin[heads] + blocks * block)[keep]
        for j in range(k - 1, -1, -1):
            names, step = self.names[j], 1 << j
            last = self.n - step
            same = (end + period <= last) & (names[np.minimum(end, last)] == names[np.minimum(end + period, last)])
            end = end + same * step
            left = np.maximum(begin - step, 0)
            same = (begin >= step) & (names[left] == names[left + period])
            begin = begin - same * step
        return period, begin, end

    def runs(self) -> np.ndarray | None:
        """Rows of start, end and smallest period, by start and period; None if names were shared."""
        found = [self._grown(k) for k, hits in enumerate(self.hits) if hits]
        if not found:
            return np.zeros((0, 3), np.int64)
        period, begin, end = (np.concatenate(x) for x in zip(*found))
        keep = end - begin >= np.maximum(period, self.least - period)
        period, begin, end = period[keep], begin[keep], end[keep] + period[keep]
        order = np.lexsort((period, end, begin))
        period, begin, end = period[order], begin[order], end[order]
        first = np.r_[True, (np.diff(begin) != 0) | (np.diff(end) != 0)][:len(begin)]
        period, begin, end = period[first], begin[first], end[first]
        w = self.words
        for p, b, e in zip(period.tolist(), begin.tolist(), end.tolist()):
            if not np.array_equal(w[b:e - p], w[b + p:e]) or (b and w[b - 1] == w[b - 1 + p]) or (e < self.n and w[e] == w[e - p]):
                return None
        order = np.lexsort((period, begin))
        return np.stack([begin[order], end[order], period[order]], 1)


def find(words: np.ndarray, longest: int, least: int = MIN_WORDS) -> np.ndarray:
    """All runs of at least ``least`` words with periods up to ``longest``: rows of start, end, period."""
    for seed in count():
        catchers = Catchers(len(words), longest, least, seed)
        for lo in range(0, len(words), PIECE):
            catchers.append(words[lo:lo + PIECE])
        out = catchers.runs()
        if out is not None:
            return out


def _groups(texts: list[bytes]):
    """Split texts, some at a time: up to ``PIECE`` words, or one longer text."""
    group, held = [], 0
    for text in texts:
        words = text.split()  # of bytes: at blanks and at \\x09 to \\x0D
        if group and held + len(words) > PIECE:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def document_runs(group: list[list[bytes]], least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several texts, by text, start and period, as rows of text, start, length, period, and the words that go.

    The texts stand one after another with a word of its own after each, which no run can hold.
    """
    number = defaultdict(count().__next__)
    size = np.array([len(words) + 1 for words in group], np.int64)
    ends = np.cumsum(size)
    ids = np.empty(int(ends[-1]), np.int64)
    for k, (words, end) in enumerate(zip(group, ends.tolist())):
        ids[end - 1 - len(words):end - 1] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids[end - 1] = -1 - k
    runs = find(ids, int(size.max() - 1) // 2, least)
    owner = np.searchsorted(ends, runs[:, 0], "right")
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    rows = np.stack([owner, runs[:, 0] - (ends - size)[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    return rows, np.cumsum(change)[:-1] > 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """One row per document: its id, ``n_words``, ``runs`` and ``kept_text``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` are all stretches with smallest period q and at least
    ``max(least, 2 * q)`` words that can't be extended with that period, as (start, length, period) by start and period.
    ``kept_text`` holds the words, joined by one blank, that no run contains after its first q words. Null and empty texts
    have no words, no runs and an empty kept text; a null id stays null; repeated rows are judged each; other columns
    are left out, whatever their names; an empty table gives an empty result. Memory is that of one batch of texts and
    8 * log2(n) bytes for each of the n words of the longest text.
    """
    kind = docs.select(column(id_col)).schema[0].dataType.simpleString()
    fields = ["start", "length", "period"]

    def run(batches):
        for rows in batches:
            lo = 0
            texts = (t or b"" for t in (x.as_py() for x in rows.column(1)))
            for group in _groups(texts):
                found, gone = document_runs(group, least)
                at, kept = 0, []
                for words in group:
                    mine = gone[at:at + len(words)]
                    kept.append(b" ".join(compress(words, (~mine).tolist()) if mine.any() else words))
                    at += len(words) + 1
                values = pa.StructArray.from_arrays([pa.array(found[:, i + 1]) for i in range(3)], names=fields)
                offsets = np.searchsorted(found[:, 0], np.arange(len(group) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(lo, len(group)), pa.array([len(w) for w in group], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["id", "n_words", "runs", "kept_text"])
                lo += len(group)

    source = docs.select(column(id_col).alias("id"), column(text_col).cast("string").cast("binary").alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
    out = map_arrow(source, run, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "kept_text")
