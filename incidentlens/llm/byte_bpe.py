"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

The symbols of pre-tokens are a linked list. Every mergeable neighbour pair stands in the bucket of its merge rank, as the
position of its left symbol; a bitmap of several levels tells which buckets hold anything, so that the next rank is
found by one find-first-set for each level. A merge changes at most two neighbour pairs, which enter their new buckets;
what they left behind is stale and is skipped when it comes up. Work is proportional to the symbols, but for sorting
the positions of a bucket, however long a pre-token is.

The distinct pre-tokens of a group of texts share one list, with breaks between them that no pair crosses: what merges
in one does not depend on the others. Their ids are then laid out by ragged numpy arrays; short pre-tokens are
remembered within a task, in a table of bounded size.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.frames import column, fresh, map_arrow

REMEMBERED = 500_000  # pre-tokens whose ids a task keeps; beyond it the table starts anew
LONG = 64  # longer pre-tokens are not kept
GROUP_CHARS = 1 << 20  # texts are encoded in groups of about so many characters
OUT_IDS = 1 << 20  # rows are handed on when they hold so many ids


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank (which is the id) of every line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def split_pattern(pattern: str):
    """The pre-token pattern, with white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class RankQueue:
    """Positions in buckets by rank, and a bitmap of the ranks that have any."""

    BITS = 6

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels = []  # from the level whose bits are buckets up to a single word
        size = max(ranks, 1)
        while not self.levels or size > 1:
            size = (size + (1 << self.BITS) - 1) >> self.BITS
            self.levels.append([0] * size)

    def open(self, rank: int, positions: list[int]) -> None:
        """Begin the bucket of a rank that has none."""
        self.buckets[rank] = positions
        at = rank
        for words in self.levels:
            bit, at = 1 << (at & 63), at >> self.BITS
            seen = words[at]
            words[at] = seen | bit
            if seen:  # the levels above know this word already
                break

    def close(self, rank: int) -> None:
        """End the bucket of a rank."""
        del self.buckets[rank]
        at = rank
        for words in self.levels:
            bit, at = 1 << (at & 63), at >> self.BITS
            words[at] &= ~bit
            if words[at]:
                break

    def first(self) -> int | None:
        """The smallest rank that has a bucket."""
        if not self.levels[-1][0]:
            return None
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = at << self.BITS | (word & -word).bit_length() - 1
        return at


class Places(dict):
    """Numbers of pre-tokens; one that is not known gets the next number and is noted as new."""

    def __init__(self):
        self.count, self.new = 0, []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = self.count
        self.count += 1
        self.new.append(piece)
        return number


class ByteBPE:
    """Encodes and decodes with one vocabulary; a task makes one and keeps it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, split_pattern(pattern)
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, i in ranks.items():
            parts[i] = token
        self.known_id = np.zeros(size, bool)
        self.known_id[list(ranks.values())] = True
        self.length = np.array([len(p) for p in parts], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.of_pair = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.place = Places()  # of a pre-token in the ragged arrays below
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, one after another, and the number of each."""
        ranks, queue = self.ranks, RankQueue(len(self.length))
        text = b"\0" + b"\0".join(pieces) + b"\0"
        n = len(text)
        data = np.frombuffer(text, np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        at_break = np.r_[0, np.cumsum(size + 1)]
        breaks = np.zeros(n, bool)
        breaks[at_break] = True
        rank = self.of_pair[data[:-1].astype(np.int64) << 8 | data[1:]]
        rank[breaks[:-1] | breaks[1:]] = -1
        waits = [*rank.tolist(), -1]  # the rank under which the pair that begins at a position is queued
        order = np.argsort(rank, kind="stable")[np.count_nonzero(rank < 0):]
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        for some in np.split(order, cuts) if len(order) else []:
            queue.open(int(rank[some[0]]), some.tolist())
        symbol, breaks = self.of_byte[data], breaks.tobytes()
        symbol[at_break] = -1
        symbol = symbol.tolist()  # -1: a break, or merged into the symbol on the left
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets, get = queue.buckets, ranks.get
        bucket_of = buckets.get
        while (now := queue.first()) is not None:
            bucket = buckets[now]
            bucket.sort(reverse=True)  # of equal ranks the leftmost pair merges first
            least = now
            while bucket:
                i = bucket.pop()
                if waits[i] != now:
                    continue  # stale: one of the pair's symbols has changed since
                gone = after[i]
                end = after[gone]
                after[i], before[end], symbol[i], symbol[gone], waits[gone] = end, i, now, -1, -1
                new = -1 if breaks[end] else get(text[i:after[end]], -1)
                waits[i] = new
                if new >= 0:
                    if (other := bucket_of(new)) is None:
                        queue.open(new, [i])
                    else:
                        other.append(i)
                    if new < least:
                        least = new
                left = before[i]
                if not breaks[left]:
                    new = get(text[left:end], -1)
                    waits[left] = new
                    if new >= 0:
                        if (other := bucket_of(new)) is None:
                            queue.open(new, [left])
                        else:
                            other.append(left)
                        if new < least:
                            least = new
                if least < now:  # such a pair goes before what is left here
                    break
            if not bucket:
                queue.close(now)
        symbol = np.array(symbol, np.int32)
        left = symbol >= 0
        counts = np.add.reduceat(left, at_break[:-1], dtype=np.int64) if len(pieces) else size
        return symbol[left], counts

    def learn(self, pieces: list[str]) -> None:
        """Append the ids of the next pre-tokens to the ragged arrays."""
        raw = [p.encode("utf-8") for p in pieces]
        whole = [self.ranks.get(r) for r in raw]
        merged, size = self.merge([r for r, w in zip(raw, whole) if w is None])
        known = np.array([w is not None for w in whole])
        counts = np.ones(len(raw), np.int64)
        counts[~known] = size
        ids = np.empty(int(counts.sum()), np.int32)
        single = np.repeat(known, counts)
        ids[single] = [w for w in whole if w is not None]
        ids[~single] = merged
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids begin (and the last one's end)."""
        if len(self.place) > REMEMBERED or len(self.flat) > REMEMBERED * LONG:
            self.forget()
        split, place = [self.pattern.findall(t) for t in texts], self.place
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64)
        new, place.new = place.new, []
        if new:
            self.learn(new)
        size = self.start[at + 1] - self.start[at]
        ids = self.flat[_ragged(self.start[at], size)]
        tokens = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum([len(pieces) for pieces in split])]]
        for piece in new:
            if len(piece) > LONG:
                del place[piece]
        return ids, tokens

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids and the number of bytes of each; an id that the vocabulary lacks raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known_id) or not self.known_id[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.length[ids]
        return self.bytes[_ragged(self.begin[ids], size)], size


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges that begin at ``begin`` and have ``size`` places, one range after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _groups(texts: list[str]):
    lo, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held > GROUP_CHARS:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """One row per document: its id and ``ids``, the token ids of its whole text, without special tokens.

    ``ranks_path`` is a rank file that every executor has (lines of base64 bytes and rank; it holds all 256 single
    bytes), ``pattern`` splits texts into pre-tokens. Null and empty texts have no ids; a null id stays null; repeated
    rows are encoded each; other columns are left out, whatever their names; an empty table gives an empty result.
    Memory is that of one batch of texts and, for a very long pre-token, some 100 bytes for each of its bytes.
    """
    kind = docs.select(column(id_col)).schema[0].dataType.simpleString()
    holder = {}

    def run(batches):
        if "coder" not in holder:
            holder["coder"] = ByteBPE(load_ranks(ranks_path), pattern)
        for rows in batches:
            for lo in range(0, rows.num_rows, 256):
                part = rows.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for a, b in _groups(texts):
                    ids, ends = holder["coder"].encode(texts[a:b])
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), lists], names=["id", "ids"])

    source = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    out = map_arrow(source, run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col))


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the bytes that its ids stand for (null ids: null).

    Bytes, not text: ids that were cut somewhere need not give whole characters. An id that the vocabulary lacks, or a
    null among the ids, raises. A column that already has the new name keeps it and the new one gets a leading ``_``.
    """
    (name,) = fresh(encoded, bytes_col)
    at, names = encoded.columns.index(ids_col), [*encoded.columns, name]
    holder = {}

    def run(batches):
        if "coder" not in holder:
            holder["coder"] = ByteBPE(load_ranks(ranks_path), r"(?!)")
        for batch in batches:
            sizes = np.diff(batch.column(at).offsets.to_numpy())
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + 1, OUT_IDS), "right")
            cuts = np.unique(np.r_[0, cuts, len(sizes)])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                rows = batch.slice(lo, hi - lo)
                lists = rows.column(at)
                flat = lists.flatten()
                if flat.null_count:
                    raise ValueError("a null among the ids")
                size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
                data, each = holder["coder"].decode(flat.to_numpy())
                upto = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(size)]]
                values = pa.Array.from_buffers(
                    pa.large_binary(), len(size),
                    [pa.array(lists.is_valid()).buffers()[1] if lists.null_count else None,
                     pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*rows.columns, values.cast(pa.binary())], names=names)

    schema = encoded.withColumn(name, F.lit(None).cast("binary")).schema
    return map_arrow(encoded, run, schema)
