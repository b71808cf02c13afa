"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch are held as one ragged symbol array. In every round each sequence merges all
places of its lowest-rank pair at once; sequences without a mergeable pair are done, and what is left of each
is its number of tokens. Counts of pre-tokens are remembered within a task, in a table of bounded size.

Supported is the vocabulary kind with word ends (lower-cased, white space dropped, bytes as characters). Special
strings inside texts are one token each, found in the raw text, as the tokenizer's default is.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.frames import column, map_batches

REMEMBERED = 400_000  # pre-tokens whose counts a task keeps; beyond it the table starts anew
LONG = 64  # longer pre-tokens are not kept
PIECE = 4_000  # texts are counted in groups of about so many pre-tokens


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    return [out[b] if b in out else chr(256 + rest.index(b)) for b in range(256)]


class MergeTable:
    """Byte symbols and merges of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a large number: no merge) and the symbol that it makes."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.rank[at], np.iinfo(np.int64).max), self.made[at]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Number of tokens of each non-empty pre-token."""
        raw = [p.encode("utf-8") for p in pieces]
        length = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(length)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), length)
        left = np.zeros(len(raw), np.int64)
        while len(symbols) > 1:
            rank, made = self.lookup(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = np.iinfo(np.int64).max
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.r_[rank, np.iinfo(np.int64).max]
            lowest = np.minimum.reduceat(rank, heads)
            size = np.diff(np.r_[heads, len(symbols)])
            each = np.repeat(lowest, size)
            open_ = each < np.iinfo(np.int64).max
            hit = open_ & (rank == each)
            # Of a run of overlapping places, such as three equal symbols, every second one from the left merges.
            at = np.flatnonzero(hit)
            fresh = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0)) if len(at) else fresh
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols[at] = made[at] if len(at) else 0
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            done = lowest == np.iinfo(np.int64).max
            left[owner[heads[done]]] = size[done]
            keep &= open_
            symbols, owner = symbols[keep], owner[keep]
            if not len(symbols):
                return left
        np.add.at(left, owner, 1)
        return left


class Counter:
    """Counts the tokens of texts, remembering pre-tokens."""

    def __init__(self, table: MergeTable):
        self.table, self.known, self.long = table, {}, []

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and its number of special strings."""
        parts = self.table.special_pattern.split(text) if "<|" in text else [text]
        found = []
        for part in parts:
            # One code point is lower-cased at a time, so no sigma is a final one.
            folded = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            found += self.table.pattern.findall(folded)
        return found, len(parts) - 1

    def learn(self, pieces: set[str]) -> None:
        new = sorted(pieces.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = sorted(pieces)
        if new:
            self.known.update(zip(new, self.table.counts(new).tolist()))
        self.long = [p for p in new if len(p) > LONG]

    def texts(self, texts: list[str | None]) -> list[int]:
        out, group, held = [], [], 0
        for text in texts:
            group.append(self.pre_tokens(text or ""))
            held += len(group[-1][0])
            if held > PIECE:
                out += self.group(group)
                group, held = [], 0
        return out + self.group(group)

    def group(self, group: list[tuple[list[str], int]]) -> list[int]:
        self.learn({p for found, _ in group for p in found})
        get = self.known.__getitem__
        out = [sum(map(get, found)) + special for found, special in group]
        for piece in self.long:
            self.known.pop(piece, None)
        return out


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 max_tokens: int = 2048) -> DataFrame:
    """One row per document: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``max_tokens``).

    ``vocabulary`` is the path of a vocabulary file that every executor has. Nulls and empty texts: 0 bytes and
    0 tokens; a null id stays null; repeated rows are counted each; other columns are left out, whatever their
    names; an empty table gives an empty result.
    """
    kind = docs.select(column(id_col)).schema[0].dataType.simpleString()
    holder = {}

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        if "counter" not in holder:
            holder["counter"] = Counter(MergeTable(vocabulary))
        texts = rows.column(1)
        n = np.zeros(rows.num_rows, np.int64)
        for lo in range(0, rows.num_rows, 256):
            n[lo:lo + 256] = holder["counter"].texts(texts.slice(lo, 256).to_pylist())
        size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [rows.column(0), size, pa.array(n), pa.array(n > max_tokens)],
            names=["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    out = map_batches(source, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", batch)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "over_limit")
