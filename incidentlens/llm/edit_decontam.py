"""Benchmark decontamination: CGK embedding of item-sized windows, bit-sampling LSH, exact edit verification.

Texts and items are sequences of folded words (A-Z lower-cased; ASCII signs separate words). The CGK walk copies a
sequence into a longer one: at each step it writes the current word and moves on or not by a random bit of (step,
word), so that a small edit distance becomes a small Hamming distance. Windows and items meet if they agree in
all sampled positions of one of the repetitions; every meeting is then verified by the exact edit distance.

Not every window is embedded. By the pigeonhole principle a passage within ``t`` edits of an item of ``n`` words holds
at least one of its ``t + 1`` pieces unchanged, of ``SEED`` words if ``t`` is small enough (for 5 words no edit is
allowed), so only windows around shared sequences of ``SEED`` words can pass.

Walks fall out of step in long sequences. So items of more than ``PIECE_WORDS`` words are embedded in equal pieces: at
least one piece of an item within its edits has no larger share of edits than the whole. A window that meets a piece
leads to the exact check of the whole item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import text as T
from incidentlens.llm.frames import column, fresh, map_arrow
from incidentlens.plans.materialize import materialize

MAX_EDITS = 0.2  # of an item's words
SEED = 3
MIN_ITEM_WORDS = 5
WALKS, REPEATS, SAMPLED = 8, 16, 3
PIECE_WORDS = 40  # most words that are embedded at once
BLOCK_BYTES = 4 << 20  # of item texts that are held in memory at once; more items take further passes

SEPARATE = T.WHITE.copy()
SEPARATE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
PAD = np.uint64(0)


def walk_bits(step: int, walk: int, words: np.ndarray) -> np.ndarray:
    """The random bit of (walk, step, word)."""
    salt = T.mix(np.array([walk << 32 | step + 1], np.uint64))[0]
    return (T.mix(words ^ salt) >> np.uint64(40)) & np.uint64(1)


def embed(sequence: np.ndarray, start: np.ndarray, length: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """CGK walks over the windows [start, start + length): one row of ``steps`` words for each; ended walks give PAD."""
    out = np.empty((len(start), steps), np.uint64)
    at, end = start.astype(np.int64).copy(), start + length
    last = len(sequence) - 1
    for step in range(steps):
        word = np.where(at < end, sequence[np.minimum(at, last)], PAD)
        out[:, step] = word
        at += walk_bits(step, walk, word).astype(np.int64)
    return out


def samples(length: int, walk: int) -> np.ndarray:
    """The sampled steps of each repetition for items of a length: from its first 1.5 * length steps, which walks
    rarely end before."""
    steps = max(SAMPLED, int(1.5 * length))
    pick = np.random.default_rng([length, walk, 77])
    return np.stack([pick.choice(steps, SAMPLED, replace=False) for _ in range(REPEATS)])


def sample_keys(rows: np.ndarray, kind: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One hash for each row and repetition of what the row has at the steps ``at[kind]`` of its length."""
    key = np.repeat(length.astype(np.uint64)[:, None], REPEATS, axis=1)
    own = np.arange(len(rows))[:, None]
    for i in range(SAMPLED):
        key = T.mix(key ^ rows[own, at[kind][:, :, i]]) + np.uint64(i)
    return T.mix(key + np.arange(REPEATS, dtype=np.uint64)[None, :])


def allowed_edits(length: np.ndarray) -> np.ndarray:
    """``MAX_EDITS`` of the words, as far as the words that are left, in one piece more than edits, have a seed in them."""
    return np.minimum((MAX_EDITS * length).astype(np.int64), (length - SEED) // SEED)


@dataclass
class Items:
    """Items of a block: their words, and the seeds and bit-sampling tables of their pieces."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self):
        pieces, owner, offset = [], [], []
        for i, w in enumerate(self.words):
            cuts = np.linspace(0, len(w), -(-len(w) // PIECE_WORDS) + 1).astype(int).tolist()
            pieces += [w[a:b] for a, b in zip(cuts, cuts[1:])]
            owner += [i] * (len(cuts) - 1)
            offset += cuts[:-1]
        self.piece_item, self.piece_offset = np.array(owner, np.int64), np.array(offset, np.int64)
        seeds, piece, place = [], [], []
        for i, w in enumerate(pieces):
            g, ok = T.grams(w, np.array([0, len(w)]), SEED)
            seeds.append(g[ok])
            piece += [i] * int(ok.sum())
            place += np.flatnonzero(ok).tolist()
        seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.seed_piece, self.seed_place = seeds[order], np.array(piece, np.int64)[order], np.array(place, np.int64)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.seeds & np.uint64(len(self.sieve) - 1)] = True
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.edits = allowed_edits(self.lengths)
        self.piece_lengths = np.array([len(w) for w in pieces], np.int64)
        self.kinds = np.unique(self.piece_lengths)
        self.sampled = [np.stack([samples(n, walk) for n in self.kinds.tolist()]) if len(self.kinds) else
                        np.zeros((0, REPEATS, SAMPLED), np.int64) for walk in range(WALKS)]
        flat = np.concatenate([*self.words, np.zeros(1, np.uint64)])
        begin = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.tables = []
        for walk in range(WALKS):
            keys = self.keys(flat, begin, self.piece_lengths, self.piece_lengths, walk)
            owner = np.repeat(np.arange(len(pieces)), REPEATS)
            sort = np.argsort(keys, kind="stable")
            self.tables.append((keys[sort], owner[sort]))

    def keys(self, sequence: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray, walk: int) -> np.ndarray:
        """The sampled keys of windows that are compared with pieces of ``length``, ``REPEATS`` for each."""
        if not len(start):
            return np.zeros(0, np.uint64)
        at = self.sampled[walk]
        rows = embed(sequence, start, size, walk, int(at.max()) + 1)
        return sample_keys(rows, np.searchsorted(self.kinds, length), at, length).ravel()

    def windows(self, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that a shared seed lines up with a piece."""
        gram, ok = T.grams(w.hashes, w.first, SEED)
        at = np.flatnonzero(ok & self.sieve[gram & np.uint64(len(self.sieve) - 1)])
        lo = np.searchsorted(self.seeds, gram[at], "left")
        n = np.searchsorted(self.seeds, gram[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        piece = self.seed_piece[hit]
        doc_first = np.repeat(w.first[:-1], w.per_doc)
        start = np.maximum(np.repeat(at, n) - self.seed_place[hit], doc_first[np.repeat(at, n)])
        pair = np.unique(np.stack([start, self.piece_lengths[piece]], 1), axis=0)
        return pair[:, 0], pair[:, 1]

    def meetings(self, w: T.Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pairs (start, piece) that agree in one repetition."""
        out = [np.zeros((0, 2), np.int64)]
        size = np.minimum(length, np.repeat(w.first[1:], w.per_doc)[start] - start)
        for walk, (keys, owner) in enumerate(self.tables):
            mine = self.keys(w.hashes, start, size, length, walk)
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            row = np.flatnonzero(hi > lo)
            lo, k = lo[row], (hi - lo)[row]
            where = np.repeat(lo, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            out.append(np.stack([start[np.repeat(row // REPEATS, k)], owner[where]], 1))
        return np.unique(np.concatenate(out), axis=0)


def nearest_passage(text: np.ndarray, item: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The passage of ``text`` with the smallest edit distance to ``item`` (ties: the first to end), as distance, start
    and end; None if the distance is over ``most``. Insertions, deletions and replacements of words count 1."""
    n = len(text)
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for word in item:
        best = row + 1  # the item's word is left out
        source = origin
        through = row[:-1] + (text != word)
        better = through <= best[1:]
        best[1:][better] = through[better]
        source = origin.copy()
        source[1:][better] = origin[:-1][better]
        # Words of the text that the item lacks: a running minimum along the row.
        level = best - steps
        low = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == low, steps, 0))
        at = np.where(level == low, steps, at)
        row, origin = low + steps, source[at]
    end = int(np.argmin(row))
    return (int(row[end]), int(origin[end]), end) if row[end] <= most else None


def find_in(items: Items, w: T.Words):
    """For a slice: (document, item, first word, end word, edits) of the best passage for each document and item."""
    start, length = items.windows(w)
    pairs = items.meetings(w, start, length)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    doc = np.searchsorted(w.first, pairs[:, 0], "right") - 1
    # Where the item begins if its piece does where it was met; it can lie before the document's first word.
    pairs = np.stack([pairs[:, 0] - items.piece_offset[pairs[:, 1]], items.piece_item[pairs[:, 1]]], 1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0], doc))
    doc, pairs = doc[order], pairs[order]
    seen_to: dict[tuple[int, int], int] = {}
    for d, (s, i) in zip(doc.tolist(), pairs.tolist()):
        most = int(items.edits[i])
        if (d, i) in seen_to and seen_to[d, i] >= s:
            continue  # lies in a region that was verified for this item
        lo, hi = max(s - 2 * most, int(w.first[d])), min(s + int(items.lengths[i]) + 4 * most + 1, int(w.first[d + 1]))
        seen_to[d, i] = s + 2 * most
        hit = nearest_passage(w.hashes[lo:hi], items.words[i], most)
        if hit is not None:
            edits, a, b = hit
            new = (edits, lo + a - int(w.first[d]), lo + b - int(w.first[d]))
            if (d, i) not in found or new < found[d, i]:
                found[d, i] = new
    return [(d, items.ids[i], a, b, e) for (d, i), (e, a, b) in sorted(found.items())]


def fold_items(rows: list) -> Items:
    ids, words = [], []
    texts = pa.array([r[1] for r in rows], pa.string())
    for part in T.slices(texts):
        w = T.words(part, T.LOWER, SEPARATE)
        for k in range(part.docs):
            own = w.hashes[w.first[k]:w.first[k + 1]]
            if len(own) >= MIN_ITEM_WORDS:
                ids.append(rows[part.lo + k][0])
                words.append(own)
    return Items(ids, words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, first_word, end_word, edits``: the best passage of each document for each item it contains.

    A document contains an item if one of its passages is within ``MAX_EDITS`` of the item's number of folded words
    (an item of 5 words: equal to it).
    Items of fewer than ``MIN_ITEM_WORDS`` words, and null or empty texts and items, match nothing. Rows with
    equal ids are each searched; equal rows give equal result rows. Other columns do not matter. Empty tables
    give an empty result. The items are the stated query set: blocks of at most ``block_bytes`` of them (or one
    item) are sent to the tasks, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    kinds = [docs.select(column(id_col)).schema[0].dataType.simpleString(),
             benchmark.select(column(item_col)).schema[0].dataType.simpleString()]
    schema = f"id {kinds[0]}, item {kinds[1]}, first_word bigint, end_word bigint, edits bigint"
    items = benchmark.select(column(item_col).alias("item"), column(item_text_col).cast("string").alias("text")).where("text is not null")
    bytes_ = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * bytes_ // block_bytes)) if bytes_ > block_bytes else 1
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    source = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    out = None
    for block in range(blocks):
        held = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).orderBy("item", "text").collect()]
        shared = spark.sparkContext.broadcast(held)
        found = map_arrow(source, searcher(shared), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "first_word", "end_word", "edits")


def searcher(shared):
    def run(batches):
        items = fold_items(shared.value)
        for rows in batches:
            found = []
            for part in T.slices(rows.column(1)):
                if items.ids and len(part.data):
                    w = T.words(part, T.LOWER, SEPARATE)
                    found += [(part.lo + d, *rest) for d, *rest in find_in(items, w)]
            if found:
                at, item, a, b, e = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pc.take(rows.column(0), pa.array(at)), pa.array(item), pa.array(a, pa.int64()),
                     pa.array(b, pa.int64()), pa.array(e, pa.int64())],
                    names=["id", "item", "first_word", "end_word", "edits"])

    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item; a document with a null id is kept."""
    (key,) = fresh(docs, "leaked")
    found = find_leaks(docs, benchmark, id_col, **options).select(column(id_col).alias(key)).distinct()
    leaked = materialize(found)  # its size is then known to the join
    return docs.join(leaked, column(id_col) == F.col(key), "left_anti")
