"""Quality rules with n-gram perplexity: a modified Kneser-Ney model, counted by Spark, and bands for each language.

Every text is seen in two ways, by a model of order 4 each: all its bytes as they are, so that every script, sign, digit and
case counts, and its outline, the bytes folded to 32 symbols (white space, a-z, digits, three classes of signs, non-ASCII),
which tells the shape of a text whatever its names and numbers. Both have distributions for each of ``SLOTS`` language
slots: the most frequent languages have their own, the rest share the last one. Texts are dealt into ``FOLDS`` folds by
their hash, and each is scored by what the other fold's texts of its slot gave, so no text explains itself. Keys are the
exact symbol sequences as numbers, held sorted beside their log-probabilities. The alphabet bounds the outline's model: at most
2 * 16 * 32**4 entries of 8 bytes (268 MB), whatever the corpus. That of bytes has an entry for each sequence of four bytes
that its slot's texts have. Bands of the mean log10 probability for each byte are set for each language and view, from all
documents of at least ``MIN_WORDS`` words: where enough of them are labelled, so that of all bands that reject at most
``GOOD_TAIL`` of the language's good ones, all tails of both views together, the band rejects the most bad ones (the outline's
band is set first); elsewhere around the median, at a multiple of the spread between quartiles.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import text as T
from incidentlens.llm.frames import column, fresh, map_arrow

ORDER, BITS, SLOTS, FOLDS = 4, 5, 16, 2
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
LOWER_SPREADS, UPPER_SPREADS = 20.0, 6.0  # of the quartile distance, below and above the median
GOOD_TAIL = 0.01  # of a language's labelled good documents that its band may reject
MIN_LABELLED = 100  # good documents of a language; with fewer its band is never tighter than that of the quartiles
STEP = 0.002  # width of the bins in which band limits are found
BINS = 4096


def _folding() -> np.ndarray:
    table = np.full(256, 30, np.uint8)
    table[T.WHITE] = 0
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[48:58] = 27
    for sign in b".,;:-'\"()":
        table[sign] = 28
    for sign in b"!?":
        table[sign] = 29
    table[128:] = 31
    return table


FOLD = _folding()
BYTES = np.arange(256, dtype=np.uint8)
BYTES[[0, 32]] = 32, 0  # a text starts as after a blank
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class View:
    """A way to see texts: the symbol of each byte, and the bits of a symbol."""

    symbols: np.ndarray
    bits: int


OUTLINE, WHOLE = View(FOLD, BITS), View(BYTES, 8)
VIEWS = (OUTLINE, WHOLE)
VIEW_AT = 40  # the bit from which a counted key tells its view


def packed_grams(part: T.Slice, order: int = ORDER, view: View = OUTLINE) -> np.ndarray:
    """The key of the ``order`` symbols that end at each byte, white space before a text's start."""
    symbol = view.symbols[part.data].astype(np.uint32 if view.bits * order <= 32 else np.uint64)
    key = symbol.copy()
    for back in range(1, order):
        key[back:] |= symbol[:-back] << symbol.dtype.type(view.bits * back)
    for place in range(order - 1):  # symbols of the text before
        at = part.offsets[:-1] + place
        key[at[at < part.offsets[1:]]] &= symbol.dtype.type((1 << view.bits * (place + 1)) - 1)
    return key


def gram_keys(part: T.Slice, order: int = ORDER, view: View = OUTLINE) -> tuple[np.ndarray, np.ndarray]:
    """The keys of ``packed_grams`` as signed numbers, and each byte's text."""
    return packed_grams(part, order, view).astype(np.int64), np.repeat(np.arange(part.docs), np.diff(part.offsets))


@dataclass
class KneserNey:
    """Interpolated modified Kneser-Ney: for each order sorted keys, log10 probabilities and back-off weights.

    A key is ``slot << bits * order | symbols``, of symbols of ``bits`` bits. The probability of a sequence that was not counted is that of its
    shorter end times the weight of its context.
    """

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    bits: int = BITS

    @classmethod
    def fit(cls, keys: np.ndarray, counts: np.ndarray, order: int = ORDER, bits: int = BITS) -> KneserNey:
        """From the counts of sequences of the full order; lower orders count the distinct symbols before them."""
        top = bits * order
        model = cls([], [], [], [], bits)
        levels = [(keys, counts.astype(np.float64))]
        for n in range(order - 1, 0, -1):
            above = levels[-1][0]
            slot, seq = above >> (bits * (n + 1)), above & ((1 << bits * n) - 1)
            k, c = np.unique(slot << (bits * n) | seq, return_counts=True)
            levels.append((k, c.astype(np.float64)))
        lower = None
        for n, (k, c) in zip(range(1, order + 1), reversed(levels)):
            sort = np.argsort(k)
            k, c = k[sort], c[sort]
            slot_of = k >> (bits * n)
            seen = [np.bincount(slot_of, weights=c == m, minlength=FOLDS * SLOTS) for m in (1, 2, 3, 4)]
            y = seen[0] / np.maximum(seen[0] + 2 * seen[1], 1)
            discount = np.stack([np.clip(np.nan_to_num(m - (m + 1) * y * seen[m] / np.maximum(seen[m - 1], 1)), 0.05, m - 0.05)
                                 for m in (1, 2, 3)], 1)
            level = np.minimum(c, 3).astype(int) - 1
            cut = np.minimum(discount[slot_of, level], c)
            context, at = np.unique(k >> bits, return_inverse=True)
            total, freed = np.bincount(at, weights=c), np.bincount(at, weights=cut)
            weight = np.maximum(freed / total, 1e-9)
            if lower is None:
                below = np.full(len(k), 1.0 / (1 << bits))
            else:
                below = 10.0 ** lower((slot_of << (bits * (n - 1))) | (k & ((1 << bits * (n - 1)) - 1)), n - 1)
            p = (c - cut) / total[at] + weight[at] * below
            model.keys.append(k)
            model.logs.append(np.log10(p).astype(np.float32))
            model.contexts.append(context)
            model.weights.append(np.log10(weight).astype(np.float32))
            lower = model.lookup
        assert top <= 32
        return model

    def lookup(self, keys: np.ndarray, n: int) -> np.ndarray:
        """log10 of the probability of the last symbol of each key of ``n`` symbols."""
        bits = self.bits
        if n == 0:
            return np.full(len(keys), -bits * np.log10(2.0))
        known, logs = self.keys[n - 1], self.logs[n - 1]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        out = np.empty(len(keys))
        out[hit] = logs[at[hit]]
        rest = keys[~hit]
        context = self.contexts[n - 1]
        place = np.minimum(np.searchsorted(context, rest >> bits), max(len(context) - 1, 0))
        found = context[place] == rest >> bits if len(context) else np.zeros(len(rest), bool)
        weight = np.where(found, self.weights[n - 1][place] if len(context) else 0.0, 0.0)
        shorter = (rest >> (bits * n)) << (bits * (n - 1)) | (rest & ((1 << bits * (n - 1)) - 1))
        out[~hit] = weight + self.lookup(shorter, n - 1)
        return out

    def slot_table(self, slot: int) -> np.ndarray:
        """The values of all sequences of a slot, for a task that scores many bytes."""
        top = self.bits * ORDER
        return self.lookup(np.arange(1 << top, dtype=np.int64) | slot << top, ORDER).astype(np.float32)

    def slot_hash(self, slot: int) -> SlotHash:
        """The counted sequences of a slot, for an alphabet whose sequences are too many for a table."""
        top = self.bits * ORDER
        known = self.keys[ORDER - 1]
        lo, hi = np.searchsorted(known, [slot << top, (slot + 1) << top])
        return SlotHash((known[lo:hi] & ((1 << top) - 1)).astype(np.uint32), self.logs[ORDER - 1][lo:hi])


class SlotHash:
    """Values by 32-bit keys: open addressing in arrays, probed for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, (2 * len(keys)).bit_length())
        owner = np.full(1 << self.bits, -1, np.int64)
        at, todo = self._start(keys), np.arange(len(keys))
        while len(todo):
            free = owner[at] < 0
            owner[at[free]] = todo[free]
            lost = owner[at] != todo
            at, todo = self._next(at[lost]), todo[lost]
        self.keys, self.values = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, np.nan, np.float32)
        held = np.flatnonzero(owner >= 0)
        self.keys[held], self.values[held] = keys[owner[held]], values[owner[held]]

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + np.uint32(1)) & np.uint32((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where it has none."""
        at = self._start(keys)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(out))
        at = at[todo]
        while len(todo):
            at = self._next(at)
            out[todo] = self.values[at]
            other = (self.keys[at] != keys[todo]) & ~np.isnan(out[todo])
            at, todo = at[other], todo[other]
        return out


class Scorer:
    """Mean log10 probabilities of texts by the model of each view; holds what it looks up for each language slot it has met."""

    def __init__(self, models: list[KneserNey], slots: dict):
        self.models, self.slots, self.tables, self.hashes = models, slots, {}, {}

    def mean_logs(self, texts: pa.Array, langs: list) -> np.ndarray:
        """For each view the means of a batch's texts, each by the other fold's texts."""
        out = np.zeros((len(VIEWS), len(texts)))
        for slot, rows, part in by_slot(texts, langs, self.slots):
            other = slot % SLOTS + SLOTS * (1 - slot // SLOTS)
            size = np.diff(part.offsets)
            doc = np.repeat(np.arange(part.docs), size)
            for i, (view, model, values) in enumerate(zip(VIEWS, self.models, (self._tabled, self._hashed))):
                value = values(model, other, packed_grams(part, ORDER, view))
                out[i, rows] = np.bincount(doc, weights=value, minlength=part.docs) / np.maximum(size, 1)
        return out

    def _tabled(self, model: KneserNey, slot: int, key: np.ndarray) -> np.ndarray:
        if slot not in self.tables:
            self.tables[slot] = model.slot_table(slot)
        return self.tables[slot][key]

    def _hashed(self, model: KneserNey, slot: int, key: np.ndarray) -> np.ndarray:
        if slot not in self.hashes:
            self.hashes[slot] = model.slot_hash(slot)
        value = self.hashes[slot].find(key)
        rest = np.flatnonzero(np.isnan(value))
        value[rest] = model.lookup(key[rest].astype(np.int64) | slot << (model.bits * ORDER), ORDER)
        return value


_last: list = [None, None]


def scorer_of(name: str, models, slots: dict) -> Scorer:
    """The scorer of broadcast models; a worker keeps that of the last ones for its next tasks."""
    if _last[0] != name:
        _last[:] = name, Scorer(models.value, slots)
    return _last[1]


def folds(part: T.Slice) -> np.ndarray:
    """The fold of each text; equal texts have the same."""
    ends = part.offsets.tolist()
    return np.array([zlib.crc32(part.data[a:b]) % FOLDS for a, b in zip(ends, ends[1:])], np.int64)


def by_slot(texts: pa.Array, langs: list, slots: dict):
    """``(slot, rows, part)``: the batch's texts in slices of one slot and fold each (see ``train_views``), and which rows they are."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    fold = [folds(part) for part in T.slices(texts)]
    if not fold:
        return
    slot = np.array([slot_of(x, slots) for x in langs], np.int64) + SLOTS * np.concatenate(fold)
    for s in np.unique(slot).tolist():
        rows = np.flatnonzero(slot == s)
        for part in T.slices(texts.take(pa.array(rows))):
            yield s, rows[part.lo:part.lo + part.docs], part


def slot_of(lang, slots: dict) -> int:
    return slots.get(lang, SLOTS - 1)


def language_slots(docs: DataFrame, lang_col: str) -> dict:
    """The most frequent languages (ties: the first by name) get the slots 0, 1, ...; a null is one of them."""
    counts = docs.groupBy(column(lang_col).cast("string").alias("lang")).count()
    top = counts.orderBy(F.desc("count"), F.asc_nulls_last("lang")).limit(SLOTS - 1).collect()
    return {row["lang"]: i for i, row in enumerate(top)}


class HeldCounts:
    """Counts of keys of any number, added up as sorted arrays whenever ``LIMIT`` entries have come."""

    LIMIT = 1 << 21

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, high: int = 0) -> None:
        """Count keys, to each of which the bits ``high`` are added."""
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys.astype(np.int64) | high, counts))
        self.size += len(self.parts[-1][0])
        if self.size > self.LIMIT:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *self.parts))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
        merged = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.parts, self.size = [merged], len(first)
        return merged

    def drain(self, least: int = 0):
        """The sums as a batch, if there are more than ``least``; what they were of is forgotten."""
        if self.size > least:
            keys, counts = self.merge()
            if len(keys) > least:
                self.parts, self.size = [], 0
                yield _counted(keys, counts)


def _counted(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])


def train_views(docs: DataFrame, slots: dict, text_col: str = "text", lang_col: str = "lang",
                views: tuple = VIEWS) -> list[KneserNey]:
    """Count all symbol sequences of all texts in Spark, in one pass for all views, and fit a model for each.

    A task adds up its texts in arrays before anything is shuffled: in a table where the alphabet is small, else in
    sorted keys, of which it holds some millions.
    """
    cells = 1 << BITS * ORDER

    def run(batches):
        outline: dict[int, np.ndarray] = {}
        others = HeldCounts()
        for rows in batches:
            for slot, _, part in by_slot(rows.column(0), rows.column(1).to_pylist(), slots):
                for i, view in enumerate(views):
                    key, high = packed_grams(part, ORDER, view), slot | i << (VIEW_AT - view.bits * ORDER)
                    if view.bits > BITS:
                        others.add(key, high << (view.bits * ORDER))
                    else:
                        outline.setdefault(high, np.zeros(cells, np.int64))
                        outline[high] += np.bincount(key, minlength=cells)
            yield from others.drain(2 * HeldCounts.LIMIT)
        for s, counts in outline.items():
            at = np.flatnonzero(counts)
            yield _counted(at | s << (BITS * ORDER), counts[at])
        yield from others.drain()

    source = docs.select(column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang"))
    counted = map_arrow(source, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    keys, counts = table.column("key").to_numpy(), table.column("n").to_numpy()
    of = keys >> VIEW_AT
    return [KneserNey.fit(keys[of == i] & ((1 << VIEW_AT) - 1), counts[of == i], ORDER, view.bits) for i, view in enumerate(views)]


def train(docs: DataFrame, slots: dict, text_col: str = "text", lang_col: str = "lang", view: View = OUTLINE) -> KneserNey:
    """The model of one view."""
    return train_views(docs, slots, text_col, lang_col, (view,))[0]


def labelled_band(good: np.ndarray, bad: np.ndarray, tail: float, widest: tuple, spare: int | None = None) -> tuple[int, int]:
    """The bins [first, end) that a language accepts, from the numbers of its labelled documents in each bin.

    Of the bands that reject at most ``tail`` (or else ``spare``) of the good documents, that which rejects the most bad ones
    (ties: the fewest good ones); it then grows up to the band ``widest`` as far as it takes in no bad document.
    """
    goods, bads = np.r_[0, np.cumsum(good)], np.r_[0, np.cumsum(bad)]
    spare = int(tail * goods[-1]) if spare is None else spare
    first = np.flatnonzero(goods <= spare)
    first = first[first < len(good)]
    end = np.maximum(np.searchsorted(goods, goods[-1] - spare + goods[first], "left"), first + 1)
    rejected = bads[first] + bads[-1] - bads[end]
    lost = goods[first] + goods[-1] - goods[end]
    best = np.lexsort((first, lost, -rejected))[0]
    lo, hi = int(first[best]), int(end[best])
    while lo > widest[0] and not bad[lo - 1]:
        lo -= 1
    while hi < widest[1] and not bad[hi]:
        hi += 1
    return lo, hi


def bands(docs: DataFrame, models, name: str, slots: dict, text_col: str = "text", lang_col: str = "lang",
          spreads: tuple = (LOWER_SPREADS, UPPER_SPREADS), min_words: int = MIN_WORDS, labels: DataFrame | None = None,
          id_col: str = "doc_id", good_tail: float = GOOD_TAIL) -> dict:
    """For each language and view the lowest and highest accepted mean log10 probability.

    All texts of at least ``min_words`` words are counted by slot and their bins of ``STEP`` in the views; bins and slots are
    bounded. With ``labels`` (``id_col, quality``: 1 good, 0 bad; of several labels of an id the lowest counts) the labelled
    ones are also counted apart. Only ids and bins meet the labels, never texts.
    """

    def run(batches):
        scorer = scorer_of(name, models, slots)
        for rows in batches:
            langs = rows.column(1).to_pylist()
            cell = np.array([slot_of(x, slots) for x in langs], np.int64)
            for mean in scorer.mean_logs(rows.column(0), langs):
                cell = cell * BINS + np.clip((-mean / STEP).astype(np.int64), 0, BINS - 1)
            batch = pa.RecordBatch.from_arrays([pa.array(cell), *rows.columns[2:]], names=names)
            yield batch.filter(pa.array(T.word_counts(rows.column(0)) >= min_words))

    source = [column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang")]
    if labels is None:
        names, schema = ["cell"], "cell bigint"
        placed = map_arrow(docs.select(*source), run, schema).withColumn("quality", F.lit(None).cast("int"))
    else:
        names, schema = ["cell", "id"], f"cell bigint, id {docs.select(column(id_col)).schema[0].dataType.simpleString()}"
        known = labels.where("quality in (0, 1)").groupBy(column(id_col).alias("id")).agg(F.min("quality").alias("quality"))
        placed = map_arrow(docs.select(*source, column(id_col).alias("id")), run, schema).join(known, "id", "left")
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"),
        F.count_if(F.col("quality") == 0).alias("bad")).toArrow()
    cell, n, good, bad = (cells.column(c).to_numpy() for c in ("cell", "n", "good", "bad"))
    slot, bins = cell // BINS ** 2, (cell // BINS % BINS, cell % BINS)
    out = {}
    for s in np.unique(slot).tolist():
        of, spare, out[s] = slot == s, int(good_tail * good[slot == s].sum()), []
        left = of.copy()  # the cells that the views before accept
        for at in bins:
            count = lambda x, rows: np.bincount(at[rows], x[rows], BINS).astype(np.int64)
            limits, accepted = band(count(n, of), count(good, left), count(bad, left), spare, good[of].sum() < MIN_LABELLED, spreads)
            out[s].append(limits)
            spare -= int(good[left & ~((at >= accepted[0]) & (at < accepted[1]))].sum())
            left &= (at >= accepted[0]) & (at < accepted[1])
    return out


def band(counts: np.ndarray, good: np.ndarray, bad: np.ndarray, spare: int, few: bool, spreads: tuple) -> tuple[tuple, tuple]:
    """The limits of the mean log10 probability, from a language's documents in each bin, and the bins within them.

    At most ``spare`` good ones are rejected; with ``few`` of them the limits are not tighter than those of the quartiles.
    """
    share = np.cumsum(counts) / counts.sum()
    low, mid, high = (-(int(np.searchsorted(share, q)) + 0.5) * STEP for q in (0.75, 0.5, 0.25))
    lower, upper = mid - spreads[0] * max(mid - low, 2 * STEP), mid + spreads[1] * max(high - mid, 2 * STEP)
    if not good.any():
        return (lower, upper), (0, BINS)
    widest = max(int(-upper / STEP), 0), min(int(-lower / STEP) + 1, BINS)
    first, end = labelled_band(good, bad, 0.0, widest, spare)
    # The last bin also holds what lies beyond it.
    limits = (-np.inf if end == BINS else -end * STEP, -first * STEP)
    return ((min(lower, limits[0]), max(upper, limits[1])) if few else limits), (first, end)


def base_measures(part: T.Slice) -> dict[str, np.ndarray]:
    """Numbers of words, their code points, signs, repeated lines and words in repeated 3-word windows."""
    w = T.words(part)
    n = part.docs
    heads = (part.data & 0xC0) != 0x80
    points = np.r_[0, np.cumsum(heads & ~T.WHITE[part.data])]
    signs = np.r_[0, np.cumsum(SYMBOLS[part.data])]
    out = {"n_words": w.per_doc, "word_chars": np.diff(points[part.offsets]), "n_symbols": np.diff(signs[part.offsets])}

    lines = part.data == 10
    line_start = np.union1d(part.offsets[:-1], np.flatnonzero(lines) + 1)
    line_start = line_start[line_start < len(part.data)]
    line_end = np.r_[line_start[1:], len(part.data)][:len(line_start)]
    line_end = line_end - lines[line_end - 1]
    line_end = np.maximum(line_end, line_start)
    doc = np.searchsorted(part.offsets, line_start, "right") - 1
    filled = np.r_[0, np.cumsum(~T.WHITE[part.data])]
    filled = filled[line_end] > filled[line_start]
    line_start, line_end, doc = line_start[filled], line_end[filled], doc[filled]
    key = T.span_hashes(T._prefix(T._SYMBOL[part.data]), line_start, line_end)
    out["n_dup_lines"] = np.bincount(doc[~first_of(doc, key)[0]], minlength=n)

    gram, whole = T.grams(w.hashes, w.first, 3)
    owner = w.doc
    at = np.flatnonzero(whole)
    _, repeated = first_of(owner[at], gram[at])
    covered = np.zeros(len(gram) + 3, bool)
    for back in range(3):
        covered[at[repeated] + back] = True
    out["n_repeat_words"] = np.bincount(owner[covered[:len(gram)]], minlength=n)
    return out


def first_of(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: is it the first of its key within its group; does its key occur there again."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (k[1:] != k[:-1])] if len(g) else np.zeros(0, bool)
    many = ~(new & np.r_[new[1:], True]) if len(g) else new
    first, repeated = np.zeros(len(g), bool), np.zeros(len(g), bool)
    first[order], repeated[order] = new, many
    return first, repeated


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", spreads: tuple = (LOWER_SPREADS, UPPER_SPREADS),
                  min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  measures: bool = True, labels: DataFrame | None = None, id_col: str = "doc_id",
                  good_tail: float = GOOD_TAIL) -> DataFrame:
    """All columns of ``docs`` and, with ``measures``, the five counts, ``base_failed``, ``mean_log10`` (of the outline),
    ``byte_log10`` (of all bytes) and ``kept``; without, the kept rows only.

    A document is kept if the base rules accept it (``min_words`` words, at most ``max_repeat_percent`` of them in
    3-word windows that occur again) and both mean log10 probabilities lie within its language's bands. ``labels``
    (``id_col, quality``) set the bands of the languages that have labelled documents (see ``bands``). Null and
    empty texts fail the base rules; a null language is a language; repeated rows are judged alike; a column
    that has one of the new names is kept under its name and the new one gets a leading ``_``; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    slots = language_slots(docs, lang_col)
    models = spark.sparkContext.broadcast(train_views(docs, slots, text_col, lang_col))
    name = uuid.uuid4().hex
    accepted = bands(docs, models, name, slots, text_col, lang_col, spreads, min_words, labels, id_col, good_tail)
    added = fresh(docs, *MEASURES, "base_failed", "mean_log10", "byte_log10", "kept")
    kinds = ["bigint"] * 5 + ["boolean", "double", "double", "boolean"]
    fields = [f"`{c.replace('`', '``')}` {t}" for c, t in zip(added, kinds)]
    names = list(docs.columns)
    text_at, lang_at = names.index(text_col), names.index(lang_col)
    any_mean = [(-np.inf, np.inf)] * len(VIEWS)

    def verdict(rows, scorer):
        langs = rows.column(lang_at).cast(pa.string()).to_pylist()
        measured = [base_measures(part) for part in T.slices(rows.column(text_at))]
        m = {c: np.concatenate([x[c] for x in measured]) for c in MEASURES}
        means = scorer.mean_logs(rows.column(text_at), langs)
        limits = np.array([accepted.get(slot_of(x, slots), any_mean) for x in langs])
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
        kept = ~failed & ((means.T >= limits[:, :, 0]) & (means.T <= limits[:, :, 1])).all(1)
        return [m[c] for c in MEASURES] + [failed, *means, kept]

    def run(batches):
        scorer = scorer_of(name, models, slots)
        for rows in batches:
            if not rows.num_rows:
                continue
            values = verdict(rows, scorer)
            if measures:
                types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
                new = [pa.array(v, t) for v, t in zip(values, types)]
                yield pa.RecordBatch.from_arrays(list(rows.columns) + new, names=names + added)
            else:
                out = rows.filter(pa.array(values[-1]))
                if out.num_rows:
                    yield out

    schema = docs.schema
    if measures:
        from pyspark.sql.types import StructType

        schema = StructType(list(schema) + list(StructType.fromDDL(", ".join(fields))))
    return map_arrow(docs, run, schema)
