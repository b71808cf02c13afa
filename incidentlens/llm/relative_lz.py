"""Duplicate passages by relative Lempel-Ziv parsing against every earlier document.

The reference of a document is all documents with smaller ids. It is indexed by content-defined blocks: anchors are the
sequences of ``GRAM`` words with the smallest hash in some window of ``WINDOW`` words, and a block runs from an
anchor to the end of the first anchor that makes it ``WINDOW`` words long. The index holds a block's fingerprint, the
smallest document that has it and its place there. A document is parsed greedily from left to right into factors (first
word, end, source document, place in the source): from the first indexed block that reaches beyond what is parsed, a factor
goes on through every block that touches it and stands at the same distance in the same source. Factors have ``WINDOW``
words at least, since blocks have.

Passages begin and end inside blocks, so the boundaries of factors are checked word by word: every window that no
factor covers, but whose smallest sequence another document has, is looked up by its own fingerprint. Equal windows have
equal smallest sequences, and the first document that has a window has it outside its factors, so no window is
missed. Fingerprints have 64 bits. Only smallest ids are gathered for each fingerprint, so a passage that all
documents share costs a row for each, and no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from incidentlens.llm import text as T
from incidentlens.llm.frames import column, fresh, map_arrow
from incidentlens.plans.materialize import materialize

WINDOW, GRAM = 50, 10
LAST_ID = (1 << 63) - 1
EMPTY = np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest or largest of each ``width`` values, by doubling."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:]) if step < len(out) else out[:0]
        done += step
    return out


class Parse:
    """Words, windows, anchors and blocks of a slice."""

    def __init__(self, part: T.Slice, window: int = WINDOW):
        self.part, self.window = part, window
        gram = min(GRAM, window)
        self.w = T.words(part)
        self.n = len(self.w.hashes)
        self.last = np.repeat(self.w.first[1:], self.w.per_doc)
        at = np.arange(self.n)
        self.prefix = T._prefix(self.w.hashes)
        self.grams = T.span_hashes(self.prefix, at, np.minimum(at + gram, self.n))
        self.gram = gram
        width = window - gram + 1
        full = np.maximum(self.n - window + 1, 0)
        self.begins = np.flatnonzero(at[:full] + window <= self.last[:full])
        smallest = sliding(self.grams[:self.n - gram + 1], width, np.minimum) if full else EMPTY
        self.smallest = smallest[self.begins]
        # An anchor is the smallest of a window: the largest of its windows' smallest is its own hash.
        spread = np.zeros(self.n + width - 1, np.uint64)
        spread[self.begins + width - 1] = self.smallest
        top = sliding(spread, width, np.maximum) if self.n else EMPTY
        self.anchors = np.flatnonzero((top[:self.n] == self.grams) & (top[:self.n] > 0)) if full else np.zeros(0, np.int64)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the block of each anchor, and its fingerprint; an anchor without a block ends where it begins."""
        a = self.anchors
        to = np.searchsorted(a, a + self.window - self.gram)
        to = np.minimum(to, max(len(a) - 1, 0))
        end = a[to] + self.gram if len(a) else a
        end = np.where((end - a >= self.window) & (end <= self.last[a]), end, a) if len(a) else a
        return a, end, T.span_hashes(self.prefix, a, end)

    def window_hashes(self, begins: np.ndarray) -> np.ndarray:
        return T.span_hashes(self.prefix, begins, begins + self.window)

    def per_doc(self, places: np.ndarray) -> np.ndarray:
        """Where the sorted word numbers of each document begin among ``places``."""
        return np.searchsorted(places, self.w.first)


def held(lists, i: int) -> np.ndarray:
    """A row's list of fingerprints (null: none), sorted."""
    row = lists[i]
    return np.sort(row.values.to_numpy(zero_copy_only=False).view(np.uint64)) if row.is_valid else EMPTY


def indexed(lists, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row's indexed blocks (null: none): sorted fingerprints, source documents, places there."""
    row = lists[i]
    if not row.is_valid:
        return EMPTY, np.zeros(0, np.int64), np.zeros(0, np.int64)
    block, source, place = (x.to_numpy(zero_copy_only=False) for x in row.values.flatten())
    block = block.view(np.uint64)
    order = np.argsort(block)
    return block[order], source[order], place[order]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def covered(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``size`` words lie in one of the spans."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def factorize(begin: np.ndarray, end: np.ndarray, source: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The greedy parse: factors as (first, end, source, place in the source) from indexed blocks, sorted by where they begin.

    ``source`` and ``place`` tell the document, and the word of it, at which a block is indexed.
    """
    out, i, n = [], 0, len(begin)
    while i < n:
        first, stop, doc, ahead = int(begin[i]), int(end[i]), int(source[i]), int(place[i] - begin[i])
        j = i + 1
        while j < n and begin[j] <= stop:
            if source[j] == doc and place[j] - begin[j] == ahead and end[j] > stop:
                stop = int(end[j])
            j += 1
        out.append((first, stop, doc, first + ahead))
        i += 1
        while i < n and end[i] <= stop:
            i += 1
    return out


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """``gram, block, id, mark, place``: the distinct anchors and blocks of each document, and the word at which they begin."""

    def run(batches):
        for rows in batches:
            for part in T.slices(rows.column(2)):
                p = Parse(part, window)
                a, end, block = p.blocks()
                block = np.where(end > a, block, np.uint64(0))
                doc = p.w.doc[a] if len(a) else a
                pick = np.unique(np.rec.fromarrays([doc, p.grams[a], block]), return_index=True)[1] if len(a) else a
                at = pa.array(doc[pick] + part.lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(T.signed(p.grams[a][pick])), pa.array(T.signed(block[pick])),
                     rows.column(0).take(at), rows.column(1).take(at), pa.array(a[pick] - p.w.first[doc[pick]], pa.int64())],
                    names=["gram", "block", "id", "mark", "place"])

    return map_arrow(docs, run, "gram bigint, block bigint, id bigint, mark int, place bigint")


def boundary_windows(docs: DataFrame, window: int) -> DataFrame:
    """``win, id, mark``: the distinct windows outside the factors whose smallest sequence another document has."""

    def run(batches):
        for rows in batches:
            for part in T.slices(rows.column(2)):
                mine = range(part.lo, part.lo + part.docs)
                if not any(rows.column(3)[i].is_valid for i in mine):
                    continue
                p = Parse(part, window)
                a, end, block = p.blocks()
                bound_a, bound_w = p.per_doc(a), p.per_doc(p.begins)
                out, owner = [], []
                for d, i in enumerate(mine):
                    shared = held(rows.column(3), i)
                    if not len(shared):
                        continue
                    known = held(rows.column(4), i)
                    ra, rw = slice(bound_a[d], bound_a[d + 1]), slice(bound_w[d], bound_w[d + 1])
                    hit = among(block[ra], known) & (end[ra] > a[ra])
                    begins, first, size = p.begins[rw], p.w.first[d], p.w.per_doc[d]
                    # A window lies in a block if a block that begins at or before it ends at or after its end.
                    reach = np.zeros(size, np.int64)
                    np.maximum.at(reach, a[ra][hit] - first, end[ra][hit] - first)
                    reach = np.maximum.accumulate(reach) if size else reach
                    open_ = among(p.smallest[rw], shared) & (reach[begins - first] < begins - first + window)
                    w = np.unique(p.window_hashes(begins[open_]))
                    out.append(w)
                    owner.append(np.full(len(w), i))
                if out:
                    at = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(T.signed(np.concatenate(out))), rows.column(0).take(at), rows.column(1).take(at)],
                        names=["win", "id", "mark"])

    return map_arrow(docs, run, "win bigint, id bigint, mark int")


def parse_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` and ``n_words, n_removed, spans, kept_text, factors``: the text without its duplicate words.

    A word is duplicate if a window of ``window`` consecutive words of its document covers it that a document with a
    smaller id has too. ``spans`` are the maximal ranges of duplicate words (first, end); ``kept_text`` has the
    others, joined by one space. ``factors`` are the pieces of the parse (first, end, source, source_first), of which
    the spans consist but for what windows at their boundaries add. Null texts have no words; documents of fewer than ``window`` words keep all. A
    null id is after all others. Rows with one id are not each other's reference, and each is parsed by its
    own text. A column that has one of the new names keeps it and the new one gets a leading ``_``; an
    empty table gives an empty result.
    """
    named = fresh(docs, "n_words", "n_removed", "spans", "kept_text", "factors")
    key, mark, grams, blocks, wins = fresh(docs, "lz_id", "lz_mark", "lz_grams", "lz_blocks", "lz_wins")
    body = column(text_col).cast("string")
    id_ = F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID))
    narrow = docs.select(id_.alias("id"), F.hash(body).alias("mark"), body.alias("text"))

    rows = materialize(anchor_rows(narrow, window))
    seen = rows.groupBy("gram").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = materialize(seen.where("first < last").select("gram"))
    rows = materialize(rows.join(shared, "gram"))
    index = materialize(rows.where("block <> 0").groupBy("block").agg(
        F.min(F.struct("id", "place")).alias("first"), F.max("id").alias("last")).where("first.id < last").select(
        "block", F.col("first.id").alias("source"), F.col("first.place").alias("source_place")))
    entry = F.struct("block", "source", F.col("source_place").alias("place"))
    earlier = rows.select("id", "mark", "block").join(index, "block").where(F.col("id") > F.col("source"))
    earlier = earlier.select("id", "mark", F.lit(None).cast("long").alias("gram"), entry.alias("entry"))
    none = F.lit(None).cast(earlier.schema["entry"].dataType)
    hits = materialize(rows.select("id", "mark", "gram", none.alias("entry")).unionByName(earlier).groupBy("id", "mark").agg(
        F.collect_set("gram").alias("grams"), F.collect_set("entry").alias("blocks")))

    whole = docs.withColumn(key, id_).withColumn(mark, F.hash(body))
    on = lambda right: [whole[key] == right["id"], whole[mark] == right["mark"]]
    left = narrow.join(hits, ["id", "mark"], "left").select("id", "mark", "text", "grams", F.col("blocks.block").alias("blocks"))
    windows = materialize(boundary_windows(left, window))
    firsts = materialize(windows.groupBy("win").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                         .where("first < last").select("win", "first"))
    again = windows.join(firsts, "win").where(F.col("id") > F.col("first"))
    again = materialize(again.groupBy("id", "mark").agg(F.collect_list("win").alias("wins")))
    factors = hits.select("id", "mark", "blocks").where(F.size("blocks") > 0)
    factors = factors.join(again, ["id", "mark"], "full_outer").select("id", "mark", F.col("blocks").alias(blocks), F.col("wins").alias(wins))
    out = whole.join(factors, on(factors), "left").select(*[whole[f"`{c}`"] for c in docs.columns], blocks, wins)
    return map_arrow(out, cutter(docs.columns, named, docs.columns.index(text_col), window), StructType(
        [*docs.schema, *StructType.fromDDL(f"{named[0]} bigint, {named[1]} bigint, "
                                          f"{named[2]} array<struct<first:bigint,end:bigint>>, {named[3]} string, "
                                          f"{named[4]} array<struct<first:bigint,end:bigint,source:bigint,source_first:bigint>>")]))


def cutter(names, named, text_at, window):
    """Parse each document into factors by its indexed blocks, and cut those and the duplicate windows at their boundaries."""
    n = len(names)
    pair = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    factor = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_first", pa.int64())])

    def run(batches):
        for rows in batches:
            for part in T.slices(rows.column(text_at)):
                mine = rows.slice(part.lo, part.docs)
                n_words, removed, spans, kept, factors = [], [], [], [], []
                touched = [mine.column(n)[d].is_valid or mine.column(n + 1)[d].is_valid for d in range(part.docs)]
                p = Parse(part, window) if any(touched) else None
                if p:
                    a, end, block = p.blocks()
                    bound_a, bound_w = p.per_doc(a), p.per_doc(p.begins)
                for d in range(part.docs):
                    words = part.data[part.offsets[d]:part.offsets[d + 1]].tobytes().split()
                    gone, parsed = np.zeros(len(words), bool), []
                    if touched[d]:
                        ra, rw, first = slice(bound_a[d], bound_a[d + 1]), slice(bound_w[d], bound_w[d + 1]), p.w.first[d]
                        known, source, place = indexed(mine.column(n), d)
                        hit = np.flatnonzero(among(block[ra], known) & (end[ra] > a[ra]))
                        at = np.searchsorted(known, block[ra][hit])
                        parsed = factorize(a[ra][hit] - first, end[ra][hit] - first, source[at], place[at])
                        begins = p.begins[rw]
                        wins = held(mine.column(n + 1), d)
                        begins = begins[among(p.window_hashes(begins), wins)] if len(wins) else begins[:0]
                        cut = np.array([f[:2] for f in parsed], np.int64).reshape(-1, 2)
                        gone = covered(len(words), np.r_[cut[:, 0], begins - first], np.r_[cut[:, 1], begins + window - first])
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    factors.append([dict(zip(("first", "end", "source", "source_first"), f)) for f in parsed])
                    n_words.append(len(words))
                    removed.append(int(gone.sum()))
                    spans.append([{"first": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                    kept.append(b" ".join([w for w, g in zip(words, gone) if not g] if gone.any() else words).decode())
                yield pa.RecordBatch.from_arrays(
                    list(mine.columns)[:n] + [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, pa.list_(pair)), pa.array(kept, pa.string()),
                                              pa.array(factors, pa.list_(factor))],
                    names=[*names, *named])

    return run
