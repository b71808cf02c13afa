"""Hard-negative mining with segment summaries.

Vectors are packed into blocks, and each block keeps, for several levels, the mean and the deviation of every segment of
every vector (a segment is a stretch of components; those of the next level are a quarter as long). Within a
segment a product is the segment's length times the product of the means, plus or minus at most the product of the
deviations; the sum over segments bounds the score. Blocks of anchors meet blocks of vectors; pairs whose bounds rule them
out go, the rest is refined with the next level's segments, and the pairs that are left are scored exactly.

Every block of vectors meets every block of anchors once in each of two searches (positives, then negatives in the
bands that the positives set); only an anchor's best few of a block leave its task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.llm.frames import map_arrow
from incidentlens.plans.materialize import BROADCAST_BYTES, materialize

ROW_BLOCK, ANCHOR_BLOCK = 4096, 512
SEGMENTS = (64, 16, 4)  # components of a segment, by level; after the last come the components themselves
SPARSE = 16  # pairs are refined one by one once fewer than one in so many is left
PAIRS = 1 << 20  # components of pairs that are gathered at once
EXACT = 1 << 53  # whole numbers below it are exact in doubles
SLACK = 1e-6  # of the largest possible score: more than single precision summaries are off
PACKED = "ids binary, labels binary, size int, width int, kind string, vectors binary, summaries binary"


def summarize(table: np.ndarray, length: int) -> np.ndarray:
    """For each vector the means of its segments, times the root of the length, and then their deviations.

    So products of means, and of deviations, add up over segments. The last segment is filled with zeros.
    """
    n, width = table.shape
    parts = -(-width // length)
    cut = np.zeros((n, parts * length))
    cut[:, :width] = table
    cut = cut.reshape(n, parts, length)
    mean = cut.mean(2)
    return np.concatenate([mean * math.sqrt(length), np.sqrt(((cut - mean[:, :, None]) ** 2).sum(2))], 1).astype(np.float32)


def pack(ids: np.ndarray, labels: np.ndarray, table: np.ndarray) -> dict:
    """The columns of a block: whole numbers in their smallest type, and the summaries of all levels."""
    kind = next(k for k, most in (("int16", 1 << 15), ("int32", 1 << 31), ("float64", np.inf))
                if np.abs(table).max(initial=0) < most or k == "float64")
    return {"ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "size": table.shape[0],
            "width": table.shape[1], "kind": kind, "vectors": table.astype(kind).tobytes(),
            "summaries": b"".join(summarize(table, length).tobytes() for length in SEGMENTS)}


class Block:
    """Vectors of a block with their ids, labels and segment summaries, filled with zeros to the width ``full``."""

    def __init__(self, row: dict, full: int, prefix: str = ""):
        size, width = row[prefix + "size"], row[prefix + "width"]
        self.ids, self.labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.zeros((size, full))
        self.vectors[:, :width] = np.frombuffer(row[prefix + "vectors"], row[prefix + "kind"]).reshape(size, width)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        stored, at, self.levels = np.frombuffer(row[prefix + "summaries"], np.float32), 0, []
        for length in SEGMENTS:
            parts, all_parts = -(-width // length), -(-full // length)
            level = stored[at:at + 2 * parts * size].reshape(size, 2, parts)
            at += level.size
            self.levels.append(np.zeros((2, size, all_parts)))
            self.levels[-1][:, :, :parts] = level.swapaxes(0, 1)


def _pair_sums(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(i)), max(1, PAIRS // max(1, a.shape[1]))
    for lo in range(0, len(i), step):
        out[lo:lo + step] = np.einsum("ps,ps->p", a[i[lo:lo + step]], b[j[lo:lo + step]])
    return out


def refine(anchors: Block, rows: Block, alive: np.ndarray, keep, bounds_left: list | None = None):
    """Pairs of ``alive`` that the bounds of all levels leave, with their exact scores: ``(i, j, score)``.

    ``keep(i, j, low, high)`` tells which pairs stay, given bounds of their scores; ``bounds_left`` takes the number of
    pairs left after each level.
    """
    width = anchors.vectors.shape[1]
    i, j = np.nonzero(alive)
    slack = SLACK * (1.0 + width * anchors.largest * rows.largest)
    for (am, ad), (bm, bd) in zip(anchors.levels, rows.levels):
        if not len(i):
            break
        if len(i) * SPARSE > alive.size:
            middle, spread = (am @ bm.T)[i, j], (ad @ bd.T)[i, j]
        else:
            middle, spread = _pair_sums(am, bm, i, j), _pair_sums(ad, bd, i, j)
        stay = keep(i, j, middle - spread - slack, middle + spread + slack)
        i, j = i[stay], j[stay]
        if bounds_left is not None:
            bounds_left.append(len(i))
    if width * anchors.largest * rows.largest < EXACT:
        if len(i) * SPARSE > alive.size:
            score = (anchors.vectors @ rows.vectors.T)[i, j]
        else:
            score = _pair_sums(anchors.vectors, rows.vectors, i, j)
        return i, j, score.astype(np.int64)
    whole = [[[int(x) for x in v] for v in block.vectors] for block in (anchors, rows)]
    exact = [sum(x * y for x, y in zip(whole[0][p], whole[1][q])) for p, q in zip(i.tolist(), j.tolist())]
    return i, j, np.array(exact, np.int64)


def _first(i, score, ids, most):
    """Order by ``i``, falling score and id, and which of that order are among the first ``most`` of their ``i``."""
    order = np.lexsort((ids, -score, i))
    heads = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
    return order[rank < most]


def best_same(anchors: Block, rows: Block, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor its first ``most`` other vectors of the same label in ``rows``."""
    alive = (anchors.labels[:, None] == rows.labels) & (anchors.ids[:, None] != rows.ids)
    n = len(anchors.ids)

    def keep(i, j, low, high):
        # The score of the last one that is wanted is no less than the low bound of that rank.
        floor = np.full(n, -np.inf)
        order = np.lexsort((-low, i))
        at = np.searchsorted(i[order], np.arange(n)) + most - 1
        there = at < len(order)
        there[there] = i[order][at[there]] == np.flatnonzero(there)
        floor[there] = low[order][at[there]]
        return high >= floor[i]

    i, j, score = refine(anchors, rows, alive, keep)
    kept = _first(i, score, rows.ids[j], most)
    return i[kept], rows.ids[j[kept]], score[kept]


def best_between(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, percents: tuple[int, int], bands,
                 most: int):
    """For each band its first ``most`` vectors of another label: place in ``bands``, id and score.

    ``bands`` holds the anchor's place and the positive's score of each band; ``low`` and ``high`` bound an anchor's bands.
    """
    def keep(i, j, least, greatest):
        return (greatest >= low[i]) & (least <= high[i])

    wanted = np.zeros(len(anchors.ids), bool)
    wanted[bands[0]] = True
    i, j, score = refine(anchors, rows, (anchors.labels[:, None] != rows.labels) & wanted[:, None], keep)
    order = np.lexsort((rows.ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    falling = -score
    begin, end = np.searchsorted(i, bands[0]), np.searchsorted(i, bands[0], "right")
    places, ids, scores = [], [], []
    for b, (lo, hi, positive) in enumerate(zip(begin.tolist(), end.tolist(), bands[1].tolist())):
        floor, top = -(-percents[0] * positive // 100), percents[1] * positive // 100
        first = lo + int(falling[lo:hi].searchsorted(-top))
        last = min(lo + int(falling[lo:hi].searchsorted(-floor, "right")), first + most)
        if last > first:
            places.append(np.full(last - first, b))
            ids.append(rows.ids[j[first:last]])
            scores.append(score[first:last])
    if not places:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(places), np.concatenate(ids), np.concatenate(scores)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows of ``id, label, vector`` (whole numbers as doubles)."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                lists = part.column(2)
                size = np.diff(lists.offsets.to_numpy())
                width = int(size.max(initial=0))
                table = np.zeros((len(size), width))
                table[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                row = pack(part.column(0).to_numpy(), part.column(1).to_numpy(), table)
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    arrow = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("size", pa.int32()), ("width", pa.int32()),
                       ("kind", pa.string()), ("vectors", pa.binary()), ("summaries", pa.binary())])
    return map_arrow(rows.select("id", "label", "vector"), run, PACKED).withColumn("block", F.monotonically_increasing_id())


def _written(blocks: DataFrame) -> tuple[DataFrame, dict]:
    held = F.octet_length("vectors") + F.octet_length("summaries") + 16 * F.col("size")
    return materialize(blocks, blocks=F.count(F.lit(1)), width=F.max("width"), bytes=F.sum(held))


def _meet(blocks: DataFrame, n_blocks: int, anchors: DataFrame, n_anchors: int, anchor_bytes: int) -> DataFrame:
    """Every block of vectors with every block of anchors, once.

    One side is dealt to buckets by the hash of its number, a copy of the other goes to each bucket. Anchors of a
    measured size that may be broadcast stay where they are, and vectors too; else the anchors, which are far
    fewer, are copied to the buckets of the vectors.
    """
    named = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    deal = lambda number, n: F.pmod(F.xxhash64(number), F.lit(n)).cast("int").alias("bucket")
    copy = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bucket")
    if anchor_bytes <= BROADCAST_BYTES:
        return blocks.select("*", copy(n_anchors)).join(F.broadcast(named.select("*", deal("a_block", n_anchors))), "bucket")
    return blocks.select("*", deal("block", n_blocks)).join(named.select("*", copy(n_blocks)), "bucket")


class _Decoded:
    """The blocks of a task's current pair: the next pair mostly has one of them again."""

    def __init__(self, full: int):
        self.full, self.known = full, {}

    def __call__(self, row: dict, prefix: str) -> Block:
        key = row[prefix + "block"]
        if self.known.get(prefix, (None, None))[0] != key:
            self.known[prefix] = key, Block(row, self.full, prefix)
        return self.known[prefix][1]


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str, label, scale: int) -> DataFrame:
    """``id, label, vector`` of the rows that take part; components become ``floor(scale * x)``."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), v.alias("vector"), fine.alias("fine"))
    rows = rows.where(F.col("fine") & F.col("id").isNotNull() & F.col("label").isNotNull())
    return rows.select("id", "label", F.transform("vector", lambda x: F.floor(scale * x).cast("double")).alias("vector"))


def mine(vectors: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, percents: tuple[int, int] = (30, 90),
         id_col: str = "vec_id", vector_col: str = "embedding", label=None, scale: int = 256) -> DataFrame:
    """Hard negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are its first ``n_positives`` other rows
    of the same label by inner product (ties: smaller id). For each of them the first ``n_negatives`` rows of another label
    whose score lies between ``percents`` of the positive's score are returned, ranked from 1. ``label`` is a column
    (the column ``label`` unless given).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different
    lengths count as filled with zeros. A row with the anchor's id is never its positive; repeated rows count each, also as
    anchors. Scores beyond a bigint raise. Other columns are left out, whatever their names; an empty table, or one
    without anchors, gives an empty result.
    """
    rows = clean_vectors(vectors, id_col, vector_col, F.col("label") if label is None else label, scale)
    blocks, of_rows = _written(_packed(rows, ROW_BLOCK))
    chosen = rows.where(F.col("id") % every == 0)
    chosen = chosen.repartition(max(1, -(-chosen.count() // ANCHOR_BLOCK)))
    anchors, of_anchors = _written(_packed(chosen, ANCHOR_BLOCK))
    n_blocks, n_anchors, width = max(1, of_rows["blocks"]), max(1, of_anchors["blocks"]), int(of_rows["width"] or 0)

    def met(these):
        return _meet(blocks, n_blocks, these, n_anchors, of_anchors["bytes"] or 0)

    def positives(batches):
        block = _Decoded(width)
        for batch in batches:
            for row in batch.to_pylist():
                i, ids, score = best_same(block(row, "a_"), block(row, ""), n_positives)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(i), row["a_block"]), pa.int64()), "place": pa.array(i, pa.int64()),
                    "positive_id": pa.array(ids, pa.int64()), "positive_score": pa.array(score, pa.int64())})

    found = map_arrow(met(anchors), positives,
                      "block bigint, place bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("block", "place").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n_positives)
    # Only these few of each anchor travel with its block.
    bands = found.groupBy("block").agg(F.sort_array(F.collect_list(
        F.struct("place", "nth", "positive_id", "positive_score"))).alias("bands"))
    anchors = materialize(anchors.join(bands, "block"))

    def negatives(batches):
        block = _Decoded(width)
        for batch in batches:
            for row in batch.to_pylist():
                bands, a, b = row["a_bands"], block(row, "a_"), block(row, "")
                place = np.array([x["place"] for x in bands], np.int64)
                positive = np.array([x["positive_score"] for x in bands], np.int64)
                low, high = np.full(len(a.ids), np.inf), np.full(len(a.ids), -np.inf)
                np.minimum.at(low, place, positive * (percents[0] / 100))
                np.maximum.at(high, place, positive * (percents[1] / 100))
                at, ids, score = best_between(a, b, low, high, percents, (place, positive), n_negatives)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(at), row["a_block"]), pa.int64()),
                    "place": pa.array(place[at], pa.int64()), "nth": pa.array([bands[k]["nth"] for k in at], pa.int32()),
                    "anchor_id": pa.array(a.ids[place[at]], pa.int64()),
                    "positive_id": pa.array([bands[k]["positive_id"] for k in at], pa.int64()),
                    "positive_score": pa.array(positive[at], pa.int64()),
                    "negative_id": pa.array(ids, pa.int64()), "negative_score": pa.array(score, pa.int64())})

    schema = ("block bigint, place bigint, nth int, anchor_id bigint, positive_id bigint, positive_score bigint, "
              "negative_id bigint, negative_score bigint")
    mined = map_arrow(met(anchors), negatives, schema)
    order = Window.partitionBy("block", "place", "nth").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
