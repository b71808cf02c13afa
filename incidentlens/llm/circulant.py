"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A first permutation spreads the shingles over ``UNIVERSE`` places; a second one, shifted by one place at a time, gives all
``BANDS * ROWS`` signature coordinates. Texts with equal shingle sets are one class with its smallest id. Classes that
share a band meet at the band's centre, the class with the most band mates; members of a centre are verified on
their full sets in blocks of bounded size, so a group of any size is spread over tasks and no pair becomes
a row: a block gives a forest of its verified links. Each block of a large group has the centre in it, so members
that are linked with the centre are done after one pass; only the rest meet all others. At similarity 0.8 a pair
shares no band with a probability of 3e-6, at 0.85 of 7e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import text as T
from incidentlens.llm.frames import column, fresh, map_arrow
from incidentlens.plans.materialize import materialize

BANDS, ROWS = 32, 5
UNIVERSE = 1 << 20
PART = 1 << 13  # shingles whose coordinates are held at once
BLOCK_DOCS, BLOCK_BYTES = 100, 8 << 20  # about half of what a task verifies at once
COPY_BLOCKS = 32  # blocks of a group that one copy of a text serves
COLUMNS = 1 << 13

_tables: dict[int, np.ndarray] = {}


def circulant_rows() -> np.ndarray:
    """Row i: the values of place i under all shifts of the second permutation (a view, not a copy)."""
    if 0 not in _tables:
        order = np.random.default_rng(7919).permutation(UNIVERSE).astype(np.int32)
        _tables[0] = np.concatenate([order, order[:BANDS * ROWS]])
    return sliding_window_view(_tables[0], BANDS * ROWS)


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signature coordinates of each document; the largest number where it has no shingle."""
    rows = circulant_rows()
    out = np.full((len(first) - 1, BANDS * ROWS), np.iinfo(np.int32).max, np.int32)
    place = (T.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    for lo in range(0, len(place), PART):
        hi = min(lo + PART, len(place))
        a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
        docs = np.arange(a, b)
        starts = np.maximum(first[docs], lo)
        filled = np.minimum(first[docs + 1], hi) > starts
        docs, starts = docs[filled], starts[filled]
        out[docs] = np.minimum(out[docs], np.minimum.reduceat(rows[place[lo:hi]], starts - lo, axis=0))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One number for each band, which holds the band's place too."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(signature), axis=0)
    parts = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    for i in range(ROWS):
        key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def shingle_sets(part: T.Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each document, one after another, and where each document begins.

    A document with fewer than ``n`` words, but any, has its whole sequence as one shingle.
    """
    w = T.words(part, T.LOWER)
    gram, whole = T.grams(w.hashes, w.first, n)
    count = w.per_doc
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        prefix = T._prefix(w.hashes)
        gram[w.first[few]] = T.span_hashes(prefix, w.first[few], w.first[few + 1])
        whole[w.first[few]] = True
    owner, gram = w.doc[whole], gram[whole]
    begin = np.searchsorted(owner, np.arange(part.docs + 1))
    parts, sizes = [], np.zeros(part.docs, np.int64)
    for d in range(part.docs):
        own = np.sort(gram[begin[d]:begin[d + 1]])
        own = own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own
        parts.append(own)
        sizes[d] = len(own)
    return np.concatenate(parts) if parts else gram, np.r_[0, np.cumsum(sizes)]


def fingerprint(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """``id, n, size, s1, s2, bands`` of each row; two sums of hashes identify the shingle set."""

    def run(batches):
        for rows in batches:
            for part in T.slices(rows.column(1), 1 << 18):
                sets, first = shingle_sets(part, n)
                sums = [np.r_[np.uint64(0), np.cumsum(T.mix(sets ^ np.uint64(salt)))] for salt in (11, 13)]
                s1, s2 = (s[first[1:]] - s[first[:-1]] for s in sums)
                keys = T.signed(band_keys(signatures(sets, first))).ravel()
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.docs + 1, dtype=np.int32) * BANDS), pa.array(keys))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(part.lo, part.docs), pa.array(np.diff(first)), pa.array(np.diff(part.offsets)),
                     pa.array(T.signed(s1)), pa.array(T.signed(s2)), bands],
                    names=["id", "n", "size", "s1", "s2", "bands"])

    source = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    return map_arrow(source, run, "id bigint, n bigint, size bigint, s1 bigint, s2 bigint, bands array<bigint>")


def centre_members(classes: DataFrame) -> DataFrame:
    """``centre, id, size``: two classes that share a band share its centre, so centres keep every meeting and have far
    fewer rows than bands. A centre is a member of its own.

    What is summed up for a band or centre is written before it is joined, so that a hot one's rows can be split.
    """
    rows = classes.select("id", "size", F.explode("bands").alias("band"))
    shared = materialize(rows.groupBy("band").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"))
    rows = materialize(rows.join(shared, "band"))
    mates = rows.groupBy("id").agg(F.sum("mates").alias("weight"))
    centre = rows.join(mates, "id").groupBy("band").agg(
        F.max(F.struct(F.col("weight"), (-F.col("id")).alias("neg"))).alias("top"))
    centre = materialize(centre.select("band", (-F.col("top.neg")).alias("centre")))
    return materialize(rows.join(centre, "band").select("centre", "id", "size").distinct())


def block_count(rows, size):
    """How many blocks take so many rows of so many bytes together; none for no rows."""
    return F.ceil(F.greatest(rows / BLOCK_DOCS, size / BLOCK_BYTES)).cast("int")


def deal_with_centre(members: DataFrame) -> DataFrame:
    """``centre, many, lo, hi, id``: each member in one block of its centre, and the centre in all of them.

    ``many`` says that there are several blocks, so that not every pair of members meets here.
    """
    groups = members.groupBy("centre").agg(block_count(F.count(F.lit(1)), F.sum("size")).alias("parts"))
    dealt = members.join(materialize(groups), "centre")
    block = F.when(F.col("id") == F.col("centre"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("id", "centre"), F.col("parts")).cast("int")))
    dealt = dealt.select("centre", (F.col("parts") > 1).alias("many"), "id", F.explode(block).alias("lo"))
    return dealt.select("centre", "many", "lo", F.col("lo").alias("hi"), "id")


def deal_rest(members: DataFrame, rest: DataFrame) -> DataFrame:
    """``centre, many, lo, hi, id``: blocks in which every pair of members meets of which one is among the ``rest``.

    The rest have the parts 0, 1, ... and the others, the centre among them, those that follow; a block is two parts.
    """
    rows = members.join(rest.distinct().withColumn("rest", F.lit(True)), ["centre", "id"], "left")
    rows = rows.withColumn("rest", F.coalesce("rest", F.lit(False)))
    side = lambda is_rest: block_count(F.count_if(F.col("rest") == is_rest),
                                       F.sum(F.when(F.col("rest") == is_rest, F.col("size")).otherwise(0)))
    groups = rows.groupBy("centre").agg(side(True).alias("apart"), side(False).alias("linked")).where("apart > 0")
    rows = rows.join(materialize(groups), "centre")
    place = F.xxhash64("id", "centre")
    mine = F.when(F.col("rest"), F.pmod(place, F.col("apart"))).otherwise(
        F.col("apart") + F.pmod(place, F.greatest("linked", F.lit(1)))).cast("int")
    rows = rows.withColumn("mine", mine)
    other = F.when(F.col("rest"), F.filter(F.sequence(F.lit(0), F.col("apart") + F.col("linked") - 1),
                                           lambda x: x != F.col("mine"))).otherwise(
        F.sequence(F.lit(0), F.col("apart") - 1))
    rows = rows.select("centre", "id", "mine", F.explode(other).alias("other"))
    return rows.select("centre", F.lit(False).alias("many"), F.least("mine", "other").alias("lo"),
                       F.greatest("mine", "other").alias("hi"), "id")


def block_links(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A forest of the links among a block's sets: (id, smallest id of its tree), from exact intersections."""
    k = len(sets)
    size = np.array([len(s) for s in sets])
    if k == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2)
        common[1] = common[0][::-1]
    else:
        _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        owner = np.repeat(np.arange(k), size)
        keep = count[place] > 1
        place, owner = shared[place[keep]], owner[keep]
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        common = np.zeros((k, k))
        total = int(shared[-1]) + 1 if len(shared) else 0
        for lo in range(0, total, COLUMNS):
            a, b = np.searchsorted(place, [lo, lo + COLUMNS])
            held = np.zeros((k, min(COLUMNS, total - lo)), np.float32)
            held[owner[a:b], place[a:b] - lo] = 1
            common += held @ held.T
    union = size[:, None] + size[None, :] - common
    linked = 100 * common >= percent * union
    np.fill_diagonal(linked, True)
    # Rows with one id are one document.
    order = np.argsort(ids, kind="stable")
    tree = np.full(k, -1)
    for root in order:
        if tree[root] >= 0:
            continue
        front = np.array([root])
        tree[root] = root
        while len(front):
            near = linked[front].any(0) | np.isin(ids, ids[front])
            front = np.flatnonzero(near & (tree < 0))
            tree[front] = root
    return [(int(ids[i]), int(ids[tree[i]])) for i in range(k) if ids[i] != ids[tree[i]]]


def verify(dealt: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b, apart``: a forest of the verified links of each block; from blocks of centres that have many of them also
    the members ``a`` that are not linked with the centre ``apart``, without a ``b``."""
    # A centre is in every block of its group: its text is copied, and each copy serves some of the blocks.
    copies = F.ceil(F.count(F.lit(1)) / COPY_BLOCKS).cast("int").alias("copies")
    often = materialize(dealt.groupBy("id").agg(copies).where("copies > 1"))
    spread = dealt.join(often, "id", "left").withColumn(
        "copy", F.pmod(F.xxhash64("centre", "lo", "hi"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    copied = materialize(docs.join(often, "id").select("id", "text", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")))
    held = docs.join(often, "id", "left_anti").select("id", "text", F.lit(0).alias("copy")).unionByName(copied)
    # Merged at every size: the side that could be broadcast grows with the documents.
    texts = held.hint("merge").join(spread, ["id", "copy"]).select("centre", "lo", "hi", "many", "id", "text")
    texts = texts.repartition("centre", "lo", "hi").sortWithinPartitions("centre", "lo", "hi")

    def links(key, many, ids, rows):
        if len(ids) < 2:
            return []
        out = []
        for part in T.slices(pa.array(rows, pa.string())):
            sets, first = shingle_sets(part, n)
            out += [sets[first[d]:first[d + 1]] for d in range(part.docs)]
        found = block_links(out, np.array(ids), percent)
        rows_out = [(a, b, None) for a, b in found]
        if many:
            root, centre = dict(found), key[0]
            own = root.get(centre, centre)
            rows_out += [(i, None, centre) for i in set(ids) if root.get(i, i) != own]
        return rows_out

    def run(batches):
        block, held, ids, rows, found = None, False, [], [], []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for key, many, id_, text in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)):
                if key != block:
                    found += links(block, held, ids, rows)
                    block, held, ids, rows = key, many, [], []
                ids.append(id_)
                rows.append(text.as_py())
        found += links(block, held, ids, rows)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "apart"])

    return map_arrow(texts, run, "a bigint, b bigint, apart bigint")


def verified_links(classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: links that join all classes that verified links join.

    Members that are linked with their centre are of one component and need not meet each other.
    """
    members = centre_members(classes)
    first = materialize(verify(deal_with_centre(members), docs, n, percent))
    links = first.where("b is not null").select("a", "b")
    rest = first.where("b is null").select(F.col("apart").alias("centre"), F.col("a").alias("id"))
    if not rest.limit(1).count():
        return links
    return links.unionByName(verify(deal_rest(members, rest), docs, n, percent).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that each linked id reaches, by smallest labels and pointer jumping.

    Every round is written to the shared folder; the rounds end when no label has changed.
    """
    edges = links.where("a <> b").distinct()
    edges = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("further"))
        step = step.join(jump, "via", "left").select(
            "id", F.least("via", F.coalesce("further", "via")).alias("component"), F.col("component").alias("old"))
        step, seen = materialize(step, changed=F.count_if(F.col("component") != F.col("old")))
        labels = step.select("id", "component")
        if not seen["changed"]:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept`` (its id is its component's).

    Texts are linked if ``100 * intersection >= percent * union`` of their sets of ``shingle_words``-word shingles
    (A-Z lower-cased). Texts without words, null ones too, have no shingles and are linked with nothing. A row
    without an id is linked with nothing, has no component and is kept. Rows with one id are one document: what any
    of its texts is linked with, it is. Other columns do not matter; an empty table gives an empty result.
    """
    prints = materialize(fingerprint(docs, id_col, text_col, shingle_words))
    usable = prints.where("n > 0 and id is not null")
    exact = materialize(usable.groupBy("n", "s1", "s2").agg(F.min("id").alias("class")))
    one = exact.withColumnRenamed("class", "id")
    classes = usable.join(one, ["n", "s1", "s2", "id"]).select("id", "size", "bands")
    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    labels = components(class_links(usable, exact).unionByName(verified_links(classes, texts, shingle_words, percent)))
    rows = prints.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("id")).alias("key"))
    out = rows.join(labels.withColumnRenamed("id", "key"), "key", "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def class_links(usable: DataFrame, exact: DataFrame) -> DataFrame:
    """Links of the members of each class with its smallest id."""
    rows = usable.select("id", "n", "s1", "s2").join(exact, ["n", "s1", "s2"])
    return rows.where(F.col("id") != F.col("class")).select(F.col("id").alias("a"), F.col("class").alias("b"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component, that with its smallest id, is kept.

    Of several rows with one id that have words, the one with the smallest text stays if the document does; rows
    without words or without an id all stay.
    """
    found = near_duplicates(docs, id_col, text_col, shingle_words, percent)
    key, others = fresh(docs, "near_id", "near_count")
    same = column(id_col).cast("long") == F.col(key)
    gone = materialize(found.where(~F.col("kept")).select(column(id_col).cast("long").alias(key)).distinct())
    kept = docs.join(gone, same, "left_anti")
    again = materialize(found.where(F.col(id_col).isNotNull() & F.col("kept") & (F.col("n_shingles") > 0)).groupBy(
        column(id_col).cast("long").alias(key)).agg(F.count(F.lit(1)).alias(others)).where(F.col(others) > 1).select(key))
    if not again.limit(1).count():
        return kept
    single = kept.join(again, same, "left_anti")
    several = kept.join(again, same, "left_semi")
    worded = F.coalesce(column(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    smallest = several.where(worded).groupBy(column(id_col).alias("_id")).agg(
        F.min_by(F.struct(*[column(c) for c in docs.columns]), column(text_col)).alias("_row"))
    smallest = smallest.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
    return single.unionByName(several.where(~worded)).unionByName(smallest)
