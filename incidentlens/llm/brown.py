"""Scores by Brown class-based n-grams: exchange clustering, class transitions and word emissions.

log10 P(w | v) = log10 P(class(w) | class(v)) + log10 P(w | class(w)), with transitions smoothed towards class frequencies.
All training texts are counted. All words that tasks hold (the ``FREQUENT`` most frequent ones) and that were met at
least ``LEAST`` times are moved between ``CLASSES`` classes: in each round one pass over the training texts counts every
such word's neighbours by class, and a half of the words moves to the class that gives the class bigrams the highest
mutual information. The rounds end when both halves together have raised it by less than ``LEAST_GAIN`` of itself, or after
``ROUNDS``. The other words have one of ``ENDINGS`` classes by their last two bytes, so the class of any word, an unseen
one too, needs no lookup. A class of endings keeps the share of its words that were met once for unseen words.

Bounded by these parameters are the class matrices and the table of the ``FREQUENT`` most frequent words that tasks hold.
Counts of all other words stay in a table that is joined with the words of the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm import text as T
from incidentlens.llm.frames import column, map_arrow
from incidentlens.plans.materialize import materialize

CLASSES, ENDINGS = 64, 16
FREQUENT, LEAST = 131_072, 3
ROUNDS, LEAST_GAIN = 6, 0.005
FOLDS, HELD_OUT = 7, 2
BOUNDARY = CLASSES + ENDINGS  # the class of a text's end, which is also before its first word
ALL = BOUNDARY + 1
END = np.uint64(0x1D8AF066C4A2F1B3)
PRIOR = 5.0  # weight of the class frequencies in a transition
HELD = 1 << 21
BUCKET = 1024  # moving words whose neighbours are summed together


def sequence(part: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a slice, an ``END`` after each document, their ending classes, and each document's first token."""
    w = T.words(part, T.LOWER)
    n, docs = len(w.hashes), part.docs
    at = np.arange(n) + w.doc
    hashes = np.full(n + docs, END, np.uint64)
    hashes[at] = w.hashes
    tail = np.full(n + docs, BOUNDARY, np.int64)
    folded = T.LOWER[part.data].astype(np.int64) if n else np.zeros(1, np.int64)
    before = np.where(w.end - w.start > 1, folded[np.maximum(w.end - 2, 0)], 0)
    tail[at] = CLASSES + (folded[w.end - 1] * 31 + before * 17) % ENDINGS if n else 0
    return hashes, tail, w.first + np.arange(docs + 1)


class Index:
    """Places of values in a sorted array: by a table of hash ends, and by bisection where two values share an end."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.mask = np.uint64((1 << max(10, 3 + len(known).bit_length())) - 1)
        slot = (known & self.mask).astype(np.int64)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        self.table[slot] = np.arange(len(known))
        self.crowded = np.bincount(slot, minlength=len(self.table)) > 1

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where it is missing."""
        if not len(self.known):
            return np.full(len(values), -1)
        slot = (values & self.mask).astype(np.int64)
        at = self.table[slot].astype(np.int64)
        at[self.known[at] != values] = -1
        rest = np.flatnonzero((at < 0) & self.crowded[slot])
        place = np.minimum(np.searchsorted(self.known, values[rest]), len(self.known) - 1)
        at[rest] = np.where(self.known[place] == values[rest], place, -1)
        return at


def training(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, held_out``; a null id counts as an empty one."""
    fold = F.pmod(F.crc32(F.encode(F.coalesce(column(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))
    return docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"),
                       (fold == HELD_OUT).alias("held_out"))


def count_words(texts: DataFrame) -> DataFrame:
    """``word, kind, n``: hash, ending class and count of every training token. A task adds up before the shuffle."""

    def merged(held):
        hashes, tails = (np.concatenate(x) for x in zip(*held))
        word, first, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(T.signed(word)), pa.array(tails[first].astype(np.int32)), pa.array(n)], names=["word", "kind", "n"])

    def run(batches):
        held, size = [], 0
        for rows in batches:
            for part in T.slices(rows.column(0)):
                hashes, tail, _ = sequence(part)
                held.append((hashes, tail))
                size += len(hashes)
                if size > HELD:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    counted = map_arrow(texts.select("text"), run, "word bigint, kind int, n bigint")
    return counted.groupBy("word").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))


def count_cells(texts: DataFrame, cells_of, size: int) -> DataFrame:
    """``cell, n``: sums over the training texts of the cells that ``cells_of`` gives for a slice, of ``size`` possible."""

    def run(batches):
        total, held, n = np.zeros(size, np.int64), [], 0
        for rows in batches:
            for part in T.slices(rows.column(0)):
                cells = cells_of(part)
                held.append(cells)
                n += len(cells)
                if n > HELD:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 18):
            own = at[lo:lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["cell", "n"])

    counted = map_arrow(texts.select("text"), run, "cell bigint, n bigint")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


def token_classes(hashes, tail, index, classes):
    """The class of each token and its number among the exchanged words (-1: not one of them)."""
    at = index.find(hashes)
    return np.where(at >= 0, classes[at] if len(classes) else 0, tail), at


def neighbour_cells(words: np.ndarray, classes: np.ndarray, turn: int):
    """Class bigrams as cells (class, class) and, after those, cells (word, side, class): what follows (side 0) and
    precedes (side 1) each exchanged word that this turn may move, every second one."""
    index = Index(words)

    def cells_of(part):
        hashes, tail, _ = sequence(part)
        kind, at = token_classes(hashes, tail, index, classes)
        if not len(kind):
            return kind
        before, after = np.r_[BOUNDARY, kind[:-1]], np.r_[kind[1:], BOUNDARY]
        own = np.flatnonzero((at >= 0) & (at % 2 == turn % 2))
        base = ALL * ALL + at[own] // 2 * (2 * ALL)
        return np.concatenate([before * ALL + kind, base + after[own], base + ALL + before[own]])

    return cells_of


def transition_cells(words: np.ndarray, classes: np.ndarray):
    index = Index(words)

    def cells_of(part):
        hashes, tail, _ = sequence(part)
        kind, _ = token_classes(hashes, tail, index, classes)
        return np.r_[BOUNDARY, kind[:-1]] * ALL + kind if len(kind) else kind

    return cells_of


def entropy_term(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(after: np.ndarray, before: np.ndarray, own: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """For words with their neighbours' class counts: the exchanged class that raises the sum of N log N of class
    bigrams, less that of the class frequencies, the most; a tie keeps the word where it is."""
    out = own.copy()
    for i in range(len(own)):
        m = matrix.copy()
        m[own[i]] = np.maximum(m[own[i]] - after[i], 0)
        m[:, own[i]] = np.maximum(m[:, own[i]] - before[i], 0)
        rows, columns = m[:CLASSES], m[:, :CLASSES]
        f, b = np.flatnonzero(after[i]), np.flatnonzero(before[i])
        gain = (entropy_term(rows[:, f] + after[i][f]) - entropy_term(rows[:, f])).sum(1)
        gain += (entropy_term(columns[b] + before[i][b][:, None]) - entropy_term(columns[b])).sum(0)
        size = np.maximum(rows.sum(1), columns.sum(0))
        gain -= 2 * (entropy_term(size + after[i].sum()) - entropy_term(size))
        best = int(np.argmax(gain))
        if gain[best] > gain[own[i]] + 1e-9:
            out[i] = best
    return out


def mutual_information(matrix: np.ndarray) -> float:
    """Of neighbouring classes, in nats a token."""
    total = max(matrix.sum(), 1.0)
    terms = entropy_term(matrix).sum() - entropy_term(matrix.sum(0)).sum() - entropy_term(matrix.sum(1)).sum()
    return float((terms + entropy_term(np.array([total])).sum()) / total)


def count_neighbours(texts: DataFrame, cells_of, words: int) -> DataFrame:
    """``bucket, place, n``: what ``neighbour_cells`` gives, summed by each task and packed: arrays of cells and their counts.

    Bucket -1 holds the class bigrams, the others ``BUCKET`` moving words each, with cells counted from the bucket's first.
    """
    width = BUCKET * 2 * ALL
    buckets = -(-words // BUCKET)

    def run(batches):
        total = np.zeros(ALL * ALL + buckets * width, np.int64)
        for rows in batches:
            for part in T.slices(rows.column(0)):
                np.add.at(total, cells_of(part), 1)
        for bucket in range(-1, buckets):
            own = total[:ALL * ALL] if bucket < 0 else total[ALL * ALL + bucket * width:][:width]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([own[at].tobytes()], pa.binary())], names=["bucket", "place", "n"])

    return map_arrow(texts.select("text"), run, "bucket int, place binary, n binary")


def unpacked(batches):
    for rows in batches:
        for place, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(place, np.int32).astype(np.int64)),
                                              pa.array(np.frombuffer(n, np.int64))], names=["cell", "n"])


def exchange(texts: DataFrame, words: np.ndarray, classes: np.ndarray, rounds: int, gains: list | None = None) -> np.ndarray:
    """Move words between classes: in each round, the half of the words whose place has the round's parity.

    ``gains`` takes the mutual information that each round begins with.
    """
    gains = [] if gains is None else gains
    for turn in range(rounds):
        if not len(words):
            break
        counted = materialize(count_neighbours(texts, neighbour_cells(words, classes, turn), (len(words) + 1) // 2))
        cells = map_arrow(counted.where("bucket < 0").select("place", "n"), unpacked, "cell bigint, n bigint")
        matrix = square(cells.groupBy("cell").agg(F.sum("n").alias("n")))
        gains.append(mutual_information(matrix))
        if turn >= 3 and gains[-1] - gains[-3] < LEAST_GAIN * gains[-1]:
            break
        moving = counted.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")

        def moved_words(bucket, sums, matrix, classes, turn):
            """A bucket's words that were met, and their new classes."""
            sums = sums.reshape(BUCKET, 2, ALL)
            met = np.flatnonzero(sums.any((1, 2)))
            at = (bucket * BUCKET + met) * 2 + turn % 2
            new = best_classes(sums[met, 0].astype(float), sums[met, 1].astype(float), classes[at], matrix)
            return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(new.astype(np.int32))], names=["at", "class"])

        def run(batches, matrix=matrix, classes=classes, turn=turn):
            now, sums = None, None
            for rows in batches:
                for bucket, place, n in zip(*(rows.column(i).to_pylist() for i in range(3))):
                    if bucket != now:
                        if now is not None:
                            yield moved_words(now, sums, matrix, classes, turn)
                        now, sums = bucket, np.zeros(BUCKET * 2 * ALL, np.int64)
                    sums[np.frombuffer(place, np.int32)] += np.frombuffer(n, np.int64)
            if now is not None:
                yield moved_words(now, sums, matrix, classes, turn)

        moved = map_arrow(moving, run, "at int, class int").toArrow()
        classes = classes.copy()
        classes[moved.column("at").to_numpy()] = moved.column("class").to_numpy()
    return classes


def square(cells: DataFrame) -> np.ndarray:
    """Class bigram counts as a matrix; they are few, whatever the texts."""
    table = cells.toArrow()
    out = np.zeros(ALL * ALL)
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(ALL, ALL)


def fit(texts: DataFrame, rounds: int = ROUNDS):
    """Train on ``text``: the counts table and a dictionary of the bounded parts of the model."""
    counts, sums = materialize(count_words(texts), tokens=F.coalesce(F.sum("n"), F.lit(0)), words=F.count(F.lit(1)))
    signed_end = int(T.signed(np.array([END]))[0])
    inner = counts.where(F.col("word") != signed_end)
    top = inner.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    model = {"N": int(sums["tokens"]), "V": int(sums["words"]), "word": word[order], "kind": top.column("kind").to_numpy()[order].astype(np.int64),
             "n": top.column("n").to_numpy()[order].astype(np.int64), "ends": int(sums["tokens"]) and (
                 counts.where(F.col("word") == signed_end).agg(F.sum("n")).first()[0] or 0)}
    head = order[top.column("n").to_numpy()[order] >= LEAST]
    # Words of one ending start in the same few classes.
    words, per = word[head], CLASSES // ENDINGS
    classes = (top.column("kind").to_numpy()[head].astype(np.int64) - CLASSES) * per + head % per
    model["information"] = []
    classes = exchange(texts, words, classes, rounds, model["information"])
    at = Index(words).find(model["word"])
    exchanged = at >= 0
    model["class"] = np.where(exchanged, classes[at] if len(words) else 0, model["kind"])
    bigrams = square(count_cells(texts, transition_cells(words, classes), ALL * ALL))
    size = bigrams.sum(0)
    share = (size + 1) / (size.sum() + ALL)
    model["transition"] = np.log10((bigrams + PRIOR * share) / (bigrams.sum(1, keepdims=True) + PRIOR))
    # Words of the ending classes: their tokens and how many were met once, without the exchanged words.
    kinds = inner.groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect()
    total, once = np.zeros(ALL), np.zeros(ALL)
    for row in kinds:
        total[row["kind"]], once[row["kind"]] = row["n"], row["once"]
    total -= np.bincount(model["kind"][exchanged], weights=model["n"][exchanged], minlength=ALL)
    once -= np.bincount(model["kind"][exchanged], weights=model["n"][exchanged] == 1, minlength=ALL)
    unseen = (once + 1) / (np.maximum(total, once) + 2)
    own = np.bincount(model["class"], weights=model["n"], minlength=ALL)
    inside = np.where(np.arange(ALL) < CLASSES, np.log10(1 / np.maximum(own, 1)), np.log10((1 - unseen) / np.maximum(total, 1)))
    model["emission"] = np.log10(np.maximum(model["n"], 1)) + inside[model["class"]]
    model["inside"], model["unseen"] = inside, np.log10(unseen)
    return counts, model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    Tokens are the words of the text, A-Z lower-cased, and one end. Null and empty texts have one token. The model
    learns from the documents whose crc32 of the id as text, modulo ``FOLDS``, isn't ``HELD_OUT`` (a null id counts
    as an empty text); ``base_score`` is the add-one unigram score, ``score`` that of the class model. Repeated rows
    are scored each; without training documents every word is unseen. Other columns do not matter; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    texts = training(docs, id_col, text_col)
    counts, model = fit(texts.where("not held_out"), rounds)
    shared = spark.sparkContext.broadcast(model)
    kind = texts.schema["id"].dataType.simpleString()
    marked = texts.withColumn("mark", F.xxhash64("text"))
    rows = materialize(map_arrow(
        marked, scorer(shared), f"id {kind}, held_out boolean, mark bigint, n_tokens bigint, n_known bigint, base double, "
        "score double, word array<bigint>, kind array<int>, times array<int>"))
    rare = rows.select("id", "mark", F.explode(F.arrays_zip("word", "kind", "times")).alias("w")).select("id", "mark", "w.*")
    rare = rare.join(counts.select("word", "n"), "word", "left")
    norm = float(model["N"] + model["V"] + 1)
    table = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("kind") - CLASSES + 1)
    seen = F.col("n").isNotNull()
    emission = F.when(seen, F.log10(F.col("n").cast("double")) + table(model["inside"][CLASSES:BOUNDARY])).otherwise(
        table(model["unseen"][CLASSES:BOUNDARY]))
    sums = rare.groupBy("id", "mark").agg(
        F.sum(F.when(seen, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(norm))).alias("rare_base"),
        F.sum(F.col("times") * emission).alias("rare_score"))
    copies = rows.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("copies"))
    plain = rows.drop("word", "kind", "times").alias("r")
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.mark").eqNullSafe(F.col(f"{b}.mark"))
    out = plain.join(sums.alias("s"), same("r", "s"), "left").join(copies.alias("c"), same("r", "c"))
    # Rows with the same id and text met each other's rare words, as many times as there are such rows.
    part = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    return out.select(
        F.col("r.id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + part("rare_known").cast("long")).alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"), (F.col("base") + part("rare_base")).alias("base_score"),
        (F.col("score") + part("rare_score")).alias("score"))


def scorer(shared):
    """For each text what the bounded tables give, and its other words with how often they occur."""

    def run(batches):
        model = shared.value
        index = Index(model["word"])
        norm = float(model["N"] + model["V"] + 1)
        base = np.log10((model["n"] + 1) / norm)
        end_base = np.log10((model["ends"] + 1) / norm)
        for rows in batches:
            for part in T.slices(rows.column(1)):
                hashes, tail, first = sequence(part)
                doc = np.repeat(np.arange(part.docs), np.diff(first))
                at = index.find(hashes)
                known, end = at >= 0, hashes == END
                kind = np.where(known, model["class"][at] if len(model["word"]) else 0, tail)
                before = np.r_[BOUNDARY, kind[:-1]]
                score = model["transition"][before, kind]
                own = np.zeros(len(hashes))
                own[end] = end_base
                if len(model["word"]):
                    score[known] += model["emission"][at[known]]
                    own[known] = base[at[known]]
                total = lambda x: np.bincount(doc, weights=x, minlength=part.docs)
                rest = np.flatnonzero(~known & ~end)
                order = np.lexsort((hashes[rest], doc[rest]))
                rest = rest[order]
                new = np.r_[True, (doc[rest][1:] != doc[rest][:-1]) | (hashes[rest][1:] != hashes[rest][:-1])] if len(rest) else np.zeros(0, bool)
                heads = np.flatnonzero(new)
                times = np.diff(np.r_[heads, len(rest)])
                pick = rest[heads]
                offsets = pa.array(np.searchsorted(doc[pick], np.arange(part.docs + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (
                    T.signed(hashes[pick]), tail[pick].astype(np.int32), times.astype(np.int32))]
                mine = rows.slice(part.lo, part.docs)
                sure = known | (end if model["ends"] else False)
                yield pa.RecordBatch.from_arrays(
                    [mine.column(0), mine.column(2), mine.column(3), pa.array(np.diff(first)),
                     pa.array(total(sure).astype(np.int64)), pa.array(total(own)), pa.array(total(score)), *lists],
                    names=["id", "held_out", "mark", "n_tokens", "n_known", "base", "score", "word", "kind", "times"])

    return run
