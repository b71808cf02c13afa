"""Mixing sources to target weights as a time-varying curriculum.

Every source has a target number of words and a weight schedule over the training time from 0 to 1. The schedule is
integrated to a cumulative demand; the documents of a source, in the order of a keyed hash and as often as the
target asks, are laid along it, and inverting the demand gives the time of each copy. Rows are range-sorted by it.
Prefix sums run over (source, hash bucket): no task holds a whole source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from incidentlens.llm import text as T
from incidentlens.llm.frames import column, fresh, map_arrow
from incidentlens.plans.materialize import materialize

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SLOPES = (-0.5, 0.0, 0.5)  # of the weight schedules, by source in turn: falling, even, rising
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 64, 1024, 1 << 20


def with_size(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """Append the number of words of each whole text (null: 0)."""
    at, names = docs.columns.index(text_col), [*docs.columns, name]

    def run(batches):
        for rows in batches:
            size = pa.array(T.word_counts(rows.column(at)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*rows.columns, size], names=names)

    return map_arrow(docs, run, StructType([*docs.schema, StructField(name, LongType())]))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_copies: int = MAX_COPIES) -> DataFrame:
    """From ``source, source_size`` the columns ``weight, slope, target``.

    All sizes are shared by weight. A share above ``max_copies`` times the source's size stops there and the
    excess is shared again by weight, until none is above: the level (words for a unit of weight) rises with every
    round of one aggregate, and the rounds end when no further source stops. Only the level reaches the driver.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.asc_nulls_last("source"))
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    table = spark.createDataFrame(ranked, StructType([*sizes.schema, StructField("place", LongType())]))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]),
                                       (F.col("place") % len(values) + 1).cast("int"))
    table = materialize(table.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)).drop("place"))
    cap = F.col("source_size") * max_copies
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        stops = cap <= F.lit(level) * F.col("weight")
        n, words, weight = table.agg(
            F.count_if(stops), F.coalesce(F.sum(F.when(stops, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not weight:
            break
        full, level = n, (total - words) / weight
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, slopes=SLOPES, max_copies: int = MAX_COPIES, seed: int = 42, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and ``size, source_size, target, taken, copies, position, positions``, sorted by position.

    ``taken`` is ``size * copies``; a source's taken words come within half a document of its target. A source is laid out
    in whole passes and a last one that ends with its target; ``positions`` are the training times in [0, 1) at which
    the copies of a document begin, one in each pass that reaches it, and ``position`` is the first of them (none, and null,
    for documents that are not taken). Nulls: a text has size 0, a null source is a source of its own, a null id is an id.
    Rows with equal ids are told apart, and dealt to buckets, by text too; equal rows are interchangeable. Documents of size 0 take part with
    0 words. A column that has one of the new names keeps it and the new one gets a leading ``_``; an empty table
    gives an empty result.
    """
    named = fresh(docs, "size", "source_size", "target", "taken", "copies", "position", "positions")
    size, source_size, target, taken, copies, position, positions = named
    bucket, order, tie, start, slope, key, weight, ahead, whole, of_source, of_bucket = fresh(
        docs, "mix_bucket", "mix_order", "mix_tie", "mix_start", "mix_slope", "mix_source", "mix_weight", "mix_ahead",
        "mix_whole", "mix_of_source", "mix_of_bucket")
    rows = docs.withColumn(tie, F.xxhash64(column(text_col)))
    rows = with_size(rows, text_col, size)
    if not keep_text:
        rows = materialize(rows.drop(text_col))
    count = docs.count()  # the footers of a table tell it
    buckets = 1 << max(0, math.ceil(math.log2(max(1, count / BUCKET_ROWS))))
    buckets = min(max(buckets, LEAST_BUCKETS), MOST_BUCKETS)
    rows = (rows.withColumn(order, F.xxhash64(F.lit(seed), column(id_col), F.col(tie)))
            .withColumn(bucket, F.pmod(F.shiftrightunsigned(order, 20), F.lit(buckets)))
            .withColumn(key, column(source_col).cast("string")))
    parts = materialize(rows.groupBy(F.col(key).alias("source"), F.col(bucket).alias("bucket"))
                        .agg(F.sum(size).alias("words")))
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, max_copies)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("t.source"))
    parts = parts.alias("p").join(targets.alias("t"), same).select(
        F.col("p.source").alias(of_source), F.col("p.bucket").alias(of_bucket), F.col("p.before").alias(start),
        F.col("t.source_size").alias(source_size), F.col("t.target").alias(target), F.col("t.slope").alias(slope),
        F.col("t.weight").alias(weight))
    within = Window.partitionBy(key, bucket).orderBy(order, column(id_col), size, tie)
    rows = rows.withColumn(ahead, F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    rows = rows.join(parts, F.col(key).eqNullSafe(F.col(of_source)) & (F.col(bucket) == F.col(of_bucket)))
    begin = F.col(start) + F.col(ahead)
    full = F.when(F.col(source_size) > 0, F.least(F.floor(F.col(target) / F.col(source_size)), F.lit(max_copies))).otherwise(0)
    extra = ((F.col(target) - F.col(whole) * F.col(source_size) > begin + F.col(size) / 2)
             & (F.col(whole) < max_copies)).cast("int")
    rows = rows.withColumn(start, begin).withColumn(whole, full.cast("int")).withColumn(copies, F.col(whole) + extra)
    rows = rows.withColumn(taken, F.col(size) * F.col(copies))
    # A document comes once in every pass over its source, so its next copy begins a pass of words later.
    passes = F.when(F.col(copies) > 0, F.sequence(F.lit(0), F.col(copies) - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn(positions, F.transform(passes, lambda c: _time(
        F.col(start) + c * F.col(source_size), F.col(target), F.col(slope))))
    rows = rows.withColumn(position, F.try_element_at(F.col(positions), F.lit(1)))
    return rows.select(*[column(c) for c in docs.columns if keep_text or c != text_col], *named).orderBy(
        F.asc_nulls_last(position), column(id_col))


def _time(words, target, slope):
    """The time at which a source's integrated demand reaches ``words``.

    The weight at time t is ``target * (1 + slope * (2t - 1))``; its integral, ``target * ((1 - slope) t + slope t**2)``,
    is inverted.
    """
    share = F.when(target > 0, F.least(words / target, F.lit(1.0 - 1e-12))).otherwise(0.0)
    even = 1 - slope
    return F.when(slope == 0, share).otherwise(
        2 * share / (even + F.sqrt(even * even + 4 * slope * share)))


def expand_copies(mixed: DataFrame) -> DataFrame:
    """One row for each copy of a document that ``mix`` takes, in the order of training.

    ``copy`` numbers a document's copies from 0, ``copy_position`` is where the copy begins; rows are range-sorted by it.
    """
    copy, begins = fresh(mixed, "copy", "copy_position")
    out = mixed.select("*", F.posexplode("positions").alias(copy, begins))
    return out.orderBy(begins, *(["doc_id"] if "doc_id" in mixed.columns else []))
