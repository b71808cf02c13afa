"""Global order statistics without a single-task sort.

A window over a whole table would put every row into one task. Here equal keys are first
collapsed, keys are cut into ranges of about equal size at approximate quantiles,
each range is summed in its own task, and only the per-range totals (a bounded
number of rows) are accumulated globally.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.plans.materialize import materialize

RANGES = 256
HASH_PREFIX = 4  # hex digits: 65536 hash ranges


def running_totals(df: DataFrame, key: str, sums: dict, group: str | None = None, ranges: int = RANGES) -> DataFrame:
    """One row per distinct ``key`` with each sum and its total over all smaller keys.

    ``sums`` maps an output name to a row-level column; ``<name>_before`` holds the
    total over smaller keys. ``group`` restarts the totals; its distinct values must be few and
    known (column names), because their cut lists are broadcast.
    """
    groups = [group] if group else []
    # Written, as it is read for the cuts and again to be placed in them.
    distinct = materialize(df.groupBy(*groups, key).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    return _totals(distinct, key, sums, groups, ranges)


def _totals(distinct, key, sums, groups, ranges):
    cuts = distinct.groupBy(*groups).agg(
        F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts"))
    if groups:
        # One row per group; joined any other way, all keys of a group would share a task.
        placed = distinct.join(F.broadcast(cuts), groups)
    else:
        placed = distinct.withColumn("_cuts", cuts.scalar())
    placed = placed.withColumn("_range", _position("_cuts", F.col(key), ranges)).drop("_cuts")
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(n).alias(f"_{n}_range") for n in sums])
    # At most ``ranges`` rows per group.
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_range",
        *[F.coalesce(F.sum(f"_{n}_range").over(before), F.lit(0)).alias(f"_{n}_offset") for n in sums])
    within = Window.partitionBy(*groups, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, [*groups, "_range"]).select(
        *groups, key, *sums,
        *[(F.col(f"_{n}_offset") + F.coalesce(F.sum(n).over(within), F.lit(0))).alias(f"{n}_before") for n in sums])


def _position(cuts: str, value, ranges: int):
    """How many of the sorted ``cuts`` are below ``value``: first among every 16th, then within 16."""
    step = 16
    coarse = F.size(F.filter(
        F.transform(F.sequence(F.lit(step), F.lit(max(ranges - 1, step)), F.lit(step)), lambda i: F.try_element_at(cuts, i)),
        lambda b: b < value))
    fine = F.slice(cuts, coarse * step + 1, step)
    return coarse * step + F.size(F.filter(fine, lambda b: b < value))


def exact_quantiles(df: DataFrame, key: str, qs, group: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Linear-interpolated quantiles: one row per (group and) ``q`` with ``value``."""
    groups = [group] if group else []
    known = df.filter(F.col(key).isNotNull())
    distinct = materialize(known.groupBy(*groups, key).agg(F.count("*").alias("n")))
    totals = _totals(distinct, key, ["n"], groups, ranges)
    sizes = distinct.groupBy(*groups).agg(F.sum("n").alias("_size"))
    points = sizes.select(*groups, F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "_size").select(
        *groups, "q", ((F.col("_size") - 1) * F.col("q")).alias("_pos"))
    wanted = points.select(
        *groups, "q", (F.col("_pos") - F.floor("_pos")).alias("_part"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("_pos").alias("rank")),
                          F.struct(F.lit(1).alias("side"), F.ceil("_pos").alias("rank")))).alias("_w"))
    # A wanted rank falls into exactly one key's span; the wanted table has two rows per q and group.
    listed = wanted.groupBy(*groups).agg(F.collect_list(F.struct("q", "_part", "_w.side", "_w.rank")).alias("_wanted"))
    if group:
        joined = totals.join(F.broadcast(listed), group)
    else:
        joined = totals.withColumn("_wanted", listed.scalar())
    hits = joined.withColumn(
        "_hit",
        F.explode(F.filter("_wanted", lambda w: (w["rank"] >= F.col("n_before"))
                           & (w["rank"] < F.col("n_before") + F.col("n")))),
    )
    low = F.max(F.when(F.col("_hit.side") == 0, F.col(key)))
    high = F.max(F.when(F.col("_hit.side") == 1, F.col(key)))
    return hits.groupBy(*groups, F.col("_hit.q").alias("q")).agg(
        (low + (high - low) * F.max("_hit._part")).alias("value"))


def hash_key(id_col, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def hash_cut(df: DataFrame, label: str, cuts: int, rank_of_cut, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Per label, the hash keys that end the first ``rank_of_cut(size, i)`` rows in hash order.

    Returns (label, cut_1 .. cut_cuts): a row belongs to the first i parts when its hash key
    is at most cut_i. Only hash ranges that contain a cut are ever sorted.
    """
    keyed = df.select(label, hash_key(id_col, seed).alias("_h"))
    prefix = F.substring("_h", 1, HASH_PREFIX)
    counts = keyed.groupBy(label, prefix.alias("_p")).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(label).orderBy("_p")
    spans = counts.select(
        label, "_p",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_from"),
        F.sum("_n").over(upto).alias("_to"),
        F.sum("_n").over(Window.partitionBy(label)).alias("_size"),
    )
    marks = spans.select(
        label, "_p", "_from", "_to",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), rank_of_cut(F.col("_size"), i).alias("rank"))
                            for i in range(1, cuts + 1)])).alias("_m"),
    ).filter((F.col("_m.rank") > F.col("_from")) & (F.col("_m.rank") <= F.col("_to")))
    # At most ``cuts`` rows per label.
    needed = marks.select(label, "_p", "_from", "_m.i", "_m.rank")
    edge = keyed.withColumn("_p", prefix).join(F.broadcast(needed.select(label, "_p").distinct()), [label, "_p"])
    ranked = edge.withColumn("_rn", F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h")))
    found = ranked.join(F.broadcast(needed), [label, "_p"]).filter(F.col("_from") + F.col("_rn") == F.col("rank"))
    return found.groupBy(label).agg(
        *[F.max(F.when(F.col("i") == i, F.col("_h"))).alias(f"cut_{i}") for i in range(1, cuts + 1)])
