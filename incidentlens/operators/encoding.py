"""One-hot slots of category columns, with dictionaries of any size.

The dictionary is a table: one row for each (column, value) of the training part with its slot. Values are
numbered in ranges: equal values collapse first (so a hot value is one row before it is shuffled), the distinct ones are cut
into ranges, each range is numbered in its own task, and only the counts of the ranges are accumulated. Rows
meet the dictionary in broadcast joins for the columns whose values are few by measure; in the other columns those values that
hold many rows do (there can only be few of them), so that no task gets all rows of a hot value, and the rest is shuffled.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from incidentlens.plans.materialize import fits_broadcast, materialize

HOT_SHARE = 1000  # a value with more than one in so many cells is hot: at most so many values are


def category_cells(df: DataFrame, cols, *keep) -> DataFrame:
    """One row for each row and column: ``keep``, the column's place in ``cols`` and the value as text."""
    cells = F.array(*[F.struct(F.lit(i).alias("column_no"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    return df.select(*keep, F.explode(cells).alias("c")).select(*[k for k in keep], "c.column_no", "c.value")


def category_dictionary(train: DataFrame, cols) -> DataFrame:
    """``column_no, value, n, place, slot``: the values of each column in byte order.

    ``place`` counts the smaller values of the column, ``slot`` also those of the columns before it, both from 0;
    ``n`` is the number of rows with the value. Gaps are no category. Written once.
    """
    counts = category_cells(train, cols).filter("value is not null").groupBy("column_no", "value").agg(F.count("*").alias("n"))
    ranged = materialize(counts.repartitionByRange("column_no", "value").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("column_no", "_range").agg(F.count("*").alias("_size"))
    # As many rows as the session has shuffle partitions, and one more for each column.
    before = sizes.groupBy().agg(F.sort_array(F.collect_list(F.struct("column_no", "_range", "_size"))).alias("s"))
    total = lambda rows: F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x["_size"])
    starts = before.select(F.explode(F.transform("s", lambda x, i: F.struct(
        x["column_no"].alias("column_no"), x["_range"].alias("_range"),
        total(F.slice("s", F.lit(1), i)).alias("_slots"),
        total(F.filter(F.slice("s", F.lit(1), i), lambda y: y["column_no"] == x["column_no"])).alias("_places")))).alias("x")).select("x.*")
    within = F.row_number().over(Window.partitionBy("column_no", "_range").orderBy("value")) - 1
    numbered = ranged.withColumn("_nth", within).join(F.broadcast(starts), ["column_no", "_range"])
    return materialize(numbered.select(
        "column_no", "value", "n", (F.col("_places") + F.col("_nth")).alias("place"),
        (F.col("_slots") + F.col("_nth")).alias("slot")))


def encoded(df: DataFrame, dictionary: DataFrame, cols, number: str = "slot") -> DataFrame:
    """All columns of ``df`` and ``slots``: for each column of ``cols`` its slot (or ``place``), null for values that the
    dictionary lacks.

    Columns whose values together are within the broadcast bounds, the smallest first, meet them in broadcast joins;
    the cells of the others are shuffled.
    """
    sizes = {r["column_no"]: r for r in dictionary.groupBy("column_no").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes")).collect()}
    narrow, held = [], {"rows": 0, "bytes": 0}
    for i in sorted(range(len(cols)), key=lambda i: (sizes[i]["bytes"], i) if i in sizes else (0, i)):
        held = {k: held[k] + sizes[i][k] for k in held} if i in sizes else held
        if not fits_broadcast(held):
            break
        narrow.append(i)
    out = df
    for i in narrow:
        part = dictionary.where(F.col("column_no") == i).select(F.col("value").alias("_value"), F.col(number).alias(f"_slot_{i}"))
        out = out.join(F.broadcast(part), F.col(cols[i]).cast("string") == F.col("_value"), "left").drop("_value")
    wide = [i for i in range(len(cols)) if i not in narrow]
    if wide:
        out = _shuffled(out, dictionary, cols, wide, number)
    slots = [F.col(f"_slot_{i}") if i in narrow else F.col("_found")[wide.index(i)] for i in range(len(cols))]
    return out.select(*df.columns, F.array(*slots).alias("slots"))


def _shuffled(df: DataFrame, dictionary: DataFrame, cols, wide: list[int], number: str) -> DataFrame:
    """All columns of ``df`` and ``_found``: the slots (or places) of its columns ``wide``, null where there is none.

    The rows are shuffled once, by a number of their own; a null or repeated id does no harm.
    """
    names = df.columns
    dictionary = dictionary.where(F.col("column_no").isin(wide)).withColumn(
        "column_no", F.array_position(F.array(*map(F.lit, wide)), F.col("column_no")).cast("int") - 1)
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    whole = F.struct(*[F.col(c) for c in names])
    cells = category_cells(rows.withColumn("_whole", whole), [cols[i] for i in wide], "_row", "_whole")
    # A row's other columns travel once, with its first cell.
    cells = cells.withColumn("_whole", F.when(F.col("column_no") == 0, F.col("_whole")))
    total = dictionary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT_SHARE > total
    entry = lambda part, name: part.select("column_no", "value", F.col(number).alias(name))
    met = cells.join(F.broadcast(entry(dictionary.where(is_hot), "_hot")), ["column_no", "value"], "left")
    rest = met.filter("_hot is null and value is not null").join(
        entry(dictionary.where(~is_hot), "_cold"), ["column_no", "value"], "left").select("_row", "_whole", "column_no", "_cold")
    found = met.filter("_hot is not null or value is null").select("_row", "_whole", "column_no", F.col("_hot").alias("_cold"))
    slots = F.transform(F.sort_array(F.collect_list(F.struct("column_no", "_cold"))), lambda x: x["_cold"])
    return rest.unionByName(found).groupBy("_row").agg(
        F.first("_whole", ignorenulls=True).alias("_whole"), slots.alias("_found")).select("_whole.*", "_found")


def onehot_ignore_unknown(df: DataFrame, dictionary: DataFrame, cols, id_col: str = "id") -> DataFrame:
    """``id, slots``: the places of the ones in each row's one-hot vector, rising; unseen values and gaps set none."""
    out = encoded(df.select(id_col, *cols), dictionary, cols)
    return out.select(id_col, F.array_sort(F.filter("slots", lambda s: s.isNotNull())).alias("slots"))
