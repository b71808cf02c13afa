"""Pages of any depth from an order index.

The rows are written once, cut into ranges of the sort order, and a small table says how many rows each range has and how
many come before it. A page finds the one or two ranges that it lies in and reads those; page 50,000 costs what
page 1 costs, where a plain offset sorts all rows ahead of it.
"""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RANGE_ROWS = 200_000
RANGE = "_range"


def _order(order):
    return [F.desc(c.removeprefix("-")) if c.startswith("-") else F.asc(c) for c in order]


def build_order_index(df: DataFrame, order, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Write ``df`` under ``path`` by ``order``: column names, with a leading ``-`` for falling ones.

    The last column of the order should be a key, so that no two rows are equal in it: pages are then the same in
    every run, and a value that many rows share is cut like any other.
    """
    spark, order = df.sparkSession, list(order)
    n = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(n, *_order(order)).withColumn(RANGE, F.spark_partition_id())
    ranged.sortWithinPartitions(*_order(order)).write.partitionBy(RANGE).parquet(f"{path}/rows")
    sizes = _ranges(spark, path, df.schema).groupBy(RANGE).agg(F.count("*").alias("n"))
    # One row for each range.
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sizes.coalesce(1).write.parquet(f"{path}/ranges")
    about = {"order": order, "schema": df.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{path}/about")


def _ranges(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType(schema.fields + [StructField(RANGE, IntegerType())])).parquet(f"{path}/rows")


def indexed_page(spark: SparkSession, path: str, limit: int, offset: int = 0, where=None, with_total: bool = False) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the index's order; ``total`` counts all rows with ``with_total``.

    ``where`` keeps the rows that satisfy a condition: they are counted by range first (one scan of the condition's
    columns, no sort), and then, too, only the page's ranges are read in full.
    """
    ranges = spark.read.schema(f"{RANGE} int, n bigint, before bigint").parquet(f"{path}/ranges")
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    order, rows = _order(about["order"]), _ranges(spark, path, StructType.fromJson(about["schema"]))
    if where is not None:
        rows = rows.filter(where)
        met = rows.groupBy(RANGE).agg(F.count("*").alias("n"))
        before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        ranges = met.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    here = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
    # A page's ranges: no more than it has rows.
    found = ranges.groupBy().agg(
        F.sort_array(F.collect_list(F.when(here, F.struct(RANGE, "before")))).alias("found"), F.sum("n").alias("total")).first()
    chosen = [r[RANGE] for r in found["found"]]
    skip = offset - found["found"][0]["before"] if chosen else 0
    page = rows.filter(F.col(RANGE).isin(chosen) if chosen else F.lit(False)).drop(RANGE)
    page = page.orderBy(*order).offset(skip).limit(limit) if chosen else page
    return page.withColumn("total", F.lit(found["total"] or 0).cast("bigint")) if with_total else page
