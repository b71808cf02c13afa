"""Dataset inspection: every statistic for all columns in one pass."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile_schema(df: DataFrame) -> DataFrame:
    """Column names and types; reads no data."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema.fields)])
    return df.sparkSession.range(1).select(F.explode(fields).alias("f")).select("f.*")


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def file_sizes(df: DataFrame) -> DataFrame:
    """Size of the files behind a file scan."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def profile_missing(df: DataFrame) -> DataFrame:
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    per_column = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(df.columns)])
    share = F.round((F.col("c.missing") * 100 / F.col("_rows")).cast("decimal(38,8)"), 1).cast("double")
    return counts.select("_rows", F.explode(per_column).alias("c")).select(
        "c.column", "c.missing", F.when(F.col("_rows") > 0, share).alias("percent"))


def profile_sample(df: DataFrame, order_by, n: int = 2) -> DataFrame:
    order_by = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*order_by).limit(n)


def profile_distinct(df: DataFrame, limit: int = 50, show: int = 10, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column; below ``limit`` also the first ``show`` in order.

    The exact form turns the columns into (column, value) rows and combines equal ones
    before the shuffle. ``approx`` needs one sketch per column and no row shuffle.
    """
    if approx:
        sketches = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)])
        return sketches.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("distinct_values"))
            for i, c in enumerate(df.columns)])).alias("c")).select("c.*")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    values = (
        df.select(F.explode(cells).alias("c")).select("c.*").distinct()
    )
    counts = values.groupBy("column").agg(F.count("value").alias("distinct_values"))
    order = Window.partitionBy("column").orderBy("value")
    firsts = (
        values.filter("value is not null")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= show)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("first_values"))
    )
    listed = F.when(F.col("distinct_values") < limit, F.coalesce("first_values", F.array().cast("array<string>")))
    return counts.join(firsts, "column", "left").select("column", "distinct_values", listed.alias("first_values"))
