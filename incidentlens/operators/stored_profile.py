"""Profiles that are stored for each file and merged when read, so that a new file costs its own scan alone.

For every column of a file the store has its rows, its gaps, a distinct-value sketch and, where values are few, the values.
Sketches and counters merge without the data.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.sources.tables import path_exists

FEW = 64  # the values of a column are stored while a file has no more different ones than about this
STORE = "file string, modified timestamp, column string, rows bigint, missing bigint, sketch binary, few array<string>"


def _files(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def _stored(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(store) if path_exists(spark, store) else spark.createDataFrame([], STORE)


def profile_files(df: DataFrame) -> DataFrame:
    """The entries of all files behind a file scan, in two passes: counters and sketches, then the values of columns with few."""
    columns = df.columns
    named = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified"))
    text = [F.col(f"`{c}`").cast("string") for c in columns]
    counters = named.groupBy("_file", "_modified").agg(
        F.count("*").alias("_rows"), *[F.count_if(t.isNull()).alias(f"_m{i}") for i, t in enumerate(text)],
        *[F.hll_sketch_agg(t).alias(f"_s{i}") for i, t in enumerate(text)])
    entries = counters.select("_file", "_modified", "_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"), F.col(f"_s{i}").alias("sketch"))
        for i, c in enumerate(columns)])).alias("c")).select("_file", "_modified", "_rows", "c.*")
    sizes = entries.groupBy("column").agg(F.max(F.hll_sketch_estimate("sketch")).alias("n")).collect()
    small = [r["column"] for r in sizes if r["n"] <= FEW]  # at most one for each column
    values = named.groupBy("_file", "_modified").agg(*[F.collect_set(F.col(f"`{c}`").cast("string")).alias(f"_v{i}") for i, c in enumerate(small)])
    listed = values.select(F.col("_file").alias("_f"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("_c"), F.col(f"_v{i}").alias("few")) for i, c in enumerate(small)])).alias("v")).select("_f", "v.*") if small else None
    if listed is None:
        out = entries.withColumn("few", F.lit(None).cast("array<string>"))
    else:
        out = entries.join(listed, (F.col("_file") == F.col("_f")) & (F.col("column") == F.col("_c")), "left")
    return out.select(F.col("_file").alias("file"), F.col("_modified").alias("modified"), "column", F.col("_rows").alias("rows"),
                      "missing", "sketch", "few")


def update_profile(spark: SparkSession, path, store: str, format: str = "parquet") -> list[str]:
    """Profile the files under ``path`` that the store lacks (new ones, and changed ones anew); returns them."""
    everything = spark.read.format(format).load(path)
    new = _files(everything).join(_stored(spark, store).select("file", "modified").distinct(), ["file", "modified"], "left_anti")
    names = sorted(r["file"] for r in new.collect())
    if names:
        profile_files(spark.read.schema(everything.schema).format(format).load(names)).write.mode("append").parquet(store)
    return names


def merged_profile(spark: SparkSession, path, store: str, limit: int = 50, show: int = 10, format: str = "parquet") -> DataFrame:
    """``column, rows, missing, percent, distinct_values, exact, first_values`` over the files that ``path`` has now.

    Below ``limit`` different values the number is exact and the first ``show`` are listed; else it is the merged sketches'.
    """
    now = _files(spark.read.format(format).load(path))
    entries = _stored(spark, store).join(F.broadcast(now), ["file", "modified"], "left_semi").dropDuplicates(["file", "modified", "column"])
    merged = entries.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.bool_and(F.col("few").isNotNull()).alias("listed"))
    values = entries.select("column", F.explode("few").alias("value")).distinct()
    few = values.groupBy("column").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("value")).alias("values"))
    out = merged.join(few, "column", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    exact = F.col("listed") & (F.col("n") < limit)
    share = F.round((F.col("missing") * 100 / F.col("rows")).cast("decimal(38,8)"), 1).cast("double")
    return out.select(
        "column", "rows", "missing", F.when(F.col("rows") > 0, share).alias("percent"),
        F.when(exact, F.col("n")).otherwise(F.col("estimate")).alias("distinct_values"), exact.alias("exact"),
        F.when(exact, F.slice(F.coalesce("values", F.array().cast("array<string>")), 1, show)).alias("first_values"))
