"""Tables in hash buckets with committed versions: an upsert reads and replaces only the buckets that its keys fall into.

A version is one small file that names, for every bucket, the folder that holds it. New folders are written first and the
version file last, so a load that fails on the way leaves the table as it was, and readers never see half of one.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from incidentlens.plans.materialize import materialize

BUCKET_ROWS = 500_000  # a new table gets a bucket for about so many rows
LEAST_BUCKETS = 16
BUCKET = "_bucket"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def current(spark: SparkSession, path: str) -> dict | None:
    """The committed version with the highest number; None where there is no table."""
    fs, folder = _files(spark, f"{path}/versions")
    if not fs.exists(folder):
        return None
    numbers = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removesuffix(".json")) for n in numbers if n.endswith(".json") and n[0].isdigit()]
    return _version(spark, path, max(numbers)) if numbers else None


def _version(spark: SparkSession, path: str, number: int) -> dict:
    text = spark.read.option("wholetext", True).text(f"{path}/versions/{number}.json").first()[0]
    return json.loads(text)


def read_version(spark: SparkSession, path: str, number: int | None = None, buckets=None) -> DataFrame:
    """The rows of a version (the current one unless given), or of some of its buckets."""
    version = current(spark, path) if number is None else _version(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    schema = StructType.fromJson(version["schema"])
    chosen = version["folders"] if buckets is None else {b: f for b, f in version["folders"].items() if int(b) in buckets}
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in chosen.values()])


def _commit(spark: SparkSession, path: str, version: dict) -> None:
    """Put the version file in place; fails if another load has committed that number."""
    fs, final = _files(spark, f"{path}/versions/{version['number']}.json")
    _, draft = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(version).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {version['number']} of {path} was committed by another load")


def merged_rows(target: DataFrame, updates: DataFrame, key: str, set_cols) -> DataFrame:
    """``target`` with its known keys' ``set_cols`` replaced and new keys added."""
    new = updates.select([F.col(c).alias(f"_new_{c}") for c in target.columns] + [F.lit(True).alias("_in")])
    old = target.withColumn("_had", F.lit(True))
    joined = old.join(new, F.col(key) == F.col(f"_new_{key}"), "full_outer")

    def pick(c):
        if c in set_cols:
            return F.when(F.col("_in"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_had"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)

    return joined.select([pick(c) for c in target.columns])


def upsert_version(spark: SparkSession, path: str, updates: DataFrame, key: str = "id", set_cols=("name",),
                   buckets: int | None = None, merge=None, notes: dict | None = None) -> dict:
    """Merge ``updates`` (one row for each key) into the table at ``path`` and commit a version; returns it.

    New keys are added, known keys get ``set_cols`` only. Without a table the updates are its first version, in ``buckets``
    buckets (by the number of rows unless given). Only buckets that updates fall into are read and written again; the
    folders of the others are named as before. ``merge(target, updates)`` replaces the rule for touched buckets; it gets both with
    the column ``BUCKET`` and returns the rows with it, those of a bucket together; ``notes`` are kept in the version.
    """
    path, old = path.rstrip("/"), current(spark, path.rstrip("/"))
    updates, seen = materialize(updates, rows=F.count(F.lit(1)))
    if old is None:
        n = buckets or max(LEAST_BUCKETS, -(-seen["rows"] // BUCKET_ROWS))
        old = {"number": 0, "buckets": n, "key": key, "folders": {}, "rows": {}, "schema": updates.schema.jsonValue()}
    if old["key"] != key:
        raise ValueError(f"{path} is bucketed by {old['key']}")
    schema = StructType.fromJson(old["schema"])
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(old["buckets"])).cast("int")
    updates = updates.select([F.col(f.name).cast(f.dataType) for f in schema] + [bucket.alias(BUCKET)])
    # At most as many values as the table has buckets.
    touched = {r[0] for r in updates.select(BUCKET).distinct().collect()}
    if not touched and not notes:
        return old
    known = touched & {int(b) for b in old["folders"]}
    if known and merge:
        rows = merge(read_version(spark, path, old["number"], touched).withColumn(BUCKET, bucket), updates)
    else:
        rows = updates.drop(BUCKET)
        if known:
            rows = merged_rows(read_version(spark, path, old["number"], touched), rows, key, set_cols)
        rows = rows.withColumn(BUCKET, bucket).repartition(BUCKET)
    folder = f"data/{old['number'] + 1}-{uuid.uuid4().hex}"
    rows.write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    written = spark.read.schema(StructType(schema.fields + [StructField(BUCKET, IntegerType())])).parquet(f"{path}/{folder}")
    counts = {r[0]: r[1] for r in written.groupBy(BUCKET).count().collect()}
    keep = [b for b in old["folders"] if int(b) not in touched]  # a touched bucket may have lost all its rows
    version = dict(old, number=old["number"] + 1, notes=notes if notes is not None else old.get("notes"),
                   folders={b: old["folders"][b] for b in keep} | {str(b): f"{folder}/{BUCKET}={b}" for b in counts},
                   rows={b: old["rows"][b] for b in keep} | {str(b): n for b, n in counts.items()})
    _commit(spark, path, version)
    return version


def remove_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` versions, and folders that none of those names; returns the folders deleted.

    To be run when no load is under way, as that one's folder has no version yet.
    """
    path, last = path.rstrip("/"), current(spark, path.rstrip("/"))
    fs, folder = _files(spark, f"{path}/versions")
    numbers = sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder)
                     if s.getPath().getName().endswith(".json"))
    kept, gone = numbers[-keep:], numbers[:-keep]
    needed = {f.split("/")[1] for n in kept for f in _version(spark, path, n)["folders"].values()} if last else set()
    for n in gone:
        fs.delete(_files(spark, f"{path}/versions/{n}.json")[1], False)
    deleted = 0
    for s in fs.listStatus(_files(spark, f"{path}/data")[1]):
        if s.getPath().getName() not in needed:
            fs.delete(s.getPath(), True)
            deleted += 1
    return deleted
