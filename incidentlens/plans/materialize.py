"""Cut lineage with a written table in the cluster's shared checkpoint folder.

A written table survives the loss of executors and gives Catalyst true sizes,
so that the joins after it are planned on facts.
"""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Upper bounds of a table we broadcast ourselves.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024

_local_dir = None
_scratch = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside go to a folder of their own, which is removed at the end.

    For a job whose result has been written elsewhere by then, with ``materialize(..., folder=...)``.
    """
    folder = f"{shared_dir(spark)}/incidentlens-run-{uuid.uuid4().hex}"
    _scratch.append(folder)
    try:
        yield folder
    finally:
        _scratch.remove(folder)
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written for intermediate tables, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="incidentlens-")
    return _local_dir


def materialize(df: DataFrame, folder: str | None = None, file_rows: int = 0, **metrics):
    """Write ``df`` and return the written table, in ``folder`` or else that of the innermost ``scratch`` or the shared one.

    With ``metrics`` (bounded aggregates over its rows) also their values, taken during the
    write itself: ``(table, values)``. ``file_rows`` limits the rows of a file, for tables whose rows become much larger
    when they are read: what compresses well is one row group of millions of rows, which one task reads alone.
    """
    spark = df.sparkSession
    path = f"{folder or (_scratch[-1] if _scratch else shared_dir(spark))}/incidentlens-{uuid.uuid4().hex}"
    seen = Observation() if metrics else None
    out = df.observe(seen, *[c.alias(n) for n, c in metrics.items()]) if metrics else df
    out.write.option("maxRecordsPerFile", file_rows).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return (table, seen.get) if metrics else table


def size_metrics(*text_columns) -> dict:
    """Metrics for ``fits_broadcast``: rows and bytes of text."""
    length = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), F.lit(0))
    return {"rows": F.count(F.lit(1)), "bytes": F.coalesce(F.sum(length), F.lit(0))}


def fits_broadcast(sizes: dict) -> bool:
    """Check the real size of a written table against the broadcast bounds."""
    return sizes["rows"] <= BROADCAST_ROWS and sizes["bytes"] <= BROADCAST_BYTES
