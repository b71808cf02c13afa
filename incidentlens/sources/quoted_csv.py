"""CSV files with quoted line breaks, read by as many tasks as the files have ranges.

A line break may lie inside a quoted field, so where records begin isn't known before everything ahead was read. Each
range of whole lines is therefore summed up as a function: whether its end lies inside a quoted field if its start lies
outside, and if its start lies inside. The functions of a file's ranges are combined from the front, which tells how each
range really starts. The ranges are then read again and cut into records; a record that crosses ranges is put together
from its pieces, and Spark's own ``from_csv`` parses the records.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incidentlens.plans.materialize import materialize
from incidentlens.plans.workers import ship

# The rest of a quoted field with its closing quote; a doubled quote is a character.
_CLOSE = re.compile(r'(?:[^"]++|"")*+"')


def line_end(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a line ends inside a quoted field, given whether it starts inside one.

    Only a quote at the beginning of a field opens one; what follows a closing quote belongs to the field up to the next
    delimiter.
    """
    at = 0
    while True:
        if inside or line.startswith('"', at):
            close = _CLOSE.match(line, at if inside else at + 1)
            if close is None:
                return True
            inside, at = False, close.end()
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path) -> DataFrame:
    """``value, file, block``: the lines of all files; the lines of a range come in order, in one task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch):
    """Stretches of one (file, block) within a batch: ``(file, block, first, end)``."""
    n = batch.num_rows
    if not n:
        return
    cut = np.zeros(n, bool)
    for name in ("file", "block"):
        values = batch.column(name)
        cut[1:] |= pc.not_equal(values.slice(1), values.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    begins = [0, *np.flatnonzero(cut).tolist()]
    for lo, hi in zip(begins, [*begins[1:], n]):
        yield batch.column("file")[lo].as_py(), batch.column("block")[lo].as_py(), lo, hi


def range_ends(lines: DataFrame, sep: str = ",") -> DataFrame:
    """``file, block, if_outside, if_inside``: how each range ends for both ways in which it may start."""
    def run(batches):
        now = None
        for batch in batches:
            quoted = pc.match_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False)
            values = batch.column("value")
            for file, block, lo, hi in _runs(batch):
                if now is None or now[:2] != [file, block]:
                    if now is not None:
                        yield _row(now)
                    now = [file, block, False, True]
                # A line without a quote ends as it starts.
                for line in values.slice(lo, hi - lo).filter(pa.array(quoted[lo:hi])).to_pylist():
                    now[2], now[3] = line_end(line, now[2], sep), line_end(line, now[3], sep)
        if now is not None:
            yield _row(now)

    def _row(now):
        return pa.RecordBatch.from_pylist([dict(zip(("file", "block", "if_outside", "if_inside"), now))])

    ship(lines.sparkSession)
    return lines.mapInArrow(run, "file string, block bigint, if_outside boolean, if_inside boolean")


def range_starts(ends: DataFrame) -> DataFrame:
    """``file, block, inside``: whether each range starts inside a quoted field, from the ranges before it in the file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda inside, x: F.when(inside, x["if_inside"]).otherwise(x["if_outside"])
    return ends.select("file", "block", F.aggregate(
        F.collect_list(F.struct("if_outside", "if_inside")).over(before), F.lit(False), step).alias("inside"))


def read_records(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """``file, block, row, record``: the text of every record; ``block`` and ``row`` order the records of a file."""
    lines = _lines(spark, path)
    starts = materialize(range_starts(range_ends(lines, sep)))
    # One row for each range of a file; broadcast, so that lines stay in their task and in their order.
    placed = lines.join(F.broadcast(starts.filter("inside")), ["file", "block"], "left")

    def run(batches):
        names = ["file", "block", "row", "kind", "record"]
        file = block = None
        row, inside, held, kind = 0, False, [], "whole"

        def rows(records, kinds):
            nonlocal row
            n = len(records)
            out = pa.RecordBatch.from_arrays(
                [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()),
                 pa.array(kinds, pa.string()), pa.array(records, pa.string())], names=names)
            row += n
            return out

        for batch in batches:
            values, begins = batch.column("value"), batch.column("inside")
            quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
            for f, b, lo, hi in _runs(batch):
                if (f, b) != (file, block):
                    if held:  # the range before ends within a record
                        yield rows(["\n".join(held)], ["middle" if kind == "tail" else "head"])
                    file, block, row, held = f, b, 0, []
                    inside = bool(begins[lo].as_py())
                    kind = "tail" if inside else "whole"
                records, kinds = [], []
                for line, has_quote in zip(values.slice(lo, hi - lo).to_pylist(), quoted[lo:hi].tolist()):
                    if has_quote:
                        inside = line_end(line, inside, sep)
                    held.append(line)
                    if not inside:
                        records.append("\n".join(held) if len(held) > 1 else line)
                        kinds.append(kind)
                        held, kind = [], "whole"
                if records:
                    yield rows(records, kinds)
        if held:
            yield rows(["\n".join(held)], ["middle" if kind == "tail" else "head"])

    ship(spark)
    pieces = placed.mapInArrow(run, "file string, block bigint, row bigint, kind string, record string")
    # Pieces are few: at most two for each range. A head owns the pieces up to the next tail.
    cut = materialize(pieces)
    order = Window.partitionBy("file").orderBy("block", "row")
    owner = F.last(F.when(F.col("kind") == "head", F.struct("block", "row")), ignorenulls=True).over(order)
    joined = cut.filter("kind <> 'whole'").withColumn("owner", owner).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("block", "row", "record"))).alias("parts"))
    joined = joined.select("file", "owner.block", "owner.row",
                           F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return cut.filter("kind = 'whole'").select("file", "block", "row", "record").unionByName(joined)


def read_quoted_csv(spark: SparkSession, path, names: list[str], on_bad: str = "keep", sep: str = ",") -> DataFrame:
    """All columns as text, by the header ``names``, and ``seq``, the file order of the rows.

    The first record of each file is its header and must be ``names``; a file with another header fails. Empty lines are
    no records. Records with too few or too many fields keep what they have, or go with ``on_bad="skip"``. A
    quoted field that no quote closes reaches to the end of its file.
    """
    options = {"escape": '"', "sep": sep, "multiLine": "true", "columnNameOfCorruptRecord": "_malformed", "mode": "PERMISSIVE",
               "maxCharsPerColumn": "-1"}
    schema = ", ".join(f"`{c}` string" for c in names)
    records = read_records(spark, path, sep).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    parsed = records.filter("record <> ''").withColumn("p", F.from_csv("record", schema + ", _malformed string", options))
    first = (F.col("block") == 0) & (F.col("row") == 0)
    same = F.array(*[F.col("p")[c] for c in names]) == F.array(*[F.lit(c) for c in names])
    wrong = F.raise_error(F.concat(F.lit("another header in "), "file")).cast("boolean")
    parsed = parsed.filter(F.when(~first, F.lit(True)).when(F.coalesce(same, F.lit(False)), F.lit(False)).otherwise(wrong))
    if on_bad == "skip":
        parsed = parsed.filter(F.col("p._malformed").isNull())
    return parsed.select(*[F.col("p")[c].alias(c) for c in names], F.struct("file", "block", "row").alias("seq"))
