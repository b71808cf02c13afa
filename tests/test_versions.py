import json
import os

import pytest
from pyspark.sql import functions as F

from incidentlens import fixed_values as fv
from incidentlens.sources import ledger
from incidentlens.sources import versions as V

SCHEMA = "id string, name string, kind string"


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def stored_files(path, version):
    return {b: files(f"{path}/{folder}") for b, folder in version["folders"].items()}


def test_only_touched_buckets_change(spark, tmp_path):
    path = str(tmp_path / "t")
    first = V.upsert_version(spark, path, spark.range(5000).selectExpr("cast(id as string) id", "concat('n', id) name", "'a' kind"))
    assert first["number"] == 1 and len(first["folders"]) == V.LEAST_BUCKETS and sum(first["rows"].values()) == 5000
    before = stored_files(path, first)
    new = spark.createDataFrame([("7", "renamed", "b"), ("new", "x", "c")], SCHEMA)
    second = V.upsert_version(spark, path, new)
    after = stored_files(path, second)
    changed = {b for b in after if after[b] != before[b]}
    assert 1 <= len(changed) <= 2 and sum(second["rows"].values()) == 5001
    want = {(str(i), f"n{i}", "a") for i in range(5000) if i != 7} | {("7", "renamed", "a"), ("new", "x", "c")}
    assert rows_of(V.read_version(spark, path)) == want
    assert rows_of(V.read_version(spark, path, 1)) == {(str(i), f"n{i}", "a") for i in range(5000)}
    third = V.upsert_version(spark, path, new.filter("1 = 0"))
    assert third["number"] == 2
    assert V.remove_old_versions(spark, path, 1) == 0  # the first folder still holds most buckets
    assert rows_of(V.read_version(spark, path)) == want


def test_old_folders_go(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).selectExpr("cast(id as string) id", "'x' name", "'k' kind")
    for _ in range(3):
        V.upsert_version(spark, path, df, buckets=4)
    assert V.remove_old_versions(spark, path, 1) == 2 and V.read_version(spark, path).count() == 100
    with pytest.raises(Exception):
        V.read_version(spark, path, 1).count()


def test_failed_load_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.upsert_version(spark, path, spark.createDataFrame([("1", "a", "k"), (None, "gap", "k")], SCHEMA), buckets=3)
    before = rows_of(V.read_version(spark, path))
    bad = spark.createDataFrame([("1", "b", "k"), ("2", "c", "k")], SCHEMA)
    commit = V._commit
    monkeypatch.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        V.upsert_version(spark, path, bad)
    assert rows_of(V.read_version(spark, path)) == before and V.current(spark, path)["number"] == 1
    # Another load commits first: this one fails and its rows stay unseen.
    monkeypatch.setattr(V, "_commit", commit)
    stale = V.current(spark, path)
    V.upsert_version(spark, path, bad.filter("id = '2'"))
    with pytest.raises(RuntimeError):
        V._commit(spark, path, dict(stale, number=2))
    assert rows_of(V.read_version(spark, path)) == before | {("2", "c", "k")}
    assert json.load(open(f"{path}/versions/2.json"))["number"] == 2


def scored(spark, ids, batch, level="HIGH"):
    cells = {c: F.lit("x") for c in fv.CATEGORICAL} | {c: F.lit(1.0) for c in fv.NUMERICAL}
    return spark.createDataFrame([(i, i * 10) for i in ids], "id int, user_id int").withColumns(cells).withColumns({
        "prediction": F.lit(1), "prediction_label": F.lit("High Risk"), "risk_score": F.lit(0.7), "risk_percentage": F.lit(70.0),
        "risk_level": F.lit(level), "explanation": F.lit("e"), "maintenance_recommendation": F.lit("m"),
        "risk_factors": F.array(F.struct(F.lit("type").alias("feature"))),
        "features_used": F.array(F.struct(F.lit("type").alias("feature"))), "batch_id": F.lit(batch), "ip_address": F.lit("::1")})


def seen(spark, root):
    p = ledger.read_batches(spark, root, "predictions")
    a = ledger.read_batches(spark, root, "audit")
    return (sorted((r["batch_id"], r["id"]) for r in p.collect()), sorted((r["batch_id"], r["user_id"] // 10) for r in a.collect()))


def test_repeated_batches_add_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    one, two = scored(spark, [1, 2, 3], "one"), scored(spark, [4, 5], "two")
    assert ledger.write_batches(one, root) == 3
    assert ledger.write_batches(one, root) == 0
    assert ledger.write_batches(one.unionByName(two), root) == 2
    want = [("one", 1), ("one", 2), ("one", 3), ("two", 4), ("two", 5)]
    assert seen(spark, root) == (want, want)
    row = ledger.read_batches(spark, root, "audit").first()
    assert row["ip_address"] == "::1" and row["description"].startswith("Risk assessment created for x (x)")
    with pytest.raises(Exception, match="without a batch"):
        ledger.write_batches(one.withColumn("batch_id", F.lit(None).cast("string")), root)


@pytest.mark.parametrize("fails_at", [1, 2])
def test_cut_batches_are_completed(spark, tmp_path, monkeypatch, fails_at):
    """The job is lost before the audit rows, or before the ledger: nothing of the batch shows until it is done again."""
    root = str(tmp_path / "r")
    ledger.write_batches(scored(spark, [1], "one"), root)
    real, calls = ledger._replace, []

    def failing(rows, path):
        calls.append(path)
        if len(calls) > fails_at - 1 and len(calls) == fails_at and fails_at == 1:
            real(rows, path)
            raise OSError("lost after predictions")
        real(rows, path)
        if fails_at == 2 and len(calls) == 2:
            raise OSError("lost after audit")

    monkeypatch.setattr(ledger, "_replace", failing)
    two = scored(spark, [4, 5], "two")
    with pytest.raises(OSError):
        ledger.write_batches(two, root)
    assert seen(spark, root) == ([("one", 1)], [("one", 1)])
    monkeypatch.setattr(ledger, "_replace", real)
    assert ledger.write_batches(two, root) == 2
    want = [("one", 1), ("two", 4), ("two", 5)]
    assert seen(spark, root) == (want, want)


def test_known_batches_leave_before_their_texts_are_made(spark, tmp_path):
    """Texts are made once for every stored row: not again for the audit rows, nor for rows of batches that the ledger has."""
    root, made = str(tmp_path / "r"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text {i}"

    spark.range(9).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids")).select(F.col("id").cast("int"))
    rows = scored(spark, [1], "x").drop("id", "user_id", "ip_address", "batch_id").crossJoin(ids).withColumns({
        "user_id": F.col("id") * 10, "explanation": text("id"), "batch_id": (F.col("id") % 3).cast("string")})
    assert ledger.write_batches(rows.filter("batch_id < 2"), root) == 6 and made.value == 6
    assert ledger.write_batches(rows, root) == 3 and made.value == 9
    assert ledger.write_batches(rows.filter("batch_id = 1"), root) == 0 and made.value == 9
    assert {(r["id"], r["explanation"]) for r in ledger.read_batches(spark, root, "predictions").collect()} == {
        (i, f"text {i}") for i in range(9)}
    assert ledger.read_batches(spark, root, "audit").count() == 9


def test_many_known_batches_are_left_to_the_join(spark, tmp_path, monkeypatch):
    root, one = str(tmp_path / "r"), scored(spark, [1, 2, 3], "one").drop("ip_address")
    both = one.unionByName(scored(spark, [4], "two").drop("ip_address"))
    monkeypatch.setattr(ledger, "FILTERED", 1)
    assert ledger.write_batches(both, root) == 4
    assert ledger.write_batches(both.unionByName(scored(spark, [5], "").drop("ip_address")), root) == 1
    assert ledger.write_batches(both.unionByName(scored(spark, [5], "").drop("ip_address")), root) == 0
    with pytest.raises(Exception, match="without a batch"):
        ledger.write_batches(one.withColumn("batch_id", F.lit(None).cast("string")), root)


def test_files_of_rows_that_grow_are_small(spark, tmp_path):
    from incidentlens.plans.materialize import materialize

    table, seen = materialize(spark.range(95).coalesce(1), folder=str(tmp_path), file_rows=10, rows=F.count(F.lit(1)))
    assert seen["rows"] == 95 and table.count() == 95
    assert len(files(str(tmp_path))) == 10
