import random

import pytest
from pyspark.sql import functions as F

from incidentlens.operators import aggregates, history, paging, stored_profile
from incidentlens.plans import maintained
from incidentlens.sources import versions

EVENTS = "id string, device_id string, type string, status string, country string, event_year int, event_month int"


def events(pick, ids):
    return {i: (str(i), pick.choice([None, "d1", "d2", "d3"]), pick.choice(["Recall", "Safety alert", None]), "Completed",
                pick.choice(["USA", "DEU"]), pick.choice([None, 1900, 2019, 2020, 2021]), pick.randint(1, 12)) for i in ids}


def test_cube_after_batches_equals_recount(spark, tmp_path):
    """New, changed and removed events in three batches, each sent twice."""
    pick, path = random.Random(3), str(tmp_path / "cube")
    frame = lambda rows: spark.createDataFrame(list(rows), EVENTS)
    state = events(pick, range(400))
    assert maintained.apply_batch(spark, path, "b1", now=frame(state.values()), buckets=8)
    changed = events(pick, range(0, 100))
    added = events(pick, range(400, 450))
    removed = [state[i] for i in range(300, 400)]
    was = [state[i] for i in changed]
    for i in range(300, 400):
        del state[i]
    state |= changed | added
    for again in (True, False):
        assert maintained.apply_batch(spark, path, "b2", frame([*changed.values(), *added.values()]), frame([*was, *removed])) == again
    assert maintained.apply_batch(spark, path, "b3", before=frame(state[i] for i in range(50)))
    for i in range(50):
        del state[i]
    cube, now = maintained.cube_rows(spark, path), frame(state.values())
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(maintained.yearly_history_of(cube)) == rows(history.device_yearly_history(now))
    assert rows(maintained.device_counts_of(cube)) == rows(aggregates.count_by_device(now))
    assert maintained.totals_of(cube).first()["total_events"] == len(state)
    assert cube.filter("n <= 0").count() == 0
    gone = frame(state.values())
    maintained.apply_batch(spark, path, "b4", before=gone)
    assert maintained.cube_rows(spark, path).count() == 0 and versions.current(spark, path)["folders"] == {}
    maintained.apply_batch(spark, path, "b5", now=gone)
    assert rows(maintained.device_counts_of(maintained.cube_rows(spark, path))) == rows(aggregates.count_by_device(gone))


def test_small_batch_touches_few_buckets(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = events(random.Random(1), range(2000))
    maintained.apply_batch(spark, path, "a", spark.createDataFrame(list(rows.values()), EVENTS), buckets=32)
    before = versions.current(spark, path)["folders"]
    maintained.apply_batch(spark, path, "b", spark.createDataFrame([rows[5]], EVENTS))
    after = versions.current(spark, path)["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_a_batch_is_merged_in_one_shuffle(spark, tmp_path, monkeypatch):
    """The cube holds its columns and counts alone, and its rows and a batch's move once, to their buckets."""
    path, plans = str(tmp_path / "cube"), []
    added = maintained._added

    def seen(target, updates):
        plans.append(added(target, updates))
        return plans[-1]

    monkeypatch.setattr(maintained, "_added", seen)
    rows = list(events(random.Random(2), range(300)).values())
    for batch in ("a", "b"):
        maintained.apply_batch(spark, path, batch, spark.createDataFrame(rows, EVENTS), buckets=8)
    assert versions.read_version(spark, path).columns == [*maintained.CUBE, "n"]
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert maintained.cube_rows(spark, path).agg(F.sum("n")).first()[0] == 600


def test_a_cube_with_keys_takes_batches(spark, tmp_path):
    """One stored when cubes were bucketed by all their columns as a text."""
    path = str(tmp_path / "cube")
    rows = spark.createDataFrame(list(events(random.Random(4), range(200)).values()), EVENTS)
    counts = maintained.signed_counts(rows, None)
    keyed = counts.withColumn("cube_key", F.to_json(F.struct(*maintained.CUBE), {"ignoreNullFields": "false"}))
    versions.upsert_version(spark, path, keyed, "cube_key", buckets=8, notes=["a"])
    assert maintained.apply_batch(spark, path, "b", rows) and not maintained.apply_batch(spark, path, "b", rows)
    want = {tuple(r)[:-1]: 2 * r["n"] for r in counts.collect()}
    assert {tuple(r)[:-1]: r["n"] for r in maintained.cube_rows(spark, path).collect()} == want


@pytest.fixture
def indexed(spark, tmp_path):
    df = spark.range(10_000).selectExpr("id", "concat('n', (id * 7919) % 311) as name", "id % 3 as kind")
    paging.build_order_index(df, ["name", "-id"], str(tmp_path / "ix"), range_rows=700)
    want = sorted(((r["id"], r["name"], r["kind"]) for r in df.collect()), key=lambda r: (r[1], -r[0]))
    return str(tmp_path / "ix"), want


def test_pages_read_their_ranges(spark, indexed):
    path, want = indexed
    for limit, offset in ((20, 0), (20, 5000), (100, 690), (2000, 3000), (20, 9990), (20, 10_000)):
        page = paging.indexed_page(spark, path, limit, offset, with_total=True)
        assert [tuple(r)[:3] for r in page.collect()] == want[offset:offset + limit]
        assert all(r["total"] == 10_000 for r in page.collect())
    assert len(set(spark.read.parquet(f"{path}/ranges").collect())) > 10


def test_one_range_is_scanned(spark, indexed):
    path, _ = indexed
    page = paging.indexed_page(spark, path, 20, 5000)
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text
    counted = page._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    whole = spark.read.parquet(f"{path}/rows")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(counted)) < int(str(whole)) / 4


def test_filtered_pages(spark, indexed):
    path, want = indexed
    some = [r for r in want if r[2] == 1 and "1" in r[1]]
    for offset in (0, 500, len(some) - 5, len(some) + 3):
        page = paging.indexed_page(spark, path, 20, offset, where="kind = 1 and name like '%1%'", with_total=True)
        assert [tuple(r)[:3] for r in page.collect()] == some[offset:offset + 20]
        assert all(r["total"] == len(some) for r in page.collect())
    assert paging.indexed_page(spark, path, 20, 0, where="kind = 9").count() == 0


def test_pages_of_an_empty_index(spark, tmp_path):
    paging.build_order_index(spark.createDataFrame([], "id bigint, name string"), ["name", "id"], str(tmp_path / "ix"))
    page = paging.indexed_page(spark, str(tmp_path / "ix"), 20, 0, with_total=True)
    assert page.columns == ["id", "name", "total"] and page.collect() == []


def test_new_files_alone_are_profiled(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    part = lambda lo, hi: spark.range(lo, hi).selectExpr(
        "id", "concat('k', id % 40) as few", "case when id % 4 = 0 then null else cast(id * 7 as string) end as many",
        "cast(null as string) as none").coalesce(1)
    part(0, 20_000).write.parquet(data)
    assert len(stored_profile.update_profile(spark, data, store)) == 1
    assert stored_profile.update_profile(spark, data, store) == []
    part(10_000, 50_000).write.mode("append").parquet(data)
    assert len(stored_profile.update_profile(spark, data, store)) == 1
    got = {r["column"]: r for r in stored_profile.merged_profile(spark, data, store).collect()}
    assert {c: (r["rows"], r["missing"]) for c, r in got.items()} == {
        "id": (60_000, 0), "few": (60_000, 0), "many": (60_000, 15_000), "none": (60_000, 60_000)}
    assert got["few"]["exact"] and got["few"]["distinct_values"] == 40
    assert got["few"]["first_values"] == sorted(f"k{i}" for i in range(40))[:10]
    assert got["none"]["distinct_values"] == 0 and got["none"]["first_values"] == []
    for c, n in (("id", 50_000), ("many", 37_500)):
        assert not got[c]["exact"] and got[c]["distinct_values"] == pytest.approx(n, rel=0.05)
    # A store that has an entry twice, as after a repeated append, counts it once.
    spark.read.parquet(store).limit(2).write.mode("append").parquet(store)
    assert stored_profile.merged_profile(spark, data, store).agg(F.max("rows")).first()[0] == 60_000
