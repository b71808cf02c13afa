import pytest

from incidentlens import schemas
from incidentlens.sources import tables as src
from incidentlens.sources.versions import read_version


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read_quoted_breaks_and_column_order(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'name,id,extra\n"A ""x""\nB",1,z\n,2,z\n')
    rows = src.read_table(spark, path, "manufacturers").orderBy("id").collect()
    assert rows[0]["name"] == 'A "x"\nB' and rows[1]["name"] is None and rows[0]["slug"] is None
    assert list(rows[0].asDict()) == schemas.raw_columns("manufacturers")


def test_skip_malformed(spark, tmp_path):
    path = write(tmp_path / "e.csv", "id,device_id,type\n1,9,Recall\n2,9,Recall,too,many\n3,8,Alert\n")
    rows = src.read_table(spark, path, "events", columns=["device_id", "type"], on_bad="skip").collect()
    assert sorted(tuple(r) for r in rows) == [("8", "Alert"), ("9", "Recall")]


def test_normalize_and_dedupe_keep_first(spark, tmp_path):
    long = "n" * 600
    path = write(tmp_path / "d.csv", f"id,name,quantity_in_commerce\n 7 ,{long},12\n7,second,3\n8,,oops\n")
    rows = src.read_table(spark, path, "devices", with_seq=True)
    got = {r["id"]: r for r in src.dedupe(src.normalize(rows, "devices")).collect()}
    assert set(got) == {"7", "8"}
    assert len(got["7"]["name"]) == 500 and got["7"]["quantity_in_commerce"] == 12.0
    assert got["8"]["name"] is None and got["8"]["quantity_in_commerce"] is None


def test_event_load_derives_year_and_month(spark):
    df = spark.createDataFrame([("1", "2020-03-04"), ("2", "later")], "id string, date string")
    rows = {r["id"]: r for r in src.normalize(df, "events").collect()}
    assert (rows["1"]["event_year"], rows["1"]["event_month"], rows["2"]["event_year"]) == (2020, 3, None)


def test_upsert_updates_only_named_column(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", None)], "id string, name string, slug string")
    new = spark.createDataFrame([("2", None, "new"), ("3", "c", "y")], "id string, name string, slug string")
    got = {tuple(r) for r in src.upsert(old, new).collect()}
    assert got == {("1", "a", "x"), ("2", None, None), ("3", "c", "y")}


def test_load_skips_current_target(spark, tmp_path):
    csv = write(tmp_path / "m.csv", "id,name\n1,a\n1,b\n2,c\n")
    target = str(tmp_path / "table")
    assert src.load(spark, csv, target, "manufacturers") == 2
    assert src.load(spark, csv, target, "manufacturers") == 0
    more = write(tmp_path / "m2.csv", "id,name\n1,renamed\n3,d\n4,e\n")
    assert src.load(spark, more, target, "manufacturers") == 4
    got = {r["id"]: r["name"] for r in read_version(spark, target).collect()}
    assert got == {"1": "renamed", "2": "c", "3": "d", "4": "e"}


def test_audit_text(spark):
    df = spark.createDataFrame(
        [(1, "Acme", "Cardio", "HIGH", 62.5)],
        "user_id int, name_manufacturer string, classification string, risk_level string, risk_percentage double")
    row = src.audit_rows(df).first()
    assert row["description"] == "Risk assessment created for Acme (Cardio) - Result: HIGH (62.5%)"
    assert row["action"] == "PREDICTION_CREATED"


def test_reload_needs_a_predicting_model(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError):
        src.load_model(str(tmp_path / "m"))


def test_scratch_tables_are_removed(spark, tmp_path):
    from incidentlens.plans import materialize as M

    with M.scratch(spark) as folder:
        inner = M.materialize(spark.range(5))
        kept = M.materialize(inner.selectExpr("id * 2 as id"), folder=str(tmp_path))
        assert folder in inner.inputFiles()[0] and str(tmp_path) in kept.inputFiles()[0]
    assert not src.path_exists(spark, folder) and sorted(r[0] for r in kept.collect()) == [0, 2, 4, 6, 8]
    assert folder not in M.materialize(spark.range(2)).inputFiles()[0]
