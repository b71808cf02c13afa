import random

import pytest
from pyspark.sql import functions as F

from incidentlens.sources import quoted_csv as Q
from incidentlens.sources import tables as src


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of about 3 kB."""
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(pick):
    kind = pick.randrange(9)
    if kind == 0:
        return ""
    if kind == 1:
        return '"' + "".join(pick.choice(['""', "\n", ",", "x", "\r\n", " "]) for _ in range(pick.randrange(30))) + '"'
    if kind == 2:
        return '5" pipe' if pick.random() < 0.3 else "a b"
    if kind == 3 and pick.random() < 0.05:
        return '"' + "line of a long comment\n" * 400 + '"'
    return f"v{pick.randrange(1000)}"


def expected(spark, path, names, mode="PERMISSIVE"):
    """The whole file by one task of Spark's own reader."""
    schema = ", ".join(f"{c} string" for c in names)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option(
        "mode", mode).option("columnPruning", False).csv(path)


@pytest.mark.parametrize("seed", range(4))
def test_rows_equal_the_read_by_one_task(spark, tmp_path, small_ranges, seed):
    pick = random.Random(seed)
    text = "a,b,c\n" + "".join(",".join([f"k{i}", cell(pick), cell(pick)]) + "\n" for i in range(3000))
    if seed == 1:
        text = text.rstrip("\n")
    if seed == 2:
        text += 'last,"never closed\nby a quote'
    (tmp_path / "t.csv").write_bytes(text.encode())
    path = str(tmp_path / "t.csv")
    got = Q.read_quoted_csv(spark, path, ["a", "b", "c"])
    want = [tuple(r) for r in expected(spark, path, ["a", "b", "c"]).collect()]
    assert [tuple(r)[:3] for r in got.orderBy("seq").collect()] == want
    assert Q._lines(spark, path).rdd.getNumPartitions() > 10
    starts = Q.range_starts(Q.range_ends(Q._lines(spark, path)))
    assert {r["inside"] for r in starts.collect()} == {True, False}  # some ranges begin within a field


def test_malformed_records_and_several_files(spark, tmp_path, small_ranges):
    pick = random.Random(5)
    for k in range(3):
        rows = [f'{k}-{i},"x\ny",{i}' + (",more" if i % 10 == 0 else "") for i in range(400)] + ["short", "", f"{k}-e,,"]
        pick.shuffle(rows)
        (tmp_path / f"f{k}.csv").write_text("id,name,slug\n" + "\n".join(rows) + "\n")
    path = str(tmp_path)
    key = lambda r: tuple((x is not None, x or "") for x in r)
    for on_bad, mode in (("keep", "PERMISSIVE"), ("skip", "DROPMALFORMED")):
        got = Q.read_quoted_csv(spark, path, ["id", "name", "slug"], on_bad).drop("seq")
        want = expected(spark, path, ["id", "name", "slug"], mode)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
        assert got.count() == (1203 if on_bad == "keep" else 1083) + (3 if on_bad == "keep" else 0)


def test_other_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    (tmp_path / "b.csv").write_text("name,id\nx,1\n")
    with pytest.raises(Exception, match="another header"):
        Q.read_quoted_csv(spark, str(tmp_path), ["id", "name"]).collect()


@pytest.mark.parametrize("ranged", [True, False])
def test_table_read_keeps_file_order(spark, tmp_path, small_ranges, monkeypatch, ranged):
    monkeypatch.setattr(src, "RANGED_BYTES", 1000 if ranged else 1 << 30)
    text = "slug,id,name\n" + "".join(f's,{i % 500},"n{i}\nx"\n' for i in range(2000))
    (tmp_path / "m.csv").write_text(text)
    rows = src.read_table(spark, str(tmp_path / "m.csv"), "manufacturers", with_seq=True)
    got = src.dedupe(src.normalize(rows, "manufacturers")).select("id", "name").collect()
    assert {r["id"]: r["name"] for r in got} == {str(i): f"n{i}\nx" for i in range(500)}
    assert src.largest_file(spark, str(tmp_path)) == src.largest_file(spark, str(tmp_path / "*.csv")) == len(text)
    assert src.read_table(spark, str(tmp_path / "m.csv"), "manufacturers", columns=["id"]).agg(F.count("*")).first()[0] == 2000


def test_line_states():
    for line, outside, inside in (('a,"b', True, False), ('a,b"', False, False), ('"a""', True, False), ('a,"b""",c', False, False),
                                  ("", False, True), ('x"y,"z"w,"', True, True), ('"",""', False, True)):
        assert (Q.line_end(line, False), Q.line_end(line, True)) == (outside, inside), line
