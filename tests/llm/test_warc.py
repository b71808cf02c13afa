import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from incidentlens.llm import queries
from incidentlens.llm import warc as W


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé漢😀\r\n0", max_size=60), st.integers(1, 9))
def test_chunks(text, size):
    payload = text.encode()
    assert W.unchunked(W.chunked(payload, size)) == payload
    parts = list(W.pieces(payload, size))
    assert b"".join(parts) == payload and "".join(p.decode() for p in parts) == text


@pytest.mark.parametrize("broken", [b"", b"5\r\nab\r\n0\r\n\r\n", b"2\r\nab\r\n", b"2\r\nab\r\n0\r\n", b"zz\r\n"])
def test_broken_chunks(broken):
    with pytest.raises(ValueError):
        W.unchunked(broken)


def pages(spark):
    pick = random.Random(6)
    long = "".join(pick.choice("ab é漢\r\n") for _ in range(9000))
    rows = [(1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, "x" * 1000), (4, "u", "x" * 999), (5, "u", "x" * 999),
            (6, "ü\r\nX: y", ""), (7, "u", None), (8, "u", long), (9, "u", long + "!"), (9, "u", long + "!"), (None, "u", long),
            (10, "u", "WARC/1.1\r\n\r\n\r\n" * 300), (11, "u", "é" * 500), (12, "u", "é" * 500), (13, "u", "é" * 499 + "a")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'own' as digest", "'own' as size")


@pytest.mark.parametrize("segment", [300, 64 * 1024])
def test_round_trip(spark, tmp_path, segment):
    df = pages(spark)
    W.write_archives(df, f"{tmp_path}/a", segment_bytes=segment, file_records=7)
    got = W.read_archives(spark, f"{tmp_path}/a").collect()
    want = []
    for r in df.collect():
        payload = (r["html"] or "").encode()
        same = [q["page_id"] for q in df.collect() if (q["html"] or "") == (r["html"] or "") and q["page_id"] is not None]
        revisit = len(payload) >= 1000 and same and r["page_id"] != max(same)
        want.append((r["page_id"], len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                     max(same) if revisit else None, None if revisit else payload))
    assert sorted(map(str, want)) == sorted(str(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
         None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    assert all(r["complete"] for r in got)


def test_lost_segments_are_seen(spark, tmp_path):
    df = pages(spark).where("page_id = 8").coalesce(1)
    W.write_archives(df, f"{tmp_path}/a", segment_bytes=500)
    (file,) = (tmp_path / "a").glob("*.gz")
    records = gzip.decompress(file.read_bytes()).split(b"\r\n\r\nWARC/1.1")
    whole = [records[0]] + [b"WARC/1.1" + r for r in records[1:]]
    for missing in (0, 3, len(whole) - 1):
        folder = tmp_path / f"m{missing}"
        folder.mkdir()
        kept = b"\r\n\r\n".join([r.removesuffix(b"\r\n\r\n") for i, r in enumerate(whole) if i != missing]) + b"\r\n\r\n"
        (folder / "x.warc.gz").write_bytes(gzip.compress(kept))
        (got,) = W.read_archives(spark, str(folder)).collect()
        assert not got["complete"] and got["payload"] is None


def test_order_of_segments_does_not_matter(spark, tmp_path):
    records = list(W.page_records(3, "u", hashlib.sha1(b"abc" * 900).hexdigest(), b"abc" * 900, "response", None, 400))
    random.Random(1).shuffle(records)
    for k, half in enumerate((records[::2], records[1::2])):
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress("".join(r + W.END for r in half).encode()))
    (got,) = W.read_archives(spark, str(tmp_path)).collect()
    assert got["complete"] and bytes(got["payload"]) == b"abc" * 900


def test_empty_table(spark, tmp_path):
    W.write_archives(pages(spark).where("false"), f"{tmp_path}/a")
    assert W.read_archives(spark, f"{tmp_path}/a").collect() == []


def test_query(spark):
    assert queries.op8_warc(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
