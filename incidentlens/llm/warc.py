"""WARC archives of pages: writing with revisits, segments and chunked framing, and reassembly of what was written.

A block longer than ``SEGMENT_BYTES`` continues in continuation records, which may lie in other files. Reading groups
them by the identifier of their origin, orders them by segment number, checks the total length and takes the
chunked transfer framing off. Files are written and listed by Spark, so the folder can be in any store. Each
holds at most ``FILE_RECORDS`` records of ``SEGMENT_BYTES``, which bounds what a task reads at once.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.frames import column, map_arrow

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
FILE_RECORDS = 2000
REVISIT_BYTES = 1000  # shorter payloads are written again
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def new_folder(shared: str) -> str:
    """A name for a folder of archives in the shared folder."""
    return f"{shared}/warc-{uuid.uuid4().hex}"


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Cut UTF-8 bytes into pieces of at most ``size`` (or one character) that end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if body[at:at + 2] != b"\r\n":
                raise ValueError("a chunked body without its end")
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def record_id(page, digest: str) -> str:
    return f"<urn:page:{'null' if page is None else page}:{digest}>"


def one_line(url: str | None) -> str:
    """A header value: control characters and what is not ASCII as percent escapes."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def page_records(page, url, digest: str, payload: bytes, kind: str, refers, segment: int) -> Iterator[str]:
    """The records of one page, without the line ends between records."""
    me = record_id(page, digest)
    head = [("WARC-Type", kind), ("WARC-Record-ID", me), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(refers, digest)), ("WARC-Payload-Length", str(len(payload)))]
        block = HTTP.encode()
    else:
        block = HTTP.encode() + chunked(payload)
    parts = list(pieces(block, segment))
    for number, part in enumerate(parts, 1):
        if number > 1:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{number}>"), ("WARC-Date", DATE),
                    ("WARC-Segment-Origin-ID", me)]
        extra = [("WARC-Segment-Number", str(number))] if len(parts) > 1 else []
        if number == len(parts) > 1:
            extra.append(("WARC-Segment-Total-Length", str(len(block))))
        lines = [f"{k}: {v}" for k, v in [*head, *extra, ("Content-Length", str(len(part)))]]
        yield "WARC/1.1\r\n" + "\r\n".join(lines) + END + part.decode()


def plan_records(pages: DataFrame, page_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page, url, html, digest, kind, refers`` of each page."""
    rows = pages.select(column(page_col).alias("page"), column(url_col).cast("string").alias("url"),
                        F.coalesce(column(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html"))
    large = rows.where(F.col("size") >= REVISIT_BYTES)
    first = large.groupBy("digest", "size").agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(first.select("digest", "size", "keeper"), ["digest", "size"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return rows.select("page", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("kind"),
                       F.when(again, F.col("keeper")).alias("refers"))


def write_archives(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write the records of all pages as compressed archives into the folder ``path``.

    Of the records with equal payloads of at least ``REVISIT_BYTES`` bytes that with the largest page id is the
    response and the others revisit it; rows that repeat that id are responses too. A null html is an empty payload,
    a null url an empty address; null ids are written as ``null``. An empty table gives an empty folder.
    """

    def run(batches):
        for rows in batches:
            out = []
            for row in zip(*(rows.column(i).to_pylist() for i in range(6))):
                page, url, html, digest, kind, refers = row
                out += page_records(page, url, digest, html.encode(), kind, refers, segment_bytes)
                if sum(map(len, out[-8:])) > 1 << 20 or len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # The records' end, two line ends, is Spark's separator between the rows of a text file.
    records = map_arrow(plan_records(pages, page_col, url_col, html_col), run, "value string")
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: their headers and blocks; a ValueError where the format is broken."""
    at = 0
    while at < len(data):
        end = data.index(END.encode(), at)
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("a record without its version line")
        lines = data[data.index(b"\r\n", at) + 2:end + 2]
        head = {k.decode().lower(): v.decode() for k, v in HEADER.findall(lines)}
        begin, size = end + 4, int(head["content-length"])
        if data[begin + size:begin + size + 4] != END.encode():
            raise ValueError("a record without its end")
        yield head, data[begin:begin + size]
        at = begin + size + 4


SEGMENTS = "array<struct<number:int,total:bigint,block:binary>>"
PARSED = "origin string, kind string, url string, refers string, digest string, size bigint, number int, total bigint, block binary"


def read_archives(spark: SparkSession, path: str, page_type: str = "bigint") -> DataFrame:
    """``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, complete`` of each written page.

    ``complete`` is false where segments are missing, the total length differs, the framing is broken or the
    payload hasn't its digest; the payload is then null. Revisits have no payload of their own. Pages written
    several times alike come back as often; an empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def records(batches):
        names = [x.split()[0] for x in PARSED.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for rows in batches:
            for content in rows.column(0):
                out, held = [], 0
                for head, block in parse(gzip.decompress(content.as_py())):
                    number = int(head.get("warc-segment-number", 1))
                    total = head.get("warc-segment-total-length") or (
                        None if "warc-segment-number" in head else len(block))
                    out.append((
                        head.get("warc-segment-origin-id", head["warc-record-id"]),
                        None if number > 1 else head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"),
                        head.get("warc-payload-digest"), int(head.get("warc-payload-length", -1)), number,
                        total and int(total), block))
                    held += len(block)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    parsed = map_arrow(files, records, PARSED)
    first = lambda c: F.max(F.when(F.col("number") == 1, F.col(c))).alias(c)
    whole = parsed.groupBy("origin").agg(
        first("kind"), first("url"), first("refers"), first("digest"), first("size"),
        F.count_if(F.col("number") == 1).alias("n"),
        F.collect_set(F.struct("number", "total", "block")).alias("segments"))

    def decode(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            out = [assemble(*row) for row in zip(*(rows.column(i).to_pylist() for i in range(7)))]
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                names=["page", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers", "complete"])

    whole = whole.select(F.explode(F.expr("sequence(1L, greatest(n, 1L))")).alias("copy"), "*").drop("copy", "n")
    out = map_arrow(whole.select("origin", "kind", "url", "refers", "digest", "size", "segments"), decode,
                    "page string, url string, record_type string, payload binary, payload_bytes bigint, "
                    "payload_digest string, refers string, complete boolean")
    number = lambda c: F.expr(f"try_cast({c} as {page_type})")
    return out.select(number("page").alias("page_id"), "url", "record_type", "payload", "payload_bytes",
                      "payload_digest", number("refers").alias("refers_to"), "complete")


def page_of(identifier: str | None) -> str | None:
    """The page in a record's identifier."""
    return identifier[len("<urn:page:"):-1].rpartition(":")[0] if identifier else None


def assemble(origin, kind, url, refers, digest, size, segments):
    """Put a page together from its segments (each a dict of number, total and block)."""
    digest = digest[len("sha1:"):] if digest else None
    page = page_of(origin)
    ordered = sorted(segments, key=lambda s: s["number"])
    block = b"".join(s["block"] for s in ordered)
    ok = [s["number"] for s in ordered] == list(range(1, len(ordered) + 1)) and ordered[-1]["total"] == len(block)
    if kind == "revisit":
        return page, url, kind, None, size, digest, page_of(refers), ok
    payload = None
    if ok:
        try:
            payload = unchunked(block[block.index(b"\r\n\r\n") + 4:])
        except ValueError:
            ok = False
    if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
        payload, ok = None, False
    return page, url, kind, payload, None if payload is None else len(payload), digest, None, ok
