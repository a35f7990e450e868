"""WARC archives with an index, read back by byte ranges.

``write`` streams each partition's records into one archive (a gzip member per
record) in the shared folder and returns the index, one row per record with
file, offset, length, URL and digest, as a written table. A task that is lost
or run twice leaves an archive that no index row names, so the index alone
says what exists. ``read`` sorts selected index rows by file and offset, joins
neighbouring ranges into one read of at most ``CHUNK`` bytes, and parses the
records; it never reads what was not selected beyond gaps of ``GAP`` bytes.
The reading tasks are cut by archive bytes, not by the size of the index.

Records with equal payloads are stored once: of at least ``least`` bytes, the
one with the smallest id is a ``response``, the others ``revisit`` it without
a body; smaller payloads are all responses. Which payloads occur twice is told
by digests and ids alone; the payloads themselves are not written beforehand.
Record ids follow from digest, row id and URL, and the date is an argument, so
a second run writes the same records. A revisit names its response, and states
the length of the payload that it stands for in an extension field.

Defined results: null payload: empty; null id comes after all others and is
read back as null, as is a null URL; line ends in a URL are percent-escaped in
the archive and read back as they were; of rows equal in id and payload the
one with the least URL is the response (null last), of rows equal in all three
one is, the others revisit it; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, scratch, ship

CHUNK, GAP, TASK_BYTES = 8 << 20, 64 << 10, 32 << 20
INDEX = "id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"
RECORD = "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _line(value: str) -> str:
    """A header value holds no line end: such characters are percent-escaped."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(sha: str, rid: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([sha, rid, url]))}>"


def record(rid: int | None, url: str | None, payload: bytes, sha: str, date: str, first: tuple | None) -> bytes:
    """A response, or a revisit of the record of (id, url) ``first``."""
    head = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(sha, rid, url)), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha1:{sha}")]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
        if url != _line(url):
            head.append(("X-Target-URI-JSON", json.dumps(url)))
    if first:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_id(sha, *first)), ("WARC-Refers-To-Date", date)]
        head += [("WARC-Refers-To-Target-URI", _line(first[1]))] if first[1] is not None else []
        head += [("X-Refers-To-Row", str(first[0]))] if first[0] is not None else []
    head += [("X-Row-Id", "" if rid is None else str(rid)), ("X-Payload-Length", str(len(payload)))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block += b"\r\n" if first else b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record, its payload checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and digest(body) != sha:
        raise ValueError("payload does not match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    url = json.loads(fields["X-Target-URI-JSON"]) if "X-Target-URI-JSON" in fields else fields.get("WARC-Target-URI")
    return {"id": number("X-Row-Id"), "url": url,
            "payload": body if kind == "response" else None, "payload_bytes": int(fields["X-Payload-Length"]),
            "payload_digest": sha, "record_type": kind, "refers_to": number("X-Refers-To-Row")}


def _archive(folder: str, date: str):
    """(id, url, text, sha, first) -> index rows; ``first`` is null for a
    response, else the id and URL of the record that this one revisits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        out, name, offset = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            rows = []
            for rid, url, text, sha, first in zip(*(batch.column(i) for i in range(5))):
                payload, sha = (text.as_py() or "").encode(), base64.b32encode(sha.as_py()).decode()
                rid, url, first = rid.as_py(), url.as_py(), first.as_py()
                first = first and (first["id"], first["url"])
                data = gzip.compress(record(rid, url, payload, sha, date, first), 5, mtime=0)
                out.write(data)
                rows.append((rid, name, offset, len(data), url, sha, "revisit" if first else "response", first[0] if first else None))
                offset += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                    names=["id", "file", "offset", "length", "url", "payload_digest", "record_type", "refers_to"])
        if out is not None:
            out.close()
    return run


def write(pages: DataFrame, folder: str, rid: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
          date: str | None = None) -> DataFrame:
    """Archives of ``pages`` under ``folder``; returns the written index.
    ``date``: the records' WARC-Date, now if none is given."""
    ship(pages.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(rid).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).alias("text"),
                        F.unhex(F.sha1(F.coalesce(F.col(payload), F.lit("")))).alias("sha"))
    # per payload that occurs twice, its first record: by id and URL, nulls last
    narrow = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) >= least).groupBy("sha", "id", "url").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("url").isNull(), F.col("url"))
    firsts = (narrow.groupBy("sha").agg(F.sum("copies").alias("n"), F.min_by(F.struct("id", "url", "copies"), order).alias("first"))
              .where("n > 1").select("sha", F.struct("first.id", "first.url").alias("first"), F.col("first.copies").alias("copies")))
    firsts = cut(firsts, "warc-firsts")
    own = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    small = F.octet_length(F.coalesce("text", F.lit(""))) < least
    marked = rows.join(firsts, "sha", "left").withColumn("first", F.when(~small, F.col("first")))
    records = marked.where(F.col("first").isNull() | ~own | (F.col("copies") == 1)).select(
        "id", "url", "text", "sha", F.when(~own, F.col("first")).alias("first"))
    several = firsts.where("copies > 1")
    if not several.isEmpty():   # rows equal to the first in all respects: one response, the others revisit it
        equal = marked.where(F.col("first").isNotNull() & own & (F.col("copies") > 1)).groupBy("sha", "first", "copies").agg(F.first("text").alias("text"))
        each = equal.select("sha", "text", "first", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("k"))
        records = records.unionByName(each.select("first.id", "first.url", "text", "sha", F.when(F.col("k") > 1, F.col("first")).alias("first")))
    return cut(records.mapInArrow(_archive(folder, date), INDEX), "warc-index")


def _ranges(files: list[str], offsets: list[int], lengths: list[int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(file, offset, end, first row, last row + 1) of the joined reads."""
    at = 0
    while at < len(files):
        start, end, to = offsets[at], offsets[at] + lengths[at], at + 1
        while to < len(files) and files[to] == files[at] and offsets[to] <= end + GAP and offsets[to] + lengths[to] - start <= CHUNK:
            end, to = max(end, offsets[to] + lengths[to]), to + 1
        yield files[at], start, end, at, to
        at = to


def _fetch(folder: str, bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            for file, start, end, a, b in _ranges(files, offsets, lengths):
                with fs.open_input_file(f"{base}/{file}") as f:
                    f.seek(start)
                    data = f.read(end - start)
                rows = []
                for o, n in zip(offsets[a:b], lengths[a:b]):
                    row = parse(gzip.GzipFile(fileobj=io.BytesIO(data[o - start:o - start + n])).read())
                    if not bodies:
                        row["payload"] = None
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
    return run


def read(selected: DataFrame, folder: str, bodies: bool = True) -> DataFrame:
    """The records of the index rows ``selected``. Without ``bodies`` payloads
    are checked and measured but not returned."""
    ship(selected.sparkSession)
    ranges = selected.select("file", "offset", "length")
    tasks = -(-(ranges.agg(F.sum("length")).first()[0] or 1) // TASK_BYTES)
    ranges = ranges.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_fetch(folder, bodies), RECORD)


def archive_folder(spark: SparkSession) -> str:
    return scratch(spark, "warc")
