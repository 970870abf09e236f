"""WARC: pages as gzip-compressed records in archive files, and a splittable reader.

Writing: each Spark task writes archive files of its own below one folder (any
file system that pyarrow reaches: file, hdfs, s3, gs), one gzip member per
record, and returns their names.  Only files that a finished task returned are
ever read, so a repeated task leaves no second copy of a record.

Reading: archives are cut into byte ranges.  A task scans its range for the
gzip magic, takes a position as a record only when the member decodes to a
WARC header, and owns the records that start inside its range; the last one
may end beyond it.

Defined results: null html is an empty payload; a null page_id is written
without an id and read back as null, such a record is never referred to; equal
rows are equal records; null url is an empty target; extra columns are ignored.
A payload that itself holds whole WARC gzip members in an incompressible block
can be mistaken for records when a range starts inside it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.common import file_uri, shared_path, staged

MIN_SHARED = 1000  # smaller payloads are always stored in full
DATE = "2025-01-01T00:00:00Z"  # archives of the same pages are byte-identical
MAGIC = b"\x1f\x8b\x08"
FILES = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()),
                      T.StructField("records", T.LongType())])
RECORDS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("record_offset", T.LongType()),
    T.StructField("record_type", T.StringType()), T.StructField("page_id", T.LongType()),
    T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType())])


def plan_records(pages: DataFrame, min_shared: int = MIN_SHARED, broadcast_rows: int = 500_000) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest`` and ``keeper``: the page that holds the equal payload, or null.

    Keepers are found on digests alone (combined before the shuffle); the pages
    themselves move only if the repeated payloads number more than ``broadcast_rows``.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                     F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("n"))
    repeated = staged(p.where(F.col("n") >= min_shared).groupBy("digest")
                      .agg(F.max("page_id").alias("keeper"), F.count("*").alias("c"))
                      .where("c > 1").select("digest", "keeper"), "warc-repeated")
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    same = F.col("page_id").eqNullSafe(F.col("keeper"))
    return p.join(repeated, "digest", "left").withColumn("keeper", F.when(~same, F.col("keeper"))).drop("n")


def record_bytes(page_id, url, payload: bytes, digest: str, keeper) -> bytes:
    """One record: the HTTP header with the payload, or the header alone when ``keeper`` holds the payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            "Content-Type: application/http; msgtype=response"]
    if keeper is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{keeper}>"]
    block = http + payload if keeper is None else http
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str | None = None, min_shared: int = MIN_SHARED,
                   file_bytes: int = 256 << 20) -> DataFrame:
    """Write one record per row of ``pages``; returns the archive files (file, bytes, records), already written."""
    spark = pages.sparkSession
    folder = file_uri(folder or shared_path(spark, "warc"))
    planned = plan_records(pages, min_shared).select("page_id", "url", "html", "digest", "keeper")

    def write(batches):
        from pyarrow import fs
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = name = None
        size = count = 0
        for b in batches:
            for page_id, url, html, digest, keeper in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record_bytes(page_id, url, html.encode(), digest, keeper)
                member = z.compress(raw) + z.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= file_bytes:
                    out.close()
                    yield _files([f"{folder}/{name}"], [size], [count])
                    out = None
        if out is not None:
            out.close()
            yield _files([f"{folder}/{name}"], [size], [count])

    return staged(planned.mapInArrow(write, FILES), "warc-files")


def _files(names, sizes, counts):
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                      names=["file", "bytes", "records"])


def parse_record(raw: bytes) -> dict | None:
    """The fields of :data:`RECORDS` from a decoded member, or None when it isn't a whole record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    h = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        h[k.strip().lower()] = v.strip()
    try:
        block = rest[:int(h["content-length"])]
        if len(block) != int(h["content-length"]):
            return None
    except (KeyError, ValueError):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
    page = lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?[0-9]+)>", s or "")) else None
    kind = h.get("warc-type", "")
    if kind == "revisit":
        b32 = h.get("warc-payload-digest", "").removeprefix("sha1:")
        digest, n, payload = base64.b32decode(b32).hex() if b32 else None, int(size[1]) if size else None, None
    else:
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"record_type": kind, "page_id": page(h.get("warc-record-id")), "refers_to": page(h.get("warc-refers-to")),
            "url": h.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "payload": payload}


class Buffered:
    """A file read forward in steps: bytes from ``low`` on stay at hand, so that each is read once."""

    def __init__(self, f, size: int, step: int = 1 << 20):
        self.f, self.size, self.step, self.low = f, size, step, 0
        self.at, self.data = 0, b""

    def read(self, n: int, pos: int) -> bytes:
        """Up to ``n`` bytes at ``pos``, fewer at the end of what was read in one step."""
        end = self.at + len(self.data)
        if not self.at <= pos <= end:
            self.at, self.data = pos, b""
            end = pos
        if pos == end and end < self.size:
            cut = min(max(self.low - self.at, 0), len(self.data))
            more = self.f.read_at(min(self.step, self.size - end), end)
            self.at, self.data = self.at + cut, self.data[cut:] + more
        return self.data[pos - self.at:pos - self.at + n]


def _member(f: Buffered, at: int, step: int = 1 << 16):
    """(decoded bytes, end) of the gzip member at ``at``, or None; a member that isn't WARC is left after its first bytes."""
    z, parts, pos, seen = zlib.decompressobj(31), [], at, b""
    f.low = at
    try:
        while not z.eof and pos < f.size:
            data = f.read(step, pos)
            pos += len(data)
            parts.append(z.decompress(data))
            if len(seen) < 7:
                seen += parts[-1][:7]
                if not b"WARC/1.".startswith(seen[:7]):
                    return None
    except zlib.error:
        return None
    return (b"".join(parts), pos - len(z.unused_data)) if z.eof else None


def read_range(f, size: int, start: int, end: int, step: int = 1 << 20):
    """(offset, record) of each record that starts in [start, end).

    The end of a record is where the next is tried; only where there is none is the magic looked for.
    """
    f, at = Buffered(f, size, step), start
    while at < end:
        got = _member(f, at) if f.read(1, at) == MAGIC[:1] else None
        record = got and parse_record(got[0])
        if record:
            yield at, record
            at = got[1]
            continue
        f.low = at = at + 1
        while at < end:
            window = f.read(step, at)
            if 0 < len(window) < len(MAGIC) and at + len(window) < size:  # the magic may lie across two steps
                window += f.read(step, at + len(window))
            i = window.find(MAGIC)
            if i >= 0:
                at += i
                break
            at += max(1, len(window) - len(MAGIC) + 1)
            f.low = at


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = 64 << 20, payload: bool = True) -> DataFrame:
    """All records of ``files`` (file, bytes) as :data:`RECORDS`; ``payload=False`` leaves payloads null."""
    ranges = (files.select("file", "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)),
                                                                 F.lit(split_bytes))).alias("start"))
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches):
        from pyarrow import fs
        names = [x.name for x in RECORDS][1:]
        for b in batches:
            for name, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, path = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with store.open_input_file(path) as f:
                    for at, r in read_range(f, size, start, min(start + split_bytes, size)):
                        if not payload:
                            r["payload"] = None
                        rows.append({"file": name, "record_offset": at, **r})
                        held += len(r["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield _records(rows)
                            rows, held = [], 0
                if rows:
                    yield _records(rows)

    def _records(rows):
        kinds = {"file": pa.string(), "record_offset": pa.int64(), "record_type": pa.string(), "page_id": pa.int64(),
                 "refers_to": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
                 "payload_digest": pa.string(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    return ranges.mapInArrow(read, RECORDS)
