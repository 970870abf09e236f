import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from evalspark.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "<html>" + "é" * 2000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small"), (4, "http://a/\r\n4", "small"), (5, "u", None),
            (6, "u", ""), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (9, "u", "x" * 999), (10, "u", "x" * 999),
            (2, "http://a/2", big), (None, "n", "y"), (11, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 200)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def expected(pages):
    rows = pages.collect()
    top = {}
    for r in rows:
        h = (r["html"] or "").encode()
        if len(h) >= 1000 and r["page_id"] is not None:
            top[h] = max(top.get(h, -1), r["page_id"])
    out = []
    for r in rows:
        h = (r["html"] or "").encode()
        keeper = top.get(h, r["page_id"])
        again = keeper != r["page_id"]
        out.append((r["page_id"], len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [1 << 20, 300, 17])
def test_round_trip_at_any_split(spark, pages, split):
    files = warc.write_archives(pages, file_bytes=1500)
    got = warc.read_archives(spark, files, split_bytes=split)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()),
                  key=str) == expected(pages)
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    full = [r for r in got.collect() if r["record_type"] == "response"]
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in full)
    assert files.agg(F.sum("records")).first()[0] == pages.count()


def test_archives_are_plain_gzip_members(spark, pages, tmp_path):
    files = warc.write_archives(pages, f"file://{tmp_path}/out").collect()
    for f in files:
        raw = open(f["file"].removeprefix("file://"), "rb").read()
        assert len(raw) == f["bytes"]
        assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type:") == f["records"]


def test_false_magic_is_not_a_record():
    inner = gzip.compress(b"not a warc record")
    record = warc.record_bytes(1, "u", inner + b"\x1f\x8b\x08\x00", "00" * 20, None)
    z = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the payload's magic stays visible
    data = b"\x1f\x8b\x08junk" + z.compress(record) + z.flush() + gzip.compress(record)

    class File(io.BytesIO):
        def read_at(self, n, at):
            return self.getbuffer()[at:at + n].tobytes()
    found = [at for lo in range(0, len(data), 10) for at, _ in warc.read_range(File(data), len(data), lo, min(lo + 10, len(data)))]
    assert len(found) == 2 and found[0] == 7


def test_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(none)).count() == 0
    clash = spark.createDataFrame([(1, "u", "h", "d", 3)], "page_id long, url string, html string, digest string, keeper int")
    assert warc.read_archives(spark, warc.write_archives(clash)).first()["record_type"] == "response"


def test_every_byte_is_read_once():
    import io
    import random
    rng = random.Random(3)
    members = [gzip.compress(warc.record_bytes(i, f"http://x/{i}", rng.randbytes(rng.choice([10, 3000, 90_000])), "00" * 20, None)) for i in range(400)]
    data = b"".join(members)

    class File(io.BytesIO):
        total = calls = 0

        def read_at(self, n, pos):
            self.calls += 1
            got = data[pos:pos + n]
            self.total += len(got)
            return got

    f = File()
    got = [r["page_id"] for _, r in warc.read_range(f, len(data), 0, len(data), step=1 << 18)]
    assert got == list(range(400)) and f.total <= 1.2 * len(data) and f.calls <= len(data) / (1 << 18) + 2
    torn = data[5:]  # begins inside a record, which is somebody else's
    for step in (1 << 18, 1000, 7):
        class Torn(File):
            def read_at(self, n, pos):
                return torn[pos:pos + n]
        small = 60_000 if step < 1000 else len(torn)
        found = [r["page_id"] for _, r in warc.read_range(Torn(), len(torn), 0, small, step=step)]
        assert found == list(range(1, 1 + len(found))) and len(found) > 1
