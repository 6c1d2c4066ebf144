"""Archives against plain Python: round trips at small chunk sizes, revisits, damaged and foreign files."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from foliospark.llm import warc as m

PAGES = "page_id long, url string, html string, record string, sha string, chunk int"


def brute(rows, least=m.LEAST):
    """Sorted (page_id, bytes, digest, type, refers_to)."""
    low = lambda v: (v is not None, v)
    groups, out = {}, []
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((low(page), low(url)))
    for body, own in groups.items():
        digest = hashlib.sha1(body).hexdigest()
        own.sort(key=lambda r: ((r[0][0], r[0][1] or 0), (r[1][0], r[1][1] or "")), reverse=True)
        for i, (page, _) in enumerate(own):
            again = len(body) >= least and i > 0
            out.append((page[1], len(body), digest, "revisit" if again else "response", own[0][0][1] if again else None))
    return sorted(out, key=str)


def got(frame):
    rows = frame.collect()
    assert all(r.intact for r in rows)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES)


LONG = "ä€😀 WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n" * 60
CASES = [
    (1, "http://a/", LONG), (2, "http://a/2", LONG), (3, None, LONG), (3, "http://b/x y%20\r\nEvil: 1", LONG), (3, "http://b/x y%20\r\nEvil: 1", LONG), (None, None, LONG),
    (4, "u", None), (5, "u", ""), (5, "u", ""), (5, "v", ""), (5, None, ""), (None, None, None), (6, "u", "\r\n\r\n"), (7, "u", "short"), (8, "u", "short"),
    (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "x" * 1000), (12, "u", "x" * 1000), (-13, "u", "\n" * 3000), (14, "u", "ö" * 5000 + "\r"), (15, "u", "HTTP/1.1 200 OK\r\n\r\n" * 99),
]


@pytest.mark.parametrize("chunk", [7, 64, 1000, m.CHUNK])
def test_round_trip(spark, folder, chunk):
    assert got(m.page_records(table(spark, CASES), folder + "/a", chunk)) == brute(CASES)


def test_empty_table(spark, folder):
    frame = m.page_records(table(spark, []), folder + "/a")
    assert frame.collect() == [] and frame.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_one_payload_in_a_third_of_the_rows(spark, folder):
    rows = [(i, f"http://h/{i % 7}", "y" * 1500 if i % 3 == 0 else f"{i}" * 400) for i in range(3000)]
    assert got(m.page_records(table(spark, rows).repartition(9), folder + "/a")) == brute(rows)


def test_bytes_come_back(spark, folder):
    """Any bytes, whatever the chunks they are written in and read in."""
    bodies = {i: os.urandom(i * 37) + b"\r\n\r\nWARC/1.1\r\n" * (i % 3) for i in range(40)}
    schema = StructType([StructField("key", LongType()), StructField("target", StringType()), StructField("payload", BinaryType())])
    m.write_archives(spark.createDataFrame([(i, f"u{i}", b) for i, b in bodies.items()], schema), folder + "/a", chunk=100)
    for chunk in (33, 100, 4096):
        found = {}
        for r in sorted(m.read_chunks(spark, folder + "/a", chunk).collect(), key=lambda r: r.chunk):
            assert len(r.data) <= chunk
            found[int(r.record.split(":")[2])] = found.get(int(r.record.split(":")[2]), b"") + bytes(r.data)
        assert found == bodies


def test_names_are_unique_and_revisits_resolve(spark, folder):
    m.page_records(table(spark, CASES), folder + "/a").count()
    records = m.read_records(spark, folder + "/a").collect()
    names = [r.record for r in records]
    assert len(set(names)) == len(names) == len(CASES)
    kinds = {r.record: (r.kind, r.payload_digest, r.payload_bytes) for r in records}
    for r in records:
        if r.kind == "revisit":
            assert kinds[r.refers] == ("response", r.payload_digest, r.payload_bytes)
    stored = sum(r.payload_bytes for r in records if r.kind == "response")
    assert sum(len(r.data) for r in m.read_chunks(spark, folder + "/a").collect()) == stored


def test_targets_come_back(spark, folder):
    out = m.page_records(table(spark, CASES), folder + "/a").select("url").collect()
    assert sorted(str(r.url) for r in out) == sorted(str(c[1]) for c in CASES)


def test_damaged_and_foreign_files(spark, folder):
    os.mkdir(folder + "/a")
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:0>\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    whole = info + one % (5000, b"z" * 5000)
    broken = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:2>\r\nContent-Length: 90\r\n\r\nabc"
    lie = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:3>\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for name, data in (("a", whole + broken), ("b", lie)):
        with gzip.open(f"{folder}/a/{name}.warc.gz", "wb") as f:
            f.write(data)
    found = {r.record: r for r in m.read_records(spark, folder + "/a", chunk=64).collect()}
    assert set(found) == {"urn:x:1", "urn:x:2", "urn:x:3"}
    assert found["urn:x:1"].payload_digest == hashlib.sha1(b"z" * 5000).hexdigest() and found["urn:x:1"].intact
    assert not found["urn:x:2"].intact and not found["urn:x:3"].intact


def test_query_against_brute_force(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert got(m.op11_warc(spark, small).where(F.lit(True))) == brute(rows)
