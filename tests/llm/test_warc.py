"""Archives read back as written, the tree of losers against a sort."""

import base64
import gzip
import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripmill.llm import warc


def test_merge_of_runs():
    draw = random.Random(2)
    for _ in range(800):
        runs = [sorted((draw.choice("abc"), str(draw.randint(0, 3)), f"r{i}", j) for j in range(draw.randint(0, 6)))
                for i in range(draw.randint(0, 9))]
        assert list(warc.merge_runs(runs)) == sorted(x for run in runs for x in run)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


PAGES = [
    (3, "http://a.example/x", "<p>é same</p>"), (9, "https://www.A.example:80/x#f", "<p>é same</p>"), (5, None, "<p>é same</p>"),
    (2, "http://b.example/\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n"),
    (1, "http://a.example/x", ""), (4, "http://c.example", None), (6, "http://d.example/ü?q=1", "\n" * 7), (8, "", "<p>é same</p>"),
    (None, "http://e.example", "only"), (None, None, "<p>é same</p>"), (7, "http://f.example", "long" * 50000),
]


@pytest.mark.parametrize("least, size", [(0, 16 << 20), (10, 300)])
def test_round_trip(spark, monkeypatch, least, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    monkeypatch.setattr(warc, "RANGE_ROWS", 3)
    table = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, digest string")
    index = warc.read_index(spark, warc.write_archives(table, least)).collect()
    first = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        refers = first.get(html or "", i)
        again = i is not None and refers != i
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", refers if again else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(got, key=str) == sorted(want, key=str)
    keys = [tuple(getattr(r, c) for c in warc.ORDER) for r in index]
    assert keys == sorted(keys)
    urls = {r.page_id: r.url for r in index}
    assert urls[3] == "http://a.example/x" and urls[5] is None and urls[2] == "http://b.example/%0D%0AWARC/1.1"
    assert {r.urlkey for r in index if r.page_id in (1, 3, 9)} == {"example,a)/x"}


def test_repeated_pages_and_empty_table(spark):
    table = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (2, "v", "h"), (2, "v", "h")], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_index(spark, warc.write_archives(table)).collect())
    assert got == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2
    assert warc.read_index(spark, warc.write_archives(table.limit(0))).isEmpty()


def test_each_capture_opens_at_its_offset(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    pages = [(i, f"http://h{i % 3}.example/{i % 5}", f"<p>page {i}\0 é</p>" * (i % 40)) for i in range(200)]
    path = warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    captures = warc.read_index(spark, path).collect()
    assert [r.page_id for r in captures] != sorted(r.page_id for r in captures) and len(captures) == 200
    assert [tuple(r[:4]) for r in captures] == sorted(tuple(r[:4]) for r in captures)
    assert len({r.run for r in captures}) > 5
    for r in captures:
        with open(os.path.join(path, r.run), "rb") as f:
            f.seek(r.offset)
            headers, block = warc.read_record(gzip.decompress(f.read(r.length)))
        assert headers["X-Page-ID"] == str(r.page_id)
        if r.record_type == "response":
            assert block.partition(b"\r\n\r\n")[2] == pages[r.page_id][2].encode()


def test_a_hot_url_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 9_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "HEAD_ROWS", 2)
    pages = spark.range(300).selectExpr("id as page_id", "if(id % 10 = 0, concat('http://x/', id), 'http://hot/') as url", "'h' as html")
    index = warc.read_index(spark, warc.write_archives(pages))
    parts = index.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 5 and max(r["count"] for r in parts) < 100
    assert [r.page_id for r in index.where("urlkey = 'hot)/'").collect()] == [i for i in range(300) if i % 10]


def test_records_over_sixteen_megabytes():
    long, short = b"x" * (17 << 20), b"WARC"
    parts = []
    for batch in warc._members([pa.RecordBatch.from_pydict({"r": [long.decode(), short.decode()]})]):
        parts += [x + b"\0" for x in batch.column(0).to_pylist()]
    found = list(warc.read_members(b"".join(parts)))
    assert [(at, content) for at, _, content in found] == [(0, long), (len(parts[0]), short)]


def test_damaged_records_are_told():
    with pytest.raises(ValueError):
        warc.read_record(b"no record\r\n\r\n")
    with pytest.raises(ValueError):
        warc.read_record(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabcdef")
    with pytest.raises(ValueError):
        list(warc.read_members(warc.member(b"cut short")[:-3]))
