import base64
import hashlib
import zlib

import pyarrow.fs
from pyspark.sql import functions as F

from corpusloom.llm import warc
from corpusloom.llm.common import scratch

PAGES = [(5, "http://a/x y\r\nEvil: 1", "<p>ü</p>"), (3, "http://b", "<p>ü</p>"), (9, None, None), (8, "http://c", ""), (7, "http://d", "long " * 30_000), (7, "http://d", "long " * 30_000), (None, "http://e", "<p>ü</p>"), (12, "http://f", "one of its kind\r\n\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as digest", "1 as payload", "2 as offset")


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        other = first.get(h or "")
        revisit = other is not None and other != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.archive_and_read(pages(spark)).drop("url").collect()
    assert sorted(map(tuple, got), key=str) == want(PAGES)
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_archives_are_gzip_members_that_the_index_points_to(spark):
    folder = scratch(spark, "warc-test")
    rows = warc.write(warc.plan(pages(spark).coalesce(1)), folder).collect()
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    for name in {r.archive for r in rows}:
        raw = fs.open_input_file(f"{base}/{name}").read()
        own = sorted((r for r in rows if r.archive == name), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and len(raw) == sum(r.length for r in own)
        for r in own:
            headers, _, payload = warc.parse(zlib.decompress(raw[r.offset : r.offset + r.length], 31))
            assert headers["warc-type"] == r.record_type and headers["warc-payload-digest"] == f"sha1:{r.digest}"
            assert "evil" not in headers
            if r.record_type == "response":
                assert base64.b32encode(hashlib.sha1(payload).digest()).decode() == r.digest


def test_selected_ranges_are_coalesced(spark, monkeypatch):
    folder = scratch(spark, "warc-test")
    many = [(i, f"http://h/{i}", f"page {i} " * 20) for i in range(100)]
    index = warc.write(warc.plan(pages(spark, many)).coalesce(1), folder)
    near = index.where("page_id < 1000")
    assert warc.ranges(near).groupBy("archive").count().agg(F.max("count")).first()[0] == 1
    monkeypatch.setattr(warc, "GAP_BYTES", 0)
    some = index.where("page_id % 10 = 3")
    assert warc.ranges(some).count() >= 5
    got = warc.read(some, folder, with_payload=True).collect()
    assert sorted(int(r.page_id) for r in got) == list(range(3, 100, 10))
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * 20 for r in got)


def test_least_bytes(spark):
    rows = {(r.page_id, r.refers_to) for r in warc.plan(pages(spark), least_bytes=5).collect()}
    assert (9, None) in rows and (8, None) in rows and (5, 3) in rows


def test_text_ids_come_back_as_they_were(spark):
    ids = ["none", "", "a>b", "x\r\nWARC-Type: revisit", "ü %20", None, "<>", "twin"]
    rows = [(x, "http://u", f"<p>{i}</p>") for i, x in enumerate(ids)] + [("twin2", "http://u", "<p>7</p>")]
    out = warc.archive_and_read(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted((r.page_id for r in out), key=str) == sorted([*ids, "twin2"], key=str)
    assert {(r.page_id, r.refers_to) for r in out if r.refers_to} == {("twin2", "twin")}


def test_many_repeated_payloads_are_joined(spark, monkeypatch):
    few = sorted(map(tuple, warc.archive_and_read(pages(spark)).drop("url").collect()), key=str)
    monkeypatch.setattr(warc, "SENT_DIGESTS", 0)
    assert sorted(map(tuple, warc.archive_and_read(pages(spark)).drop("url").collect()), key=str) == few == want(PAGES)
