import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest

from tillwatch.llm.warc import archive_pages, base32_sha1, read_archives, read_records, record_bytes, write_archives
from tillwatch.session import work_path

BIG = "<p>" + "long page é " * 30_000
ROWS = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "http://c\r\nX: y", "other"), (2, "u", None), (4, "u", ""),
        (7, "", BIG), (8, "x", BIG), (7, "", BIG), (None, "n", "same"), (None, "n", "nameless")]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in groups[html or ""] if x is not None]
        first = min(ids) if ids and len(data) >= least else None
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", first if revisit else None, "ok"))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'c' AS payload", "0 AS digest", "1 AS first")
    got = archive_pages(pages.repartition(3), min_bytes=least).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS, least)
    assert archive_pages(pages.limit(0)).count() == 0


def test_archives_are_cut_and_hold_a_gzip_member_per_record(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    manifest = write_archives(pages, work_path(spark, "warc-test"), archive_bytes=300)
    rows = manifest.collect()
    assert len(rows) > 2 and sum(r["records"] for r in rows) == len(ROWS)
    data = open(rows[0]["path"].removeprefix("file:"), "rb").read()
    assert len(data) == rows[0]["bytes"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    assert read_archives(manifest).filter("status = 'ok'").count() == len(ROWS)


class Slow(io.BytesIO):
    """Hands out a few bytes at a time."""

    def read(self, n=-1):
        return super().read(7)


def members():
    return [record_bytes("response", f"urn:page:{i}", "u", b"payload %d" % i, base32_sha1(b"payload %d" % i), None) for i in range(3)]


def test_reader_works_on_pieces():
    got = list(read_records(Slow(b"".join(members()))))
    assert [(r["record_id"], r["payload_bytes"], r["status"]) for r in got] == [(f"urn:page:{i}", 9, "ok") for i in range(3)]


def test_damage_is_told():
    a, b, c = members()
    wrong = record_bytes("response", "urn:page:9", "u", b"data", base32_sha1(b"other"), None)
    assert [r["status"] for r in read_records(io.BytesIO(a + wrong + c))] == ["ok", "digest", "ok"]
    assert [r["status"] for r in read_records(io.BytesIO(a + b[:-20]))] == ["ok", "truncated"]
    assert [r["status"] for r in read_records(io.BytesIO(a + b"not gzip at all"))] == ["ok", "damaged"]
    assert [r["status"] for r in read_records(io.BytesIO(gzip.compress(b"no header here")))] == ["damaged"]
    assert list(read_records(io.BytesIO(b""))) == []


def test_headers_of_any_length(spark):
    rows = [(1, "http://a", "one"), (2, "data:text/html," + "漢" * 150_000, "two"), (3, "http://c", "three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(tuple(r) for r in archive_pages(pages).collect()) == expected(rows)
    member = record_bytes("response", "urn:page:7", "u" * 3_000_000, b"x", base32_sha1(b"x"), None)
    assert [len(r["uri"]) for r in read_records(Slow(member))] == [3_000_000]


def test_reading_goes_on_behind_a_bad_record_that_inflates():
    a, b, c = members()
    short = gzip.compress(gzip.decompress(b)[:-12])
    for bad, status in ((gzip.compress(b"no header" * 300_000), "damaged"), (gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), "damaged"),
                        (short, "truncated")):
        assert [r["status"] for r in read_records(io.BytesIO(a + bad + c))] == ["ok", status, "ok"]


def test_text_ids_come_back_as_they_are(spark):
    ids = ["a b", "x\r\nWARC-Type: fake", "50%", "+", "", "None", "ü/ö?", "%", None, None]
    pages = spark.createDataFrame([(i, "http://a.b/", f"page {k % 4}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = archive_pages(pages).collect()
    assert sorted(map(str, (r["page_id"] for r in got))) == sorted(map(str, ids)) and all(r["status"] == "ok" for r in got)
    first = {}
    for k, i in enumerate(ids):
        if i is not None:
            first[k % 4] = min(first.get(k % 4, i), i)
    for r in got:
        of = [first[k % 4] for k, i in enumerate(ids) if i == r["page_id"]]
        assert r["refers_to"] in [f if f != r["page_id"] else None for f in of]
