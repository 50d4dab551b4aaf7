import base64
import gzip
import hashlib

import pytest

from keyfold.llm import warc

DATE = "2024-01-01T00:00:00Z"


def by_page(df):
    return {r.page_id: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("segment", [64 << 10, 100])
def test_round_trip(spark, segment):
    odd = [(-5, "u", None), (-4, None, ""), (-3, "x\r\ny", "é" * 9000 + "\r\n\r\nWARC/1.1\r\n\r\n"), (-2, "x", "é" * 9000 + "\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema))
    first = {}
    for r in sorted(pages.collect(), key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    got = by_page(warc.archived(pages.selectExpr("*", "1 payload", "2 key", "3 `a.b`"), segment))
    for r in pages.collect():
        payload, lead = (r.html or "").encode(), first[r.html or ""]
        same = lead == r.page_id
        assert got[r.page_id] == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if same else "revisit", None if same else lead, True)
    assert warc.archived(pages.limit(0)).count() == 0


def test_repeated_rows_and_ids_of_other_types(spark):
    pages = spark.createDataFrame([("b", "u", "x" * 300), ("b", "u", "x" * 300), ("c", "u", "x" * 300), (None, "u", "x" * 300), ("c", "u", "y"), (None, "v", "z"), (None, "v", "z")], "page_id string, url string, html string")
    got = sorted((r.page_id or "", r.payload_bytes, r.record_type, r.refers_to or "", r.intact) for r in warc.archived(pages, segment=100).collect())
    assert got == sorted([*[("b", 300, "response", "", True)] * 2, ("c", 300, "revisit", "b", True), ("", 300, "revisit", "b", True), ("c", 1, "response", "", True), *[("", 1, "response", "", True)] * 2])


def test_every_record_is_a_member(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert data.count(b"\x1f\x8b\x08") >= 20 and len(list(warc._members(data))) == 20
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 20


def test_lost_segment_and_wrong_lengths(spark, tmp_path):
    parts = warc.page_records(7, "u", b"x" * 500, True, None, DATE, 200)

    def read(name, data):
        (tmp_path / name).write_bytes(data)
        return [(r.page_id, r.payload_bytes, r.intact) for r in warc.read_warc(spark, str(tmp_path / name)).collect()]

    assert read("a", b"".join((*parts[1:], parts[0]))) == [("7", 500, True)]
    assert read("b", b"".join((parts[0], *parts[2:]))) == [("7", None, False)]
    one, two = (warc.page_records(k, "u", b"body", True, None, DATE, 9000)[0] for k in (1, 2))
    length = next(x for x in one.split(b"\r\n") if x.startswith(b"Content-Length"))
    for bad in (b"Content-Length: abc", b"Content-Length: -5", b"Content-Length: 99999999", b"X-None: 1"):
        assert sorted(read("c", one.replace(length, bad) + two)) == [("1", None, False), ("2", 4, True)]
    squeezed = [gzip.compress(x) for x in (one, two)]
    assert read("d", squeezed[0] + squeezed[1][:-20])[0] == ("1", 4, True)
    assert all(not intact for _, _, intact in read("e", squeezed[1][:-20]))
    assert read("f", b"no archive") == [] and read("g", squeezed[0] + b"junk") == [("1", 4, True)]
    assert read("h", one.replace(b"sha1:", b"sha1:X")) == [("1", 4, False)]


@pytest.mark.parametrize("body", [b"", b"5\r\nab", b"-1\r\n\r\n", b"zz\r\nab\r\n0\r\n\r\n", b"2\r\nabXX0\r\n\r\n"])
def test_broken_chunks(body):
    assert warc.unchunked(body) is None


def test_revisits_need_what_they_refer_to(spark, tmp_path):
    own, other = (warc.page_records(1, "u", x, True, None, DATE, 9000)[0] for x in (b"body", b"else"))
    visit = warc.page_records(2, "u", b"body", False, 1, DATE, 9000)[0]

    def read(name, data):
        (tmp_path / name).write_bytes(data)
        return {r.page_id: r.intact for r in warc.resolved(warc.read_warc(spark, str(tmp_path / name)).drop("payload")).collect()}

    assert read("a", own + visit) == {"1": True, "2": True}
    assert read("b", visit) == {"2": False}
    assert read("c", other + visit) == {"1": True, "2": False}
    assert read("d", own.replace(b"body", b"bodx") + visit) == {"1": False, "2": False}
