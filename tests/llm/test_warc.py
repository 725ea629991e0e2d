import gzip
import hashlib
import re
import tempfile

import pytest

from terrafold.llm import warc
from terrafold.llm.warc import base32_sha1, chunked, page_records, read_warc, reassembled, unchunked, walk_records, write_warc

PAGES = "page_id long, url string, html string"


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 10_000):
        p = bytes(range(256)) * (n // 256) + b"x" * (n % 256)
        assert unchunked(chunked(p)) == p
    assert unchunked(b"5;name=v\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        unchunked(b"5\r\nhel")


def test_segments_are_put_in_order_and_verified():
    parts = [(2, None, b"b"), (1, None, b"a"), (3, 3, b"c")]
    assert reassembled(parts) == b"abc"
    assert reassembled(parts + parts[:1]) == b"abc"
    for wrong in (parts[:2], [(1, None, b"a"), (3, 2, b"c")], [(1, None, b"a"), (2, 5, b"b")], [(1, None, b"a"), (1, None, b"x"), (2, 2, b"b")]):
        with pytest.raises(ValueError):
            reassembled(wrong)


def test_records_that_hold_records():
    html = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9
    data = b"".join(r + b"\r\n" for r in page_records(1, "http://a b\r\nX: y", html, None, False, 0, 64))
    got = list(walk_records(data))
    assert [h["warc-type"] for h, _, _ in got] == ["response"] + ["continuation"] * (len(got) - 1) and len(got) > 5
    assert "x" not in got[0][0] and got[0][0]["warc-target-uri"] == "http://a%20b%0D%0AX:%20y"


def rows():
    long = "".join(f"<p>é{i}</p>" for i in range(9_000))
    return [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/", None), (2, "http://d/", ""), (7, "http://e/", long), (8, "http://f/", long), (10, "u", "WARC/1.1\r\n\r\n"), (None, "n", "no id"), (11, "u", "twice"), (11, "u", "twice")]


def brute(data, least):
    first = {}
    for p, _, h in data:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in data:
        b = (h or "").encode()
        f = first.get(h or "") if len(b) >= least else p
        out.append((p, len(b), base32_sha1(b), "response" if f == p or p is None else "revisit", None if f == p or p is None else f))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op2_warc(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data, 0)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_payloads_come_back(spark, compression):
    data = rows()
    path = tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/a"
    write_warc(spark.createDataFrame(data, PAGES), path, min_revisit_bytes=5, segment_bytes=1000, records_per_file=7, compression=compression)
    got = read_warc(spark, path).collect()
    assert sorted(r["record_type"] for r in got).count("revisit") == 1  # the long page; "same" is too short
    for r in got:
        assert r["record_type"] == "revisit" or (base32_sha1(bytes(r["payload"])) == r["digest"] == r["payload_digest"])
    assert {hashlib.sha1(bytes(r["payload"])).digest() for r in got if r["payload"] is not None} == {hashlib.sha1((h or "").encode()).digest() for _, _, h in data}
    assert all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", r["record_id"]) for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op2_warc(spark, str(tmp_path)).count() == 0


def archive(spark, *files):
    path = tempfile.mkdtemp(prefix="warc-", dir="/tmp")
    for i, f in enumerate(files):
        with open(f"{path}/{i}.warc", "wb") as out:
            out.write(f)
    return path


def one_page(n, html, segment=10**6):
    return [r + b"\r\n" for r in page_records(n, "http://a/", html, None, False, 0, segment)]


def test_gzip_members_of_a_record_each(spark):
    """The usual form of archives: all records come back, not the first only."""
    records = [r for n in range(20) for r in one_page(n, b"page %d" % n * 40, 100)]
    path = archive(spark, b"".join(gzip.compress(r) for r in records), gzip.compress(b"".join(one_page(99, b"whole"))), b"")
    got = read_warc(spark, path).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in got} == {**{n: b"page %d" % n * 40 for n in range(20)}, 99: b"whole"}
    assert warc.rejected_records(spark, path).count() == 0


def test_damaged_archives_are_rejected_record_by_record(spark):
    good = one_page(1, b"good")[0]
    parts = one_page(2, b"x" * 300, 100)
    chunk = one_page(3, b"abc")[0].replace(b"3\r\nabc", b"9\r\nabc")
    other = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:m>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    path = archive(spark, good + parts[1] + parts[2] + other, chunk + good[:-9], b"no archive", gzip.compress(good)[:-20], good + b"WARC/1.1\r\nContent-Length: x\r\n\r\n", one_page(4, b"y" * 300, 100)[0])
    got = read_warc(spark, path)
    assert sorted((r["page_id"], r["record_type"]) for r in got.where("record_type = 'response'").collect()) == [(1, "response")] * 2
    assert got.where("record_type = 'metadata'").count() == 1
    errors = sorted(r["error"].split(" byte")[0] for r in warc.rejected_records(spark, path).collect())
    assert {"a chunk is cut off", "a record is cut off", "the first segment is missing", "no record begins at", "gzip: a member is cut off"} <= set(errors)
    assert any(e.startswith("segments [1]") for e in errors)


def test_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, "u", "h", "x", "y")], PAGES + ", h string, first_id string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["page_id"] for r in warc.op2_warc(spark, str(tmp_path)).collect()] == [1]


def test_members_are_read_in_linear_time():
    import gzip
    import os
    import time

    from terrafold.llm.warc import members

    def took(n):
        block = [os.urandom(3000) for _ in range(50)]
        parts = [block[i % 50] + str(i).encode() for i in range(n)]
        content = b"".join(gzip.compress(x, 1) for x in parts)
        began = time.process_time()
        got = list(members(content))
        assert [x for x, _ in got] == parts and all(e is None for _, e in got)
        return time.process_time() - began

    took(100)
    few, many = took(2_000), took(20_000)
    assert many < 30 * max(few, 0.02)
    large = os.urandom(1 << 20) * 3
    packed = gzip.compress(large, 1)
    assert list(members(packed + packed)) == [(large, None)] * 2
    assert [e for _, e in members(packed + packed[:-9])] == [None, "gzip: a member is cut off"]
    assert [e for _, e in members(packed + b"\0" * 9)] == [None] and [e for _, e in members(packed + b"rest")][-1] == "gzip: other bytes behind a member"
