"""WARC archives: writing with segments, and reading with reassembly.

A page's record holds an HTTP response in chunked transfer framing. Blocks
longer than a segment go on in continuation records. The reader walks the files
by Content-Length, groups the parts of a segmented record by the identifier of
its first part, orders them by segment number, verifies the total length and
decodes the chunks. Files are written and read by Spark, in the shared folder,
and hold a bounded number of records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 512
MIN_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:terrafold:page")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk is cut off")
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(framed) or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record but for the last line end, which the text writer adds."""
    lines = [f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return VERSION + "".join(lines).encode() + b"\r\n" + block + b"\r\n"


def record_id(digest: str, page_id, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{digest}:{page_id}:{nth}')}>"


def page_records(page_id, url, payload: bytes, first_id, revisit: bool, nth: int, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    digest = base32_sha1(payload)
    # a URL holds no control characters or spaces; they are percent-encoded
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    own = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(digest, page_id, nth + 1)), *own, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(digest, first_id))], b"")
        return
    rid, block = record_id(digest, page_id, nth), _HTTP + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    many = len(parts) > 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *own, ("Content-Type", "application/http;msgtype=response"), ("WARC-Segment-Number", 1 if many else None)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(digest, f"{page_id}/{nth}/{k}")), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Writes pages(page_id, url, html) to archives under path.

    Of pages whose payloads have the same SHA-1 and length, that with the
    smallest page_id is a response and others revisit it; payloads shorter than
    min_revisit_bytes are all responses. Rows that repeat the smallest page_id
    are each responses. A null html is an empty payload, a null url has no
    header, a null page_id is never smallest unless all of a group are null.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("h", F.sha1("html")).withColumn("n", F.octet_length("html"))
    firsts = p.where(F.col("n") >= min_revisit_bytes).groupBy("h", "n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("c")).where("c > 1")
    j = p.join(firsts.drop("c"), ["h", "n"], "left").select("page_id", "url", "html", "first_id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for b in batches:
            out = []
            for page_id, url, html, first in zip(b.page_id.array, b.url, b.html, b.first_id.array):
                page_id, first = None if pd.isna(page_id) else int(page_id), None if pd.isna(first) else int(first)
                payload = html.encode()
                revisit = first is not None and first != page_id
                nth = seen.get(k := f"{hashlib.sha1(payload).hexdigest()}{page_id}", 0)
                seen[k] = nth + 1
                out += page_records(page_id, url, payload, first, revisit, nth, segment_bytes)
            yield pd.DataFrame({"record": out})

    records = j.mapInPandas(build, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", "\r\n").option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


#: Bytes that the decompressor is fed at once.
_FED = 1 << 14


def members(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """What an archive's gzip members hold, one by one, with what is wrong with it; one that isn't compressed comes as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content, None
        return
    whole, begin = memoryview(content), 0
    while whole[begin : begin + 2] == b"\x1f\x8b":
        # in small pieces, so that what is left behind a member is never copied as a whole
        d, out, at = zlib.decompressobj(31), [], begin
        try:
            while not d.eof and at < len(whole):
                out.append(d.decompress(whole[at : at + _FED]))
                at = min(at + _FED, len(whole))
        except zlib.error as e:
            yield b"", f"gzip: {e}"
            return
        yield b"".join(out), None if d.eof else "gzip: a member is cut off"
        begin = at - len(d.unused_data)
    if bytes(whole[begin:]).strip(b"\0"):
        yield b"", "gzip: other bytes behind a member"


def walk_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (names in lower case), block and error of each record; the walk ends at the first record whose end can't be known."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        n = headers.get("content-length", "")
        if end < 0 or not lines[0].startswith("WARC/") or not n.isdigit():
            yield headers, b"", f"no record begins at byte {at}"
            return
        at = end + 4
        stop = at + int(n)
        if data[stop : stop + 4] != b"\r\n\r\n":
            yield headers, b"", "a record is cut off"
            return
        yield headers, data[at:stop], None
        at = stop + 4


def response_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response; a ValueError says what is wrong with it."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP response has no end of its headers")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


_PARSED = "record_id string, origin_id string, record_type string, segment int, total_length long, page_id long, digest string, refers_record string, block binary, payload_bytes long, payload_digest string, payload binary, error string"
_NAMES = [x.split()[0] for x in _PARSED.split(", ")]
_INTS = {"segment": "Int32", "total_length": "Int64", "page_id": "Int64", "payload_bytes": "Int64"}


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record from (number, total length, block); parts that repeat must be equal."""
    by: dict[int, bytes] = {}
    total = None
    for number, length, block in parts:
        if by.setdefault(number, block) != block:
            raise ValueError(f"segment {number} occurs with different blocks")
        total = length if length is not None else total
    whole = b"".join(by[k] for k in sorted(by))
    if sorted(by) != list(range(1, len(by) + 1)) or total != len(whole):
        raise ValueError(f"segments {sorted(by)} have {len(whole)} bytes, not {total}")
    return whole


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _row(h: dict[str, str], block: bytes, error: str | None, payload: bool) -> list:
    rid, kind = h.get("warc-record-id"), h.get("warc-type")
    number = _number(h.get("warc-segment-number"))
    row = [rid, h.get("warc-segment-origin-id", rid), kind, None, None, _number(h.get("x-page-id")), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to"), None, None, None, None, error]
    if error is None and (rid is None or kind is None):
        row[-1] = "no record id or type"
    elif error is None and number is not None:
        row[3], row[4], row[8] = number, _number(h.get("warc-segment-total-length")), block
    elif error is None and kind == "response":
        try:
            body = response_payload(block)
            row[9:12] = len(body), base32_sha1(body), body if payload else None
        except ValueError as e:
            row[-1] = str(e)
    return row


def archive_rows(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records under path, whole or reassembled, those that can't be read with an error; see read_warc()."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                rows = []
                for data, wrong in members(content):
                    rows += [_row(*x, payload) for x in walk_records(data)]
                    if wrong:
                        rows.append(_row({}, b"", wrong, payload))
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES).astype(_INTS)

    def join_parts(g: pd.DataFrame) -> pd.DataFrame:
        first = g[g.record_type != "continuation"].copy()
        try:
            if first.empty:
                raise ValueError("the first segment is missing")
            body = response_payload(reassembled([(int(n), None if pd.isna(t) else int(t), bytes(b)) for n, t, b in zip(g.segment, g.total_length, g.block)]))
        except ValueError as e:
            bad = first if len(first) else g.head(1).copy()
            return bad.assign(block=None, error=str(e))
        first["payload_bytes"], first["payload_digest"], first["payload"] = len(body), base32_sha1(body), [body if payload else None] * len(first)
        return first.assign(block=None)

    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = stored(files.mapInPandas(parse, _PARSED), "warc-records")
    whole = parsed.where("segment is null")
    parts = parsed.where("segment is not null").groupBy("origin_id").applyInPandas(join_parts, _PARSED)
    return whole.unionByName(parts)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """record_id, record_type, page_id, digest, refers_record, payload_bytes,
    payload_digest and payload (null unless asked for) of the responses and
    revisits under path. A revisit has no payload of its own.

    Files may be plain or gzip, with one member for all records or one for each.
    Records that can't be read (cut off, a segment missing or with different
    blocks, a bad chunk) are not among these, but in rejected_records(); what
    stands behind a record whose length is unknown is lost with it. Records of
    other types have no payload. An empty file has no rows.
    """
    rows = archive_rows(spark, path, payload).where("error is null")
    return rows.select("record_id", "record_type", "page_id", "digest", "refers_record", "payload_bytes", "payload_digest", "payload")


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, page_id and error of the records under path that can't be read."""
    return archive_rows(spark, path, False).where("error is not null").select("record_id", "record_type", "page_id", "error")


def op2_warc(spark, sf_dir):
    """Every row of pages, written and read back. A revisit whose response can't be read has no payload."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    r = stored(read_warc(spark, path, payload=False).drop("payload"), "warc-read")
    responses = r.where("record_type = 'response'")
    original = responses.groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"))
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = r.where("record_type = 'revisit'").select("page_id", "digest", "record_type", "refers_record")
    again = again.join(original, (F.col("refers_record") == F.col("record_id")) & (F.col("digest") == F.col("payload_digest")), "left")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
