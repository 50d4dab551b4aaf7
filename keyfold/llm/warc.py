"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: equal payloads are stored once, by the page of the smallest id; the others refer to it. A
record whose block is longer than ``segment`` bytes continues in further records, which carry the
origin's identifier and their number, the last also the total length. Responses use chunked transfer
framing. Every record is a gzip member of its own, as readers of archives expect. The archives go
through Spark's text sink, so any file system that Spark writes to will do: the last byte of a member
of less than 16 MiB is zero, and that byte is the sink's line end.

Reading: every archive is cut into members and records by their lengths, one after the other. Segments,
which may lie in different archives, are grouped by their origin, ordered by number and held against
the total length; then HTTP headers are split off, chunked framing is decoded and the payload's digest
compared. ``intact`` is false, and nothing is raised, for a record with a missing segment, a wrong total,
no valid length, a wrong digest, or cut off by the end of its archive; its payload is null unless the
block is whole. Of an archive with a damaged member the records before it are read. A revisit is intact
if the record it refers to is, and has its digest.

Null html counts as empty. Identifiers come from page and payload, so a task that runs again names its
records alike. Rows that share the smallest page_id of equal payloads are all responses, and rows alike
in page and payload share an identifier; each is read back. A null page_id is written as such and refers
to nothing unless another page has the same payload. Without pages there is no archive and no record.
Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.frames import lean, quoted, shared_folder, written

SEGMENT, CHUNK, ARCHIVE_RECORDS = 64 << 10, 8 << 10, 4096
#: Smaller payloads are always stored.
LEAST = 0
_END = "\r\n\r\n"
_BATCH = 8 << 20
_MEMBER = 16 << 20
_NAMES = uuid.UUID("6f4f8a52-7d0c-4d31-9b7f-3a51f7a4c8d0")


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '/'.join(map(str, parts)))}>"


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload inside chunked framing; None if the framing is broken. Chunk extensions and trailers are left out."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        head = body[at:line].split(b";")[0].strip()
        if not head or not all(c in b"0123456789abcdefABCDEF" for c in head):
            return None
        size = int(head, 16)
        if size == 0:
            return b"".join(out)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            return None
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields if v is not None) + _END).encode()


def _one_line(text: str | None) -> str | None:
    return text and text.replace("\r", "%0D").replace("\n", "%0A")


def page_records(page: object, url: str | None, payload: bytes, first: bool, refers: object, date: str, segment: int) -> list[bytes]:
    """The records of one page, each with the line that ends it. first: the page's own payload is stored; else refers has the page that stores it."""
    own = digest(payload)
    common = [("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("X-Page-Id", _one_line(None if page is None else str(page)))]
    if not first:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}".encode()
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", _urn("revisit", page, url, own)), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(1, refers, own)), ("X-Refers-To-Page-Id", refers), ("WARC-Payload-Digest", f"sha1:{own}")]
        return [_head([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + _END.encode()]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{_END}".encode() + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = []
    for k, part in enumerate(parts, 1):
        if k == 1:
            fields = [("WARC-Type", "response"), ("WARC-Record-ID", _urn(1, page, own)), *common, ("WARC-Payload-Digest", f"sha1:{own}"), ("WARC-Segment-Number", 1 if len(parts) > 1 else None), ("Content-Type", "application/http; msgtype=response")]
        else:
            total = len(block) if k == len(parts) else None
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", _urn(k, page, own)), ("WARC-Date", date), ("WARC-Segment-Origin-ID", _urn(1, page, own)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)]
        out.append(_head([*fields, ("Content-Length", len(part))]) + part + _END.encode())
    return out


def member(record: bytes) -> bytes:
    """A record as a gzip member without its last byte, which is zero."""
    if len(record) >= _MEMBER:
        raise ValueError(f"a record of {len(record)} bytes; take shorter segments")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (squeeze.compress(record) + squeeze.flush())[:-1]


def write_warc(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages under path."""
    rows = pages.select(quoted(id_col).alias("page"), quoted(url_col).alias("url"), F.encode(F.coalesce(quoted(html_col), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    same = rows.filter(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("k"))
    # Joined by the decoded key, so that both sides get an exchange and a payload of very many pages can be split.
    same = same.filter("k > 1 and first is not null").select(F.unhex("key").alias("q"), "first")
    joined = rows.join(same, F.unhex("key") == F.col("q"), "left")
    repeat = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    ready = joined.select("page", "url", "payload", (~repeat).alias("own"), F.when(repeat, F.col("first")).alias("refers"))

    def run(batches):
        for batch in lean(batches):
            out, size = [], 0
            for r in zip(*(batch.column(c) for c in ("page", "url", "payload", "own", "refers")), strict=True):
                for record in page_records(*(x.as_py() for x in r), date, segment):
                    out.append(member(record))
                    size += len(out[-1])
                if size >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    ready.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", "none").text(path)


def _members(archive: bytes) -> Iterator[bytes]:
    """What the gzip members of an archive hold, one after the other; an archive that is not compressed, whole. A damaged member gives what can be read of it, and is the last."""
    if not archive.startswith(b"\x1f\x8b"):
        yield archive
        return
    view, at = memoryview(archive), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        try:
            while not one.eof and at < len(view):
                parts.append(one.decompress(view[at : at + SEGMENT]))
                at = min(at + SEGMENT, len(view))
        except zlib.error:
            at = len(view)
        yield b"".join(parts)
        at -= len(one.unused_data) if one.eof else 0


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields, block) of every record in a run of records; block: None if it has no valid length or is cut off.

    After such a record reading goes on where the next one seems to start.
    """
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = _number(fields.get("content-length"))
        if size is None or size < 0 or end + 4 + size > len(content):
            yield fields, None
            at = content.find(b"\r\n\r\nWARC/", end + 4) + 4
            if at < 4:
                return
            continue
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.lstrip("-").isdigit() and len(text) < 18 else None


def _payload(block: bytes) -> tuple[dict[str, str], bytes | None]:
    """HTTP fields and payload of a block."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return {}, None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    body = block[end + 4 :]
    return fields, unchunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


_PARSED = "record_id string, record_type string, target_uri string, page_id string, segment long, origin string, total long, digest string, refers_to string, refers_to_page string, block binary"
RECORD = "record_id string, record_type string, target_uri string, page_id string, refers_to string, refers_to_page string, payload binary, payload_bytes long, payload_digest string, intact boolean"
_FIELDS = ("record_id", "record_type", "target_uri", "page_id", "digest", "refers_to", "refers_to_page")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _parsed(archives: DataFrame) -> DataFrame:
    def row(f: dict[str, str], block: bytes | None) -> tuple:
        record, number = f.get("warc-record-id"), f.get("warc-segment-number")
        given = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        segment = None if number is None else _number(number) or 0
        return (record, f.get("warc-type"), f.get("warc-target-uri"), f.get("x-page-id"), segment, f.get("warc-segment-origin-id", record), _number(f.get("warc-segment-total-length")), given, f.get("warc-refers-to"), f.get("x-refers-to-page-id"), block)

    def run(batches):
        for batch in lean(batches):
            for archive in batch.column("content"):
                rows, size = [], 0
                for part in _members(archive.as_py()):
                    for fields, block in records(part):
                        rows.append(row(fields, block))
                        size += len(block or b"") + 300
                        if size >= _BATCH:
                            yield _batch(rows, _PARSED)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, _PARSED)

    return archives.mapInArrow(run, _PARSED)


def _assembled(r: dict) -> list[tuple]:
    """A row for each record of one identifier; parts holds its segments (number, block), of repeated records several times."""
    parts = sorted(r["parts"], key=lambda p: p["segment"])
    numbers = [p["segment"] for p in parts]
    copies = max(1, numbers.count(1))
    once = parts[::copies]
    alike = all(p["segment"] == q["segment"] and p["block"] == q["block"] for k, q in enumerate(once) for p in parts[k * copies : (k + 1) * copies])
    base = tuple(r[c] for c in ("record_id", "record_type", "target_uri", "page_id", "refers_to", "refers_to_page"))
    whole = alike and [p["segment"] for p in once] == list(range(1, len(once) + 1)) and all(p["block"] is not None for p in once)
    block = b"".join(p["block"] for p in once) if whole else b""
    whole = whole and (r["total"] is None and len(once) == 1 or r["total"] == len(block))
    fields, payload = _payload(block) if whole else ({}, None)
    if r["record_type"] == "revisit":
        size = _number(fields.get("content-length"))
        out = (*base, None, size, r["digest"], whole and size is not None and r["digest"] is not None)
    elif payload is None:
        out = (*base, None, None, None, False)
    else:
        own = digest(payload)
        out = (*base, payload, len(payload), own, r["digest"] in (None, own))
    return [out] * copies


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of all archives under path, segments put together; see RECORD. A revisit's own record decides here; resolved() also looks at what it refers to."""
    parsed = _parsed(spark.read.format("binaryFile").load(path).filter("length > 0").select("content"))
    single = parsed.filter("segment is null").select(*_FIELDS, "total", F.array(F.struct(F.lit(1).cast("long").alias("segment"), "block")).alias("parts"))
    origin = F.col("segment") == 1
    grouped = parsed.filter("segment is not null").groupBy("origin").agg(
        *(F.max(F.when(origin, F.col(c))).alias(c) for c in _FIELDS), F.coalesce(F.max("total"), F.lit(-1).cast("long")).alias("total"), F.collect_list(F.struct("segment", "block")).alias("parts"),
    )
    joined = grouped.select(F.coalesce("record_id", "origin").alias("record_id"), F.coalesce("record_type", F.lit("continuation")).alias("record_type"), *_FIELDS[2:], "total", "parts")

    def run(batches):
        for batch in lean(batches):
            rows = [x for r in batch.to_pylist() for x in _assembled(r)]
            if rows:
                yield _batch(rows, RECORD)

    return single.unionByName(joined).mapInArrow(run, RECORD)


def resolved(found: DataFrame) -> DataFrame:
    """Records (of RECORD, without payloads) whose revisits are intact only if what they refer to is, and has their digest."""
    found = written(found)
    stored = found.filter("record_type <> 'revisit'").groupBy("record_id").agg(F.min("intact").alias("stored"), F.min("payload_digest").alias("stored_digest")).withColumnRenamed("record_id", "q")
    sound = F.col("intact") & F.coalesce("stored", F.lit(False)) & F.coalesce(F.col("stored_digest") == F.col("payload_digest"), F.lit(False))
    revisits = found.filter("record_type = 'revisit'").join(stored, F.col("refers_to") == F.col("q"), "left").withColumn("intact", sound)
    return found.filter("record_type <> 'revisit' or record_type is null").unionByName(revisits.select(found.columns))


def archived(pages: DataFrame, segment: int = SEGMENT, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of the pages after a way through archives in the shared folder; refers_to: a page."""
    path = shared_folder(pages.sparkSession)
    write_warc(pages, path, segment, least, id_col=id_col, url_col=url_col, html_col=html_col)
    kind = pages.select(quoted(id_col)).schema[0].dataType
    found = resolved(read_warc(pages.sparkSession, path).drop("payload"))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast(kind).alias("refers_to"), "intact")
