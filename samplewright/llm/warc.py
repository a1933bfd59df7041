"""WARC archives: writing pages as response and revisit records, and reading archives back.

A record is a line of text to Spark's text writer, whose line separator here is the two line ends that close a WARC record, so the
writer's own commit protocol yields plain gzip archives. Payloads are framed in chunks (Transfer-Encoding: chunked). A block
above `SEGMENT` bytes is split: the first part is the response record, the others continuation records that name its id as
their origin, number their segment, and, in the last one, give the total length. Reading decodes whole records in place; only
segments are shuffled, grouped by origin, ordered by number, checked against the total length and joined.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.operators.skew import BROADCAST_ROWS, salted_join
from samplewright.session import cut, scratch_path

END = b"\r\n\r\n"
SEGMENT = 1 << 15
CHUNK = 1 << 13
LEAST_REVISIT = 1000
FILE_BYTES = 32 << 20
DATE = "2000-01-01T00:00:00Z"
_PAGE = "urn:samplewright:page:"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def cuts(data: bytes, size: int) -> list[int]:
    """Ends of parts of at most `size` bytes (4 at least) that split no UTF-8 character."""
    ends, at = [], 0
    while len(data) - at > size:
        end = at + size
        while end > at + size - 4 and data[end] & 0xC0 == 0x80:
            end -= 1
        ends.append(end)
        at = end
    return [*ends, len(data)]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out, at = [], 0
    for end in cuts(payload, size) if payload else []:
        out += [f"{end - at:x}\r\n".encode(), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[at:at + size])
        at += size + 2


def _digest32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _safe(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in url or "")


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, keep: int | None, record_id: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the closing line ends. `keep` is the page a revisit refers to."""
    shared = [f"WARC-Date: {DATE}"] + ([f"WARC-Target-URI: {_safe(url)}"] if url else []) + ([f"Page-Id: {page_id}"] if page_id is not None else [])
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"

    def record(kind: str, block: bytes, number: str, extra: list[str]) -> bytes:
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{number}>", *shared, *extra, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + END + block

    marks = [f"WARC-Payload-Digest: {_digest32(digest)}", "Content-Type: application/http; msgtype=response"]
    if keep is not None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", block, record_id, [*marks, profile, f"WARC-Refers-To: <{_PAGE}{keep}>"])
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    ends = cuts(block, segment)
    yield record("response", block[:ends[0]], record_id, [*marks, *(["WARC-Segment-Number: 1"] if len(ends) > 1 else [])])
    for i in range(1, len(ends)):
        total = [f"WARC-Segment-Total-Length: {len(block)}"] if i + 1 == len(ends) else []
        extra = [f"WARC-Segment-Number: {i + 1}", f"WARC-Segment-Origin-ID: <{record_id}>", *total]
        yield record("continuation", block[ends[i - 1]:ends[i]], f"{record_id}:{i + 1}", extra)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "html", "digest", "keep", "row"]
    for batch in batches:
        held, size = [], 0
        for page_id, url, html, digest, keep, row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            for r in records(page_id, url, html.encode(), digest, keep, f"{_PAGE}{page_id}:{row}"):
                held.append(r.decode())
                size += len(r)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write a record per row of `pages` (page_id, url, html; other columns are left out) as gzip archives under `path`.

    Of rows with equal payloads of at least `least` bytes those with the largest page_id are responses and the others revisits
    of it; a null page_id is smaller than any. A null html is empty. Pages below `least` bytes meet nothing; of the others only
    digests are shuffled, and payloads that occur on several pages, one row each, are looked up. Empty tables write no record.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html"))
    slim = rows.select("page_id", "digest", "bytes")
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    repeated = cut(
        slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and most is not null").select("digest", "most"))
    large = rows.where(F.col("bytes") >= least)
    # A row is a digest and a number. Within a checked number of rows no html moves; beyond it that of large pages does, hot digests spread.
    few = repeated.count() <= BROADCAST_ROWS
    met = large.join(F.broadcast(repeated), "digest", "left") if few else salted_join(large, repeated, "digest", "left")
    keep = F.when(~F.col("page_id").eqNullSafe(F.col("most")), F.col("most"))
    columns = ["page_id", "url", "html", "digest"]
    both = met.select(*columns, keep.alias("keep")).unionAll(
        rows.where(F.col("bytes") < least).select(*columns, F.lit(None).cast("bigint").alias("keep")))
    numbered = both.withColumn("row", F.monotonically_increasing_id())
    each = max(1, FILE_BYTES * size["n"] // max(1, size["bytes"] or 0)) if size["n"] else 1
    (numbered.mapInArrow(_written, "value string").write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", each).text(path))


def _unzip(content: bytes) -> bytes:
    """Plain, or gzip of one or many members."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join([*out, content])


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record; blocks are taken by length, whatever they hold."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        at = end + len(END)
        size = int(headers["content-length"])
        block = data[at:at + size]
        if len(block) != size or data[at + size:at + size + len(END)] != END:
            raise ValueError("a record does not end where it says")
        yield headers, block
        at += size + len(END)


def payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and the payload, chunks joined."""
    head, _, body = block.partition(END)
    headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def _answer(headers: dict[str, str], block: bytes) -> dict:
    """The result row of a whole record; a payload that does not have its digest is an error."""
    page = headers.get("page-id")
    wanted = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
    row = {"page_id": int(page) if page is not None else None, "payload_digest": wanted, "record_type": headers["warc-type"], "refers_to": None}
    http, body = payload(block)
    if row["record_type"] == "revisit":
        return row | {"payload_bytes": int(http["content-length"]), "refers_to": int(headers["warc-refers-to"].strip("<>").rpartition(":")[2])}
    if hashlib.sha1(body).hexdigest() != wanted:
        raise ValueError(f"page {page}: the payload does not have its digest")
    return row | {"payload_bytes": len(body)}


_PART = "origin string, number int, total bigint, head string, block binary"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to whole records' rows and to segments still to be joined."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            held, size = [], 0
            for headers, block in parse(_unzip(content.as_py())):
                number = headers.get("warc-segment-number")
                if number is None:
                    if headers["warc-type"] in ("response", "revisit"):
                        held.append(_answer(headers, block))
                else:
                    total = headers.get("warc-segment-total-length")
                    first = int(number) == 1
                    head = "\n".join(f"{k}\t{v}" for k, v in headers.items()) if first else None
                    held.append({"origin": headers["warc-record-id" if first else "warc-segment-origin-id"], "number": int(number),
                                 "total": int(total) if total else None, "head": head, "block": block})
                    size += len(block)
                if size > 4 << 20 or len(held) > 5000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)


def _joined(group: pa.Table) -> pa.Table:
    """The record that an origin's segments make up."""
    parts = sorted(group.to_pylist(), key=lambda p: p["number"])
    block = b"".join(p["block"] for p in parts)
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
        raise ValueError(f"{parts[0]['origin']}: segments are missing")
    row = _answer(dict(line.split("\t", 1) for line in parts[0]["head"].split("\n")), block)
    schema = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type") else pa.int64()) for n in _NAMES])
    return pa.Table.from_pylist([row], schema=schema)


def read(spark, path: str) -> DataFrame:
    """One row per page of the archives under `path`: page_id, payload_bytes, payload_digest (hex), record_type, refers_to."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_read, f"{RESULT}, {_PART}")
    whole = rows.where("origin is null").select(*_NAMES)
    parts = rows.where("origin is not null").select("origin", "number", "total", "head", "block")
    return whole.unionAll(parts.groupBy("origin").applyInArrow(_joined, RESULT))


def written_and_read(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
