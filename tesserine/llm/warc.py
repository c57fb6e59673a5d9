"""WARC archives: a writer, and a reader that salvages what it can.

A record is one gzip member, so damage to one does not reach the next.  The
reader goes on after a failed check (a member that doesn't inflate, a header
that doesn't parse, a block that isn't followed by its end, a payload whose
digest differs) at the next gzip member or version line that reads well, and
reports the bytes in between as a gap.  Within a member it goes on at the next
version line of the content.  Of a member that doesn't inflate to its end, what
did inflate is read; if it is corrupt and not just cut off, only records whose
payload has the digest that they name are kept, since any byte may be wrong.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_files import read_files, write_records
from .shared import dropped, new_path, written
from .textbytes import column
from .worker import task

#: Payloads of at least so many bytes are stored once; later records revisit the first.
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Bytes of payloads that an archive file holds, about, and that are written at a time; a payload that is larger is written on its own.
FILE_BYTES, BLOB_BYTES = 64 << 20, 16 << 20
#: Stands after each record's member: a member without content, which readers pass over.
SEPARATOR = gzip.compress(b"", mtime=0)
#: Fixed values of the format.
MEMBER, VERSION, PROFILE = b"\x1f\x8b\x08", b"WARC/1.", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_STEP = 1 << 16
#: Last line of a header: CRC-32 of the lines before it, and of a revisit's block, which has no digest of its own.
CHECK = b"X-Header-Check"
_CHECKED = re.compile(rb"X-Header-Check: ([0-9a-f]{8})\Z")
_NUMBER = re.compile(r"[0-9]{1,18}\Z")
_PAGE = re.compile(r"<urn:page:(-?[0-9]{1,19})>\Z")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of a record: a response with its payload, or a revisit of another page's."""
    revisit = refers_to is not None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("X-Payload-Length", len(payload)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in head if v is not None)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    told = "\r\n".join([*lines, f"Content-Length: {len(block)}", ""]).encode()
    return told + b"%s: %08x\r\n\r\n" % (CHECK, zlib.crc32(block, zlib.crc32(told)) if revisit else zlib.crc32(told)) + block + b"\r\n\r\n"


class Damage(Exception):
    pass


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Header, payload and end of the record at a place; Damage if any check fails."""
    if data[at : at + 7] != VERSION:
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("no end of header")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not _NUMBER.match(size):
        raise Damage("no content length")
    if not _NUMBER.match(head.get("x-payload-length", "0")):
        raise Damage("no payload length")
    for name in ("warc-record-id", "warc-refers-to"):
        if (urn := _PAGE.match(head.get(name, ""))) and not -(1 << 63) <= int(urn[1]) < 1 << 63:
            raise Damage("no page number")
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("no end of block")
    block = data[end + 4 : stop]
    http, gap, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    named = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and named.startswith("sha1:") and named[5:] != digest(payload):
        raise Damage("payload digest differs")
    if check := _CHECKED.search(data, at, end):
        told = zlib.crc32(data[at : check.start()])
        if int(check[1], 16) != (zlib.crc32(block, told) if head.get("warc-type") == "revisit" else told):
            raise Damage("header check differs")
    return head, payload, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at a place, and what is wrong with it; if anything is, what inflates and where that ends."""
    inflater, parts, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not inflater.eof and pos < len(data):
            parts.append(inflater.decompress(view[pos : pos + _STEP]))
            pos += _STEP
    except zlib.error as e:
        # The failed call returns nothing: again up to its bytes, and these one by one.
        inflater = zlib.decompressobj(31)
        for k in range(at, pos, _STEP):
            inflater.decompress(view[k : k + _STEP])
        try:
            while True:
                parts.append(inflater.decompress(view[pos : pos + 1]))
                pos += 1
        except zlib.error:
            return b"".join(parts), pos, f"member: {e}"
    if not inflater.eof:
        return b"".join(parts), len(data), "member is cut off"
    return b"".join(parts), min(pos, len(data)) - len(inflater.unused_data), ""


def _content(inner: bytes) -> tuple[list[tuple[dict, bytes]], str]:
    """The records in the content of a member, and the first thing that is wrong with it."""
    found, pos, why = [], 0, ""
    while pos < len(inner):
        try:
            head, payload, pos = _parse(inner, pos)
            found.append((head, payload))
        except Damage as e:
            why = why or str(e)
            nearest = _LINE.search(inner, pos + 1)
            pos = nearest.start() if nearest else len(inner)
    return found, why


def _digested(head: dict) -> bool:
    """Whether the payload of a record that was read has been compared with a digest."""
    return head.get("warc-type") == "response" and head.get("warc-payload-digest", "").startswith("sha1:")


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object, bytes]]:
    """Of a file, in order: ("record", offset, length, header, payload) and ("gap", offset, length, reason, b"").

    Offsets are those of the file; a record within a member has the member's,
    and so has a gap within a member that inflates.  The gap of a member that
    doesn't begins at the last byte before its end or the next member.
    """
    at, gap, why, covered = 0, None, "", 0
    while at < len(data):
        found, broken, inside, end = [], "", "", at
        if data[at : at + 3] == MEMBER:
            inner, end, broken = _inflate(data, at)
            found, inside = _content(inner)
            if broken and broken != "member is cut off":
                found = [r for r in found if _digested(r[0])]
        else:
            try:
                head, payload, end = _parse(data, at)
                found.append((head, payload))
            except Damage as e:
                broken = str(e)
        if broken:
            if found:
                covered = max(covered, end)  # version lines up to there are of content that has been read
            after = next((m.start() for m in _NEXT.finditer(data, at + 1) if m.start() >= covered or m[0] == MEMBER), len(data))
            last = min(end, after) - 1
        else:
            after = last = end
        if found or not (broken or inside):
            if gap is not None:
                yield "gap", gap, at - gap, why, b""
                gap = None
            for head, payload in found:
                yield "record", at, last - at, head, payload
            if broken:
                gap, why = last, broken
            elif inside:
                yield "gap", at, end - at, inside, b""
        elif gap is None:
            gap, why = at, broken or inside
        at = after
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, b""


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row of pages: a response, or a revisit of the smallest id with an equal payload of at least least_bytes.

    Null html is an empty payload, a null url gives no target, rows with a null
    id are always responses, and rows that repeat the smallest id are responses
    each.  Only digests are compared; a payload that very many rows share is
    split between tasks.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    repeated = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    repeated = written(repeated.select(F.col("sha").alias("sha2"), "first"), "payloads")
    # One plan at every size: repeated payloads grow with the pages.
    marked = rows.join(repeated.hint("merge"), F.col("sha") == F.col("sha2"), "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))

    blob = max(1, min(BLOB_BYTES, FILE_BYTES // 4))

    def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for r in zip(*(column(b, c) for c in ("page_id", "url", "payload", "refers_to"))):
                member = gzip.compress(record(*r), 5, mtime=0)
                if held and size + len(r[2]) > blob:
                    yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary())], names=["record"])
                    held, size = [], 0
                held.append(member)
                size += len(r[2])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.binary())], names=["record"])

    # A file is read by one task, so it holds a bounded number of bytes, whatever the sizes of other pages.
    write_records(marked.mapInArrow(task(recorded), "record binary"), path, SEPARATOR, max(1, FILE_BYTES // blob))
    dropped(spark, repeated)


_READ = "file string, offset long, length long, gap string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record that reads well, and one with a reason in `gap` for each gap of bytes that don't.

    payload is null where payloads aren't asked for and of revisits;
    payload_bytes and payload_digest are those of the full payload.
    """

    def number(urn: str | None) -> int | None:
        found = _PAGE.match(urn or "")
        return int(found[1]) if found else None

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _READ.split(", ")])
        for b in batches:
            for file, data in zip(column(b, "path"), column(b, "content")):
                rows, size = [], 0
                for kind, at, length, head, payload in salvage(data):
                    row = {"file": file, "offset": at, "length": length}
                    if kind == "gap":
                        row["gap"] = head
                    else:
                        full = head.get("warc-type") == "response"
                        row |= {"page_id": number(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "refers_to": number(head.get("warc-refers-to"))}
                        row |= {"payload_bytes": len(payload) if full else int(head.get("x-payload-length", 0)), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": payload if payloads and full else None}
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read_files(spark, path).mapInArrow(task(records), _READ)


def read_with_quarantine(spark: SparkSession, path: str, quarantine: str, payloads: bool = False) -> DataFrame:
    """The records of archives; the gaps of bytes that don't read are logged and stand as JSON in the quarantine folder, which is only made if there are any."""
    rows = written(read_archives(spark, path, payloads), "warc-rows")
    gaps = rows.where("gap is not null").select("file", "offset", "length", F.col("gap").alias("reason"))
    n, size = gaps.agg(F.count("*"), F.sum("length")).first()
    if n:
        logging.getLogger(__name__).warning("%d gaps of %d bytes quarantined in %s", n, size, quarantine)
        gaps.write.json(quarantine)
    return rows.where("gap is null").drop("gap")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_with_quarantine(spark, path, new_path(spark, "warc-gaps")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _oracle(least: int = LEAST_BYTES) -> str:
    """Digests in base 32 from hexadecimal ones: five digits are four symbols."""
    symbols = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0x' || h[{5 * k + 1}:{5 * k + 5}])::INT >> {shift} & 31) + 1]" for k in range(8) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
 SELECT page_id, size AS payload_bytes, {symbols} AS payload_digest, CASE WHEN size >= {least} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN size >= {least} AND page_id <> first THEN first END AS refers_to FROM f"""


QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": _oracle()}
