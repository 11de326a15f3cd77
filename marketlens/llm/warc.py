"""WARC archives: writing, and a reader that salvages what it can.

Pages are written as records by Spark's text writer, whose line separator is the end of a record;
with ``gzip`` every record is a member of its own, at most ``RECORDS`` to a file. The reader takes whole files,
plain or of any number of gzip members. A record must have a version line, headers with a length, a
block of that length, the closing empty lines and the payload digest it names. Where a check fails, the
reader searches for the next member that unpacks or the next version line, goes on there and
reports the bytes it left out as a gap with the reason. Of a member that is damaged or cut off it keeps the
records that came out whole.

Of records with equal payloads of at least ``LEAST`` bytes the one with the least page_id is a response,
the others revisit it and carry no payload.

Cases. A null html is empty; a null url an empty address; control characters in addresses are percent-
encoded. A page without id is written and read back without one, as a response. Pages that repeat id
and payload are responses both. Files are at most 2 GB, as Spark reads one as one value. Empty tables
make archives without records. Other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import hex_sha256, read
from marketlens.session import new_table_path

LEAST = 100
RECORDS = 500
END = "\r\n\r\n"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
STEP = 1 << 16
EMPTY = "\x1f\x8b\x08" + "\0" * 6 + "\x03\x03" + "\0" * 9  # a member of nothing
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def records(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, payload, digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), hex_sha256(payload).alias("digest"))
    least = (
        rows.where((F.octet_length("payload") >= LEAST) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"))
    )
    later = F.col("page_id") > F.col("first")
    return rows.join(least, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _lines(*headers: tuple[str, Column]) -> Column:
    parts = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*parts, F.lit("\r\n"))


def record_text(rows: DataFrame) -> DataFrame:
    """Records but for their last empty lines."""
    uri = F.coalesce(F.col("url"), F.lit(""))
    for code in (*range(0x21), 0x7F):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    length = F.octet_length("payload").cast("string")
    block = F.concat(F.lit(HTTP + "Content-Length: "), length, F.lit(END), body)
    headers = _lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _urn(F.col("page_id"))),
        ("WARC-Target-URI", uri),
        ("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(headers, block).alias("value"))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [gzip.compress(value.as_py().encode() + END.encode(), 6, mtime=0) for value in batch.column("value")]
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write the pages as WARC files into a folder."""
    rows, options = record_text(records(pages)), {"lineSep": END, "compression": compression}
    if compression == "gzip":
        # A member for each record. The writer's separator can't be nothing, so it is a member of nothing.
        rows = rows.mapInArrow(_zipped, "value binary").select(F.col("value").cast("string").alias("value"))
        options = {"lineSep": EMPTY, "encoding": "ISO-8859-1", "compression": "none"}
    rows.write.options(**options).option("maxRecordsPerFile", RECORDS).text(path)


def _stated(http: bytes) -> int | None:
    """Length of the payload that the HTTP headers state; a revisit leaves the payload itself out."""
    found = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
    return int(found.group(1)) if found else None


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``, where it ends, and what is wrong with it."""
    head = data.find(b"\r\n\r\n", at)
    if not data.startswith(VERSION, at) or head < 0:
        return None, at, "no version line" if head >= 0 else "headers cut off"
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "malformed header"
        headers[name.strip().lower()] = value.strip()
    length = headers.get(b"content-length", b"")
    if not length.isdigit():
        return None, at, "no length"
    begin, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "block cut off" if end + 4 > len(data) else "block of another length"
    block = data[begin:end]
    http, gap, payload = block.partition(b"\r\n\r\n")
    payload = payload if http.startswith(b"HTTP/") and gap else block
    kind, digest = headers.get(b"warc-type", b"").decode("latin-1"), headers.get(b"warc-payload-digest", b"").decode("latin-1")
    if kind != "revisit" and digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
        return None, at, "payload differs from its digest"
    found = {
        "record_type": kind, "record_id": headers.get(b"warc-record-id", b"").decode("latin-1"),
        "uri": headers.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "refers_to": headers[b"warc-refers-to"].decode("latin-1") if b"warc-refers-to" in headers else None,
        "digest": digest.partition(":")[2], "payload": payload, "full_bytes": _stated(http) if kind == "revisit" else len(payload),
    }
    return found, end + 4, ""


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` unpacks to, where it or its good part ends, and what is wrong with it."""
    unpack, parts = zlib.decompressobj(31), []
    while at < len(data) and not unpack.eof:
        step, saved = data[at : at + STEP], unpack.copy()
        try:
            parts.append(unpack.decompress(step))
        except zlib.error:
            unpack = saved
            for i in range(len(step)):  # up to the very byte
                try:
                    parts.append(unpack.decompress(step[i : i + 1]))
                except zlib.error:
                    return b"".join(parts), at + i, "damaged member"
        at += len(step)
    return b"".join(parts), at - len(unpack.unused_data), "" if unpack.eof else "member cut off"


def _parsed(member: int, contents: bytes, damage: str) -> Iterator[dict]:
    """Records and gaps of unpacked contents. Ahead of damage only what has a digest is known to be right."""
    at, lost, why = 0, -1, ""
    while at < len(contents):
        record, end, wrong = parse_record(contents, at)
        if record and damage == "damaged member" and (record["record_type"] == "revisit" or not record["digest"]):
            record, wrong = None, "no digest in a damaged member"
        if record:
            if lost >= 0:
                yield {"gap": why, "member": member, "offset": lost, "length": at - lost}
                lost = -1
            yield record | {"gap": None, "member": member, "offset": at, "length": end - at}
            at = end
            continue
        if lost < 0:
            lost, why = at, wrong
        following = contents.find(VERSION, at + 1)
        at = following if following >= 0 else len(contents)
    if lost >= 0:
        yield {"gap": why, "member": member, "offset": lost, "length": len(contents) - lost}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of a file; offsets are in the file (``member`` -1 or null), or in the unpacked member they name.

    Whatever the file starts with, the search is for the next member or version line, so plain records, members and noise
    may follow one another. What a damaged member unpacks to before the damage is kept, and what follows it is a gap. Inside
    a gap only a member that holds a whole record, or nothing, ends it: others may be part of what was damaged.
    """
    size, at = len(data), 0
    lost, why, side = -1, "", None  # where a gap began, its reason, -1 among plain records
    among_records = not data.startswith(MEMBER[:2])
    members, lines = -1, -1  # the next ones from ``at`` on, searched for once

    def gap(end: int) -> Iterator[dict]:
        if lost >= 0:
            start = min(lost, end - 1)  # damage may be noticed only behind the next member's start
            yield {"gap": why, "member": side, "offset": start, "length": end - start}

    while at < size:
        if members < at:
            members = data.find(MEMBER, at) % (size + 1)  # the file's end if there is none
        if lines < at:
            lines = data.find(VERSION, at) % (size + 1)
        place = min(members, lines)
        if place > at and lost < 0:
            plain = lines < members or (place == size and among_records)
            lost, why, side = at, *(("no version line", -1) if plain else ("no member", None))
        if place == size:
            break
        if place == lines:
            record, end, wrong = parse_record(data, place)
            if record:
                yield from gap(place)
                yield record | {"gap": None, "member": -1, "offset": place, "length": end - place}
                lost, at, among_records = -1, end, True
            else:
                if lost < 0:
                    lost, why, side = place, wrong, -1
                at = place + 1
            continue
        contents, end, wrong = _unpacked(data, place)
        rows = list(_parsed(place, contents, wrong))
        whole = any(row["gap"] is None for row in rows)
        if whole or (not wrong and (lost < 0 or not contents)):
            yield from gap(place)
            yield from rows
            lost, at, among_records = -1, end, False
        if wrong:
            if lost < 0:
                lost, why, side = (min(end, size - 1) if whole else place), "damaged member", None
        if wrong or lost >= 0:
            at = place + 1
    yield from gap(size)


FIELDS = pa.schema(
    [("file", pa.string()), ("member", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.string()),
     ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
     ("digest", pa.string()), ("payload", pa.binary()), ("full_bytes", pa.int64())]
)
SALVAGED = (
    "file string, member long, offset long, length long, gap string, record_type string, record_id string, uri string, "
    "refers_to string, digest string, payload binary, full_bytes long"
)
BATCH_BYTES = 16 << 20


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("path"), batch.column("content")):
            rows, size = [], 0
            for row in salvage(content.as_py()):
                rows.append(row | {"file": file.as_py()})
                size += len(row.get("payload") or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, FIELDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records, and gaps (``gap`` has the reason), of every file in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_read_files, SALVAGED)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path).where("gap IS NULL")

    def page(urn: str) -> Column:
        return F.nullif(F.regexp_extract(urn, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")

    return back.select(
        page("record_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )
