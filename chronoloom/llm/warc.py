"""Legacy archive converter: ARC 1 and 2 to WARC.

An archive is a row (archive, content): plain records, or gzip members of one record
each, a few megabytes together. Archives are table rows and not files, as the shared
store may be one that only Spark reaches; ``content`` is byte for byte what a file would
hold. Plain ARC archives are stored under the table's own compression, which sees whole
archives and so does better than members.

ARC records begin with one header line whose fields its version block announces:

    version 1: URL, IP address, date, content type, length
    version 2: URL, IP address, date, content type, result code, checksum, location,
               offset, file name, length

The length is trusted: a record's bytes are counted, never searched for. WARC ids are
UUIDs of archive and offset, dates become ISO 8601, the type follows from scheme and
content, digests are SHA-1 in base 32. Of records with equal payloads, the one with
the largest key (then the largest record id) is the response; the others become
revisits that keep their HTTP header and refer to it by its record id. Reading back
resolves that id among the records read.

Edge cases: null html is an empty payload; null urls become ``urn:none``; white space in
urls is percent-encoded; a null key sorts first; of repeated rows one is the response;
an empty table gives no archive and no row. A record whose header or length is broken
ends its archive's reading with ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import materialise, spread_join, table, utf8

ARCHIVE_BYTES = 4 << 20
LEVEL = 6
#: Fixed values of the ARC format: the fields of a header line, by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
ORIGIN = "InternetArchive"
DATE = "20200101000000"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Source-Key"


@dataclass
class ArcRecord:
    offset: int
    version: int
    fields: dict[str, str]
    content: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def member(data: bytes) -> bytes:
    """One gzip member, the same for the same bytes."""
    return gzip.compress(data, LEVEL, mtime=0)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_response(payload: bytes, key: int | None) -> bytes:
    named = b"" if key is None else f"{KEY}: {key}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def http_parts(content: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields, by lower-case name, and the payload of an HTTP message."""
    head, _, payload = content.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def arc_url(url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "urn:none"


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 {ORIGIN}\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain"}
    return arc_line(version, values, body) + body + b"\n"


def arc_line(version: int, values: dict[str, str], content: bytes) -> bytes:
    values = values | {"Archive-length": str(len(content))}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def arc_record(version: int, name: str, offset: int, url: str | None, content: bytes) -> bytes:
    values = {"URL": arc_url(url), "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html"}
    values |= {"Result-code": "200", "Offset": str(offset), "Filename": name, "Checksum": f"{zlib.crc32(content):08x}"}
    return arc_line(version, values, content) + content + b"\n"


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each gzip member; content that is not compressed is one."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at = 0
    while at < len(content):
        unzip = zlib.decompressobj(wbits=31)
        # a slice of the rest would copy it for every member
        view, out, fed = memoryview(content), [], at
        while not unzip.eof and fed < len(content):
            step = view[fed : fed + 65536]
            out.append(unzip.decompress(step))
            fed += len(step)
        if not unzip.eof:
            raise ValueError(f"cut gzip member at {at}")
        yield at, b"".join(out)
        at = fed - len(unzip.unused_data)


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of one ARC archive, the version block first."""
    fields: tuple[str, ...] | None = None
    version = 0
    for at, data in members(content):
        begin = 0
        while begin < len(data):
            if data[begin : begin + 1] == b"\n":
                begin += 1
                continue
            end = data.find(b"\n", begin)
            parts = data[begin : end if end >= 0 else len(data)].decode("utf-8").split(" ")
            if fields is None:
                # the version block is read by version 1's five fields or version 2's ten
                if not parts[0].startswith("filedesc://") or len(parts) not in map(len, ARC_FIELDS.values()):
                    raise ValueError(f"no version block at {at}")
            elif len(parts) != len(fields):
                raise ValueError(f"header of {len(parts)} fields at {at}, version {version} has {len(fields)}")
            if not parts[-1].isdigit():
                raise ValueError(f"no length at {at}")
            length = int(parts[-1])
            body = data[end + 1 : end + 1 + length]
            if len(body) < length:
                raise ValueError(f"record at {at} ends early")
            if fields is None:
                version = int(body.split(b" ", 1)[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"unknown ARC version {version}")
                fields = ARC_FIELDS[version]
            yield ArcRecord(at + begin if content[:2] != b"\x1f\x8b" else at, version, dict(zip(fields, parts, strict=False)), body)
            begin = end + 1 + length


def iso_date(arc_date: str) -> str:
    """14 digits (or the 12 or 8 of early archives) as ISO 8601."""
    d = (arc_date + "000000")[:14] if len(arc_date) in (8, 10, 12, 14) and arc_date.isdigit() else DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_urn(archive: str, offset: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{offset}").urn


def synthesised(archive: str, record: ArcRecord, page: bool = False) -> WarcRecord:
    """The WARC record that says what an ARC record says; page: it is not the version block, whatever its URL."""
    f, content = record.fields, record.content
    headers = {"WARC-Record-ID": f"<{record_urn(archive, record.offset)}>", "WARC-Date": iso_date(f["Archive-date"])}
    if not page and f["URL"].startswith("filedesc://"):
        block = b"software: chronoloom\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/%d\r\n" % record.version
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": archive, "Content-Type": "application/warc-fields"}
    elif content.startswith(b"HTTP/"):
        block = content
        headers |= {"WARC-Type": "response", "WARC-Target-URI": f["URL"], "Content-Type": "application/http; msgtype=response"}
        headers["WARC-Payload-Digest"] = "sha1:" + sha1_base32(http_parts(content)[1])
    else:
        block = content
        kind = "text/dns" if f["URL"].startswith("dns:") else f["Content-type"]
        headers |= {"WARC-Type": "resource", "WARC-Target-URI": f["URL"], "Content-Type": kind}
        headers["WARC-Payload-Digest"] = "sha1:" + sha1_base32(content)
    if f["IP-address"] not in ("0.0.0.0", "-"):
        headers["WARC-IP-Address"] = f["IP-address"]
    headers["WARC-Block-Digest"] = "sha1:" + sha1_base32(block)
    return WarcRecord(headers, block)


def as_revisit(record: WarcRecord, refers_to: str) -> WarcRecord:
    """A response without its payload, referring to the record that has it."""
    block = record.block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    headers["WARC-Block-Digest"] = "sha1:" + sha1_base32(block)
    return WarcRecord(headers, block)


def warc_bytes(record: WarcRecord) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in record.headers.items()), b"Content-Length: %d" % len(record.block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + record.block + b"\r\n\r\n"


def read_warc(content: bytes) -> Iterator[WarcRecord]:
    """The records of one WARC archive."""
    for at, data in members(content):
        begin = 0
        while begin < len(data):
            end = data.find(b"\r\n\r\n", begin)
            lines = data[begin:end].decode("utf-8").split("\r\n")
            if end < 0 or not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at {at}")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            length = int(headers.pop("Content-Length"))
            block = data[end + 4 : end + 4 + length]
            if len(block) < length:
                raise ValueError(f"record at {at} ends early")
            yield WarcRecord(headers, block)
            begin = end + 4 + length + 4


def _archives(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["archive", "content"])


def write_arcs(pages: DataFrame, zipped: bool = False) -> DataFrame:
    """Archives of pages (key, url, payload): version 1 and 2 by turns."""
    packed, ending = (member, ".arc.gz") if zipped else (bytes, ".arc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, name, version, out, size = TaskContext.get().partitionId(), 0, "", 1, [], 0
        for batch in batches:
            for key, url, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                if not out:
                    version, name = 1 + n % 2, f"part-{part:05d}-{n:05d}{ending}"
                    out = [packed(arc_version_block(version, name))]
                    size = len(out[0])
                out.append(packed(arc_record(version, name, size, url.as_py(), http_response(payload.as_py(), key.as_py()))))
                size += len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archives([name], [b"".join(out)])
                    out, n = [], n + 1
        if out:
            yield _archives([name], [b"".join(out)])

    return pages.select("key", "url", "payload").mapInArrow(write, "archive string, content binary")


CONVERTED = "key long, record string, payload_sha256 string, warc binary"


def convert_arcs(arcs: DataFrame, whole: bool = True) -> DataFrame:
    """The WARC records of ARC archives but for warcinfo, one row each; warc is a gzip member, null unless whole."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                arcs_read = read_arc(content.as_py())
                next(arcs_read, None)  # the version block; a page's own url may begin like it
                for arc in arcs_read:
                    fields, payload = http_parts(arc.content)
                    key = fields.get(KEY.lower())
                    if whole:
                        record = synthesised(name.as_py(), arc, page=True)
                        rows.append((int(key) if key else None, record.headers["WARC-Record-ID"][1:-1], hashlib.sha256(payload).hexdigest(), member(warc_bytes(record))))
                    else:
                        rows.append((int(key) if key else None, record_urn(name.as_py(), arc.offset), hashlib.sha256(payload).hexdigest(), None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "record", "payload_sha256", "warc"])

    return arcs.select("archive", "content").mapInArrow(convert, CONVERTED)


def write_warcs(records: DataFrame) -> DataFrame:
    """WARC archives of converted records that know the response of their payload (first_record)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, name, out, size = TaskContext.get().partitionId(), 0, "", [], 0
        for batch in batches:
            for record, warc, first_record in zip(*batch.columns, strict=True):
                if not out:
                    name = f"part-{part:05d}-{n:05d}.warc.gz"
                    info = synthesised(name, next(read_arc(arc_version_block(1, name))))
                    out = [member(warc_bytes(info))]
                    size = len(out[0])
                data = warc.as_py()
                if record.as_py() != first_record.as_py():
                    data = member(warc_bytes(as_revisit(next(read_warc(data)), first_record.as_py())))
                out.append(data)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield _archives([name], [b"".join(out)])
                    out, n = [], n + 1
        if out:
            yield _archives([name], [b"".join(out)])

    return records.select("record", "warc", "first_record").mapInArrow(write, "archive string, content binary")


def convert(arcs: DataFrame) -> DataFrame:
    """ARC archives to WARC archives, with one response per payload and revisits for the rest.

    The archives are parsed twice, first for digests alone: which record is the response
    is an aggregate over short rows, and payloads move once, compressed.
    """
    first = convert_arcs(arcs, whole=False).groupBy("payload_sha256").agg(F.max(F.struct("key", "record")).alias("first"), F.count("*").alias("__n"))
    first = materialise(first.select("payload_sha256", F.col("first.record").alias("first_record"), "__n"), "responses")
    return write_warcs(spread_join(convert_arcs(arcs), first, "payload_sha256", F.xxhash64("record")))


def uuid_bytes(urn: str | None) -> bytes | None:
    """The 16 bytes of <urn:uuid:...>."""
    return uuid.UUID(urn.strip("<>")).bytes if urn else None


def read_warcs(warcs: DataFrame) -> DataFrame:
    """What WARC archives say of each record but warcinfo: key, type, digest, payload length, its id and that of the record it refers to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        names = ["key", "record_type", "payload_digest", "payload_bytes", "record_id", "refers_to_id"]
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for r in read_warc(content.as_py()):
                    h = r.headers
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    fields, payload = http_parts(r.block)
                    if h["WARC-Type"] == "response" and "sha1:" + sha1_base32(payload) != h["WARC-Payload-Digest"]:
                        raise ValueError(f"digest of {h['WARC-Record-ID']}")
                    key, length = fields.get(KEY.lower()), fields.get("content-length")
                    rows.append((int(key) if key else None, h["WARC-Type"], h["WARC-Payload-Digest"][5:], int(length) if length else len(payload), uuid_bytes(h["WARC-Record-ID"]), uuid_bytes(h.get("WARC-Refers-To"))))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "key long, record_type string, payload_digest string, payload_bytes long, record_id binary, refers_to_id binary"
    return warcs.select("archive", "content").mapInArrow(read, schema)


def resolved(records: DataFrame) -> DataFrame:
    """records of read_warcs() with refers_to, the key of the record that WARC-Refers-To names."""
    records = materialise(records, "records")
    revisits = records.filter("refers_to_id IS NOT NULL")
    times = revisits.groupBy("refers_to_id").agg(F.count("*").alias("__n"))
    found = times.join(records.select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to")), "refers_to_id", "left")
    whole = records.filter("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    return whole.unionByName(spread_join(revisits, materialise(found, "referred"), "refers_to_id", F.xxhash64("record_id")))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    arcs = materialise(write_arcs(pages.select(F.col("page_id").cast("long").alias("key"), "url", utf8("html").alias("payload"))), "arc", "zstd")
    warcs = materialise(convert(arcs), "warc")
    return resolved(read_warcs(warcs)).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS nth, sha1(coalesce(html, '')) AS hex
  FROM pages
), n AS (
  SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS nibble FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((nibble[1 + (5 * i) // 4] * 16 + coalesce(nibble[2 + (5 * i) // 4], 0)) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth = 1 THEN NULL ELSE first END AS refers_to
FROM n
"""
