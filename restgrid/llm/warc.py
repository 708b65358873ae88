"""WARC: a converter of legacy ARC archives, a writer and a reader.

ARC 1 and ARC 2 are told apart by the version block at the head of an archive; their URL-record
lines have five and ten fields, and each names the length of what follows.  Every ARC record
becomes a WARC/1.1 record: identifier from page and digest, timestamp from the 14-digit
date, SHA-256 digest of the payload, type response or revisit.

An archive starts with a warcinfo record, which takes the place of the version block.  What is no
HTTP response becomes a resource record of its MIME type.

Archives are written by Spark's text writer (a record's bytes end in CRLF, the writer's line
end is CRLF), so they reach any file system that Spark reaches, compressed by gzip, and read
back as whole files by declared lengths.  A file holds about ``WARC_BYTES``, or one larger record.

Defined cases: a null html is an empty payload; a null url stands as ``urn:page:<id>``; blanks
and control characters in a url are percent-encoded; payloads under 100 bytes never revisit; a
null page_id is no one's original and has no id in its record; rows that repeat a page_id and
payload are one response each; very long pages are archives of their own; an empty table gives no
records; archives that end early or break their version's layout raise ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard_at_exit, shared_dir, small_batches

ARCHIVE_BYTES = 1 << 20
WARC_BYTES = 32 << 20
LEAST_REVISIT = 100
CRAWLED = "20240115143000"
#: Fixed values of the two ARC versions.
ARC_FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_RECORD = "url string, ip string, date string, mime string, content binary, archive string, offset bigint"
WARC_ROW = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, date string, url string"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def _safe(url: bytes) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url)


# --- ARC -----------------------------------------------------------------------------------


def arc_head(version: bytes, name: bytes) -> bytes:
    body = version + b" 0 restgrid\n" + ARC_FIELDS[version] + b"\n"
    return b"filedesc://%s 0.0.0.0 %s text/plain %s%d\n%s\n" % (name, CRAWLED.encode(), b"" if version == b"1" else b"200 - - 0 %s " % name, len(body), body)


def arc_entry(version: bytes, name: bytes, offset: int, url: bytes, content: bytes) -> bytes:
    more = b"" if version == b"1" else b"200 - - %d %s " % (offset, name)
    return b"%s 0.0.0.0 %s text/html %s%d\n%s\n" % (_safe(url), CRAWLED.encode(), more, len(content), content)


def parse_arc(data: bytes):
    """(url, date, mime, content, offset) of each record but the version block."""
    for url, _, date, mime, content, offset in arc_records(data):
        yield url, date, mime, content, offset


def arc_records(data: bytes):
    """(url, ip, date, mime, content, offset) of each record but the version block."""
    at, width = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC: a header line at {at} has no end")
        fields = data[at:end].split(b" ")
        if not width:  # the version block names its own layout
            if not fields[0].startswith(b"filedesc://"):
                raise ValueError("ARC: no version block")
            length = int(fields[-1])
            version = data[end + 1 : end + 1 + length].split(b" ", 1)[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC: unknown version {version!r}")
            width = len(ARC_FIELDS[version].split(b" "))
        elif len(fields) != width:
            raise ValueError(f"ARC: {len(fields)} fields in place of {width} at {at}")
        else:
            length = int(fields[-1])
            if end + 1 + length > len(data):
                raise ValueError(f"ARC: the record at {at} is cut short")
            yield *fields[:4], data[end + 1 : end + 1 + length], at
        at = end + 1 + length + 1


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(archive, content): ARC archives of about ARCHIVE_BYTES, in turn version 1 and 2."""

    def build(batches):
        number, parts, size = 0, [], 0
        version, name = b"1", b""

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([name.decode()]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not parts:
                    version = b"12"[number % 2 : number % 2 + 1]
                    name = b"pages-%s-%d.arc" % (uuid.uuid4().hex.encode(), number)
                    parts = [arc_head(version, name)]
                    size, number = len(parts[0]), number + 1
                key = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                body = (html or "").encode()
                content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (key, len(body), body)
                parts.append(arc_entry(version, name, size, url.encode() if url is not None else b"urn:page:%s" % str(page).encode(), content))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    parts = []
        if parts:
            yield flush()

    return pages.select("page_id", "url", "html").mapInArrow(build, "archive string, content binary")


def read_arc(archives: DataFrame) -> DataFrame:
    """ARC_RECORD rows of (archive, content) rows, plain or gzip, as ``binaryFile`` gives them."""

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [(u.decode(), ip.decode(), d.decode(), m.decode(), c, name, at) for u, ip, d, m, c, at in arc_records(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (*(pa.string(),) * 4, pa.binary(), pa.string(), pa.int64()))], names=[c.split()[0] for c in ARC_RECORD.split(", ")])

    return archives.select("archive", "content").mapInArrow(parse, ARC_RECORD)


# --- conversion ----------------------------------------------------------------------------


def split_http(content: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """(head with its blank line, payload, fields by lower-case name)."""
    end = content.find(b"\r\n\r\n")
    head, body = (content[: end + 4], content[end + 4 :]) if content.startswith(b"HTTP/") and end >= 0 else (b"", content)
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k)
    return head, body, fields


def record_id(page: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page} {digest}'.encode()).digest()[:16], version=5)}"


def payloads(records: DataFrame) -> DataFrame:
    """(page_id, digest, size) of each ARC record: small rows, to find the copies with."""

    def digest(batches):
        for batch in batches:
            got = [split_http(x.as_py()) for x in batch.column(0)]
            pages = [int(f[b"x-page-id"]) if b"x-page-id" in f else None for _, _, f in got]
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for _, b, _ in got], pa.string()), pa.array([len(b) for _, b, _ in got], pa.int64())], names=["page_id", "digest", "size"])

    return records.select("content").mapInArrow(digest, "page_id bigint, digest string, size bigint")


def originals(found: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of every page whose payload an earlier page has."""
    long = found.where(F.col("size") >= LEAST_REVISIT)
    first = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return long.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(records: DataFrame, copies: DataFrame, path: str) -> None:
    """WARC archives of ARC records under ``path``; ``copies``: what ``originals`` gives."""

    def keyed(batches):
        for batch in batches:
            got = [split_http(x.as_py()) for x in batch.column(4)]
            pages = [int(f[b"x-page-id"]) if b"x-page-id" in f else None for _, _, f in got]
            digests = [hashlib.sha256(b).hexdigest() for _, b, _ in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int64()), pa.array(digests, pa.string())], names=[*ARC, "page_id", "digest"])

    def build(batches):
        task, number, size = TaskContext.get().partitionId(), -1, WARC_BYTES
        for batch in batches:
            out, names = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= WARC_BYTES:
                    number, size = number + 1, 0
                    name = f"{task}-{number}"
                    out.append(warc_info(name))
                    names.append(name)
                out.append(warc_record(*row))
                names.append(name)
                size += len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names)], names=["record", "archive"])

    ARC = ["url", "ip", "date", "mime", "content"]
    rows = records.select(*ARC).mapInArrow(keyed, "url string, ip string, date string, mime string, content binary, page_id bigint, digest string")
    rows = rows.join(copies, ["page_id", "digest"], "left").select(*ARC, "page_id", "digest", "refers_to")
    made = rows.mapInArrow(build, "record binary, archive string").select(F.col("record").cast("string").alias("value"), "archive")
    made.write.option("lineSep", "\r\n").option("compression", "gzip").partitionBy("archive").text(path)


def _lines(fields: list[str], block: bytes) -> bytes:
    return ("\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_info(name: str) -> bytes:
    """The record at the head of an archive."""
    block = b"software: restgrid\r\nformat: WARC File Format 1.1\r\n"
    return _lines(["WARC-Type: warcinfo", f"WARC-Record-ID: <{record_id(None, name)}>", f"WARC-Date: {warc_date(CRAWLED)}", f"WARC-Filename: {name}.warc.gz", "Content-Type: application/warc-fields"], block)


def warc_record(url: str, ip: str, date: str, mime: str, content: bytes, page: int | None, digest: str, refers: int | None) -> bytes:
    """One record without its last CRLF, which the writer adds."""
    head, body, _ = split_http(content)
    block = content if refers is None else head
    fields = [
        f"WARC-Type: {'revisit' if refers is not None else 'response' if head else 'resource'}",
        f"WARC-Record-ID: <{record_id(page, digest)}>",
        f"WARC-Date: {warc_date(date)}",
        f"WARC-Target-URI: {url}",
        f"Content-Type: {'application/http; msgtype=response' if head else mime}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(body)}",
    ]
    if ip != "0.0.0.0":  # an archive's mark for an address that isn't known
        fields.append(f"WARC-IP-Address: {ip}")
    if refers is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers, digest)}>", f"X-Refers-To-Page: {refers}"]
    return _lines(fields, block)


def parse_warc(data: bytes):
    """(fields by lower-case name, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"WARC: no record at {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b": ")
            fields[k.lower()] = v
        length = int(fields[b"content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"WARC: the record at {at} is cut short")
        yield fields, block
        at = end + 8 + length


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_ROW rows of the archives under ``path``; digests and lengths are checked."""

    def parse(batches):
        for batch in batches:
            for x in batch.column(0):
                rows = []
                for f, block in parse_warc(gzip.decompress(x.as_py())):
                    if f[b"warc-type"] == b"warcinfo":
                        continue
                    _, body, http = split_http(block)
                    kind, digest = f[b"warc-type"].decode(), f[b"warc-payload-digest"].decode().removeprefix("sha256:")
                    if hashlib.sha256(block).hexdigest() != f[b"warc-block-digest"].decode().removeprefix("sha256:"):
                        raise ValueError("WARC: a block doesn't match its digest")
                    if kind != "revisit" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(f[b"x-payload-length"])):
                        raise ValueError("WARC: a payload doesn't match its digest or length")
                    page = http.get(b"x-page-id")
                    refers = f.get(b"x-refers-to-page")
                    rows.append((page and int(page), int(f[b"x-payload-length"]), digest, kind, refers and int(refers), f[b"warc-record-id"].decode()[1:-1], f[b"warc-date"].decode(), f[b"warc-target-uri"].decode()))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in WARC_ROW.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, WARC_ROW)


def convert(pages: DataFrame) -> DataFrame:
    """Pages through ARC archives into WARC archives in the shared folder, and read back."""
    spark = pages.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_arc(pages_to_arc(pages))
    try:
        write_warc(records, originals(payloads(records)), path)
    finally:
        discard_at_exit(spark, path)
    return read_warc(spark, path)


def op6_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = convert(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
first as (select digest, min(page_id) as page_id from p where n >= 100 group by digest)
select p.page_id, cast(n as bigint) as payload_bytes, p.digest as payload_digest,
 case when f.page_id < p.page_id then 'revisit' else 'response' end as record_type,
 case when f.page_id < p.page_id then f.page_id end as refers_to
from p left join first f on f.digest = p.digest and p.n >= 100
"""
