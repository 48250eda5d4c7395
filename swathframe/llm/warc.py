r"""WARC archives: writing captures, reading records, assembling transactions.

write() turns rows (page_id, url, html) into request, response or revisit, and metadata records, each a gzip member of its
own, and stores them in files of about FILE_BYTES that begin with a warcinfo record. The text sink stores them: a row is the
bytes of a file, and the NUL after it is padding that gzip skips. read() inflates and parses files step by step, by
Content-Length. captures() joins the request and metadata records to their response or revisit record through
WARC-Concurrent-To, a revisit to its original through WARC-Refers-To, and gives one nested row a capture.

Of captures with equal payloads of at least LEAST bytes that with the smallest page_id (of repeated rows: the first) is
the response, the others revisit it. Only rows whose payload may be repeated (by a bitmap of bounded size) are stored once
more and joined; payloads that very many rows share meet their original by broadcast.

Defined cases: null html is the empty payload; null or odd urls are percent-encoded, null as empty; a null page_id is kept
and never an original where another has the payload; other columns are ignored; an empty table writes an archive without
records. Any text is a valid payload, blank lines and record headers included. Of several request or metadata records of one
response the smallest counts; records that refer to none are left out. A block without the blank line after its HTTP header
is all payload.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, spread_join

#: Bytes from which equal payloads are stored once; compressed bytes at which a file ends; date of records that bring none.
LEAST, FILE_BYTES, DATE = 100, 16 << 20, "2024-01-01T00:00:00Z"
#: Bits of the bitmap of payloads that occur again (2 MB); records and payload bytes of a batch that is read.
BITMAP, BATCH_ROWS, BATCH_BYTES = 1 << 24, 1024, 8 << 20
BLANK = "\r\n\r\n"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to_id string, target_uri string, stated_digest string, stated_bytes long, page_id long, payload_bytes long, payload_digest string"
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, record_id: Column, block: Column, **fields: Column) -> Column:
    """Text of a record; fields that are null are left out."""
    names = {"concurrent_to": "WARC-Concurrent-To", "refers_to": "WARC-Refers-To", "uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "profile": "WARC-Profile", "content": "Content-Type"}
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}")]
    for name, value in fields.items():
        lines.append(F.coalesce(F.concat(F.lit(f"\r\n{names[name]}: "), value), F.lit("")))
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(BLANK), block)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *(p.cast("string") for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _prepared(pages: DataFrame) -> DataFrame:
    """page_id, url, html, bytes, digest of every row."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\x00-\\x20]", "%20"), "[\\x7F]", "%7F").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.sha2(html.cast("binary"), 256).alias("digest"),
    )


def _first(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with `row` and `first` (of the original: page_id, row; null: the row is a response)."""
    again = rows.filter(F.col("bytes") >= LEAST).select(F.xxhash64("digest").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.pmod(F.col("h"), F.lit(BITMAP))
    words = again.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {BITMAP}) % 64 as int))")).alias("mask"))
    words = scratch.keep(words, "words")  # at most BITMAP / 64 rows
    place = F.pmod(F.xxhash64("digest"), F.lit(BITMAP))
    marked = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word", "left")
    some = F.coalesce(F.col("bytes") >= LEAST, F.lit(False)) & F.coalesce(F.expr(f"(mask & shiftleft(1L, cast(pmod(xxhash64(digest), {BITMAP}) % 64 as int))) != 0"), F.lit(False))
    none = F.lit(None).cast("struct<page_id: bigint, row: bigint>")
    lone = marked.filter(~some).drop("word", "mask").withColumns({"row": F.monotonically_increasing_id(), "first": none})
    # numbered once and stored, so that an original's number is the same wherever it is read
    rest = scratch.keep(marked.filter(some).drop("word", "mask").withColumn("row", F.lit(1 << 62) + F.monotonically_increasing_id()), "repeated")
    first = rest.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("f")).select("digest", F.struct("f.page_id", "f.row").alias("first"))
    rest = spread_join(rest, scratch.keep(first, "first"), "digest")
    return lone.unionByName(rest.withColumn("first", F.when(F.col("first.row") != F.col("row"), F.col("first"))))


def _stored(records: list[bytes]) -> bytes:
    """Gzip members of records."""
    return b"".join(gzip.compress(r + BLANK.encode(), 6, mtime=0) for r in records)


def _files(batches):
    """Bytes of files, each led by a warcinfo record."""
    held, size, at = [], 0, 0
    for b in batches:
        for i in range(b.num_rows):
            member = _stored([r.encode() for r in b.column("records")[i].as_py()])
            held.append(member)
            size += len(member)
            if size >= FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([_headed(held, at)], pa.binary())], ["value"])
                held, size, at = [], 0, at + 1
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_headed(held, at)], pa.binary())], ["value"])


def _headed(members: list[bytes], at: int) -> bytes:
    block = b"software: swathframe\r\nformat: WARC File Format 1.1\r\n"
    name = hashlib.md5(b"%d/%d" % (TaskContext.get().partitionId() if TaskContext.get() else 0, at) + hashlib.md5(members[0]).digest(), usedforsecurity=False).hexdigest()
    name = f"{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}{BLANK}"
    return b"".join([_stored([head.encode() + block]), *members])


def write(pages: DataFrame, path: str) -> None:
    """Stores pages (page_id, url, html) as an archive of WARC files in the folder `path`."""
    scratch = Scratch(pages.sparkSession, "warc-write")
    rows = _first(_prepared(pages), scratch)
    key = F.coalesce(F.col("page_id"), F.lit(-1))
    me = _uuid(key, F.col("row"), F.lit("response"))
    original = _uuid(F.coalesce(F.col("first.page_id"), F.lit(-1)), F.col("first.row"), F.lit("response"))
    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BLANK))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(BLANK))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    say = "application/http; msgtype="
    request = _record("request", _uuid(key, F.col("row"), F.lit("request")), ask, concurrent_to=me, uri=F.col("url"), content=F.lit(f"{say}request"))
    response = F.when(F.col("first").isNull(), _record("response", me, F.concat(head, F.col("html")), uri=F.col("url"), digest=digest, content=F.lit(f"{say}response"))).otherwise(
        _record("revisit", me, head, refers_to=original, uri=F.col("url"), digest=digest, profile=F.lit(PROFILE), content=F.lit(f"{say}response"))
    )
    notes = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _uuid(key, F.col("row"), F.lit("metadata")), notes, concurrent_to=me, uri=F.col("url"), content=F.lit("application/warc-fields"))
    files = rows.select(F.array(request, response, metadata).alias("records")).mapInArrow(_files, "value binary")
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def inflated(data: bytes):
    """Parts of the contents of a gzip file's members in turn; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        if not data[at]:  # padding
            at += 1
            continue
        d, step = zlib.decompressobj(31), 1 << 12
        while not d.eof:
            if at >= len(data):
                raise ValueError("a gzip member ends early")
            part = view[at : at + step]
            at += len(part)
            out = d.decompress(part, 1 << 20)
            while out:
                yield out
                out = d.decompress(d.unconsumed_tail, 1 << 20) if not d.eof else b""
            step = min(2 * step, 1 << 20)
        at -= len(d.unused_data)


def parsed(data: bytes):
    """Header fields (lower-case names) and block of each record."""
    parts, held = inflated(data), bytearray()

    def have(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while have(2) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
            seen = len(held)
            if not have(seen + 1):
                break
        if end < 0 or held[:5] != b"WARC/":
            raise ValueError("not a WARC record")
        fields = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        stop = end + 4 + int(fields["content-length"])
        if not have(stop):
            raise ValueError("a WARC record ends early")
        yield fields, bytes(memoryview(held)[end + 4 : stop])
        del held[:stop]


def _row(f: dict, block: bytes) -> tuple:
    """A record's row, its payload last. The payload of a response is its block after the HTTP header."""
    kind, size, digest, stated, page, body = f.get("warc-type"), None, None, None, None, None
    if kind in ("response", "revisit"):
        cut = block.find(b"\r\n\r\n")
        head = block[:cut].decode("latin-1").lower() if cut >= 0 else ""
        stated = next((int(x.split(":")[1]) for x in head.split("\r\n") if re.fullmatch(r"content-length:\s*[0-9]{1,18}\s*", x)), None)
        if kind == "response":
            body = memoryview(block)[cut + 4 :] if cut >= 0 else memoryview(block)
            size, digest = len(body), hashlib.sha256(body).hexdigest()
    elif kind == "metadata":
        value = next((x.split(":", 1)[1].strip() for x in block.decode("utf-8", "replace").split("\r\n") if x.startswith("page-id:")), "")
        page = int(value) if re.fullmatch("-?[0-9]{1,19}", value) and -(1 << 63) <= int(value) < 1 << 63 else None
    return (f.get("warc-record-id"), kind, f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha256:") or None, stated, page, size, digest, body)


def _parse(batches, payload: bool):
    """Rows of records, in batches of bounded rows and bytes."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payload
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD.split(", ")] + [pa.binary()] * payload
    rows, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    for b in batches:
        for i in range(b.num_rows):
            for f, block in parsed(b.column("content")[i].as_py()):
                *row, body = _row(f, block)
                rows.append((*row, bytes(body) if body is not None else None) if payload else row)
                size += len(body) if payload and body is not None else 0
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
    yield batch()


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of the archive in a folder (RECORD; with their payload if asked)."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    return files.mapInArrow(lambda x: _parse(x, payload), RECORD + (", payload binary" if payload else ""))


def captures(records: DataFrame) -> DataFrame:
    """One row a capture of stored records: record_id, request, response, metadata, original (of a revisit: page_id and payload figures)."""
    response = records.filter("record_type in ('response', 'revisit') and record_id is not null").select("record_id", F.struct("record_type", "target_uri", "refers_to_id", "stated_digest", "stated_bytes", "payload_bytes", "payload_digest").alias("response"))

    def noted(kind: str, *fields: str) -> DataFrame:
        of = records.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return of.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(F.struct(F.col("record_id").alias("id"), *fields)).alias(kind))

    whole = response.join(noted("request", "target_uri"), "record_id", "left").join(noted("metadata", "page_id"), "record_id", "left")
    # only revisits look for an original
    whole = Scratch(records.sparkSession, "warc-captures").keep(whole, "captures")
    again = whole.filter("response.refers_to_id is not null").withColumn("refers", F.col("response.refers_to_id"))
    original = whole.filter("response.record_type = 'response'").select(F.col("record_id").alias("refers"), F.struct("metadata.page_id", "response.payload_bytes", "response.payload_digest").alias("original"))
    columns = ["record_id", "request", "response", "metadata", "original"]
    alone = whole.filter("response.refers_to_id is null").withColumn("original", F.lit(None).cast(original.schema["original"].dataType))
    return alone.select(columns).unionByName(spread_join(again, original.dropDuplicates(["refers"]), "refers").select(columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to an archive in the shared folder, reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archive")
    write(pages, path)
    records = scratch.keep(read(pages.sparkSession, path), "records")
    return captures(records).select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("original.page_id").alias("refers_to"),
    )
