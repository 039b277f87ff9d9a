"""WARC archives: a native writer with revisit records and a salvage reader.

``write_archives`` composes one record per page with SQL functions and writes
them through Spark's text sink, so any file system Spark can reach works and a
lost task is redone by the commit protocol.  ``read_archives`` parses archives
(plain or one gzip member per record).  After a failed check it searches for
the next version line (or gzip member) that starts a valid record, recovers
from there and reports the bytes between as a quarantined gap.

Defined results: a null payload is the empty payload; a null url has no target
header; rows with a null page_id are written too and never the first of their
group unless all ids of the group are null, when all are responses; repeated
rows of the smallest page_id are all responses.  An empty table writes no
record, an empty folder reads as none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recolens.llm.frames import shared_path, written

VERSION = "WARC/1.1"
#: Rows of one archive file; a reader task holds one file in memory.
RECORDS_PER_FILE = 4096
#: Groups of equal payloads up to this many are joined by broadcast (about 100 bytes each).
BROADCAST_GROUPS = 200_000
#: A record date is a property of the crawl; pages carry none.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"

_HEX_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
RECORD_SCHEMA = ("path string, offset long, length long, warc_type string, record_id string, "
                 "page_id long, refers_to string, digest string, payload binary, gap string")


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string or binary column."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _HEX_DIGITS, _BASE32)


def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, first_id): ``first_id`` is the
    response's page_id where the row is a revisit, else null.

    Only digests are grouped (with partial sums, so a hot payload is no hot
    task); payloads are not shuffled unless the duplicate groups outgrow the
    broadcast bound."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = (rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("digest", sha1_base32(F.col("payload"))))
    groups = (rows.where(F.col("payload_bytes") >= min_bytes)
              .groupBy("digest", "payload_bytes")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    groups = written(groups, "warc-groups")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    return (rows.join(groups, ["digest", "payload_bytes"], "left")
            .withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
            .drop("first"))


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
                    F.lit(":"), digest, F.lit(">"))


def record_text(rows: DataFrame) -> Column:
    """One whole WARC record, without the two line ends that close it."""
    revisit = F.col("first_id").isNotNull()
    target = F.regexp_replace("url", r"[\x00-\x1f\x7f]", "%20")
    header = F.concat_ws(
        "\r\n", F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {UNKNOWN_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first_id"), F.col("digest")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))))
    return F.concat(header, F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0,
                   records_per_file: int = RECORDS_PER_FILE) -> str:
    """Write one record per row of (page_id, url, html) below ``folder``."""
    rows = classify(pages, min_bytes)
    (rows.select(record_text(rows).alias("value")).write
     .option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(folder))
    return folder


# ------------------------------------------------------------------ reading

class Damaged(Exception):
    """A record or member that fails a check; its text is the reason."""


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End offset, headers and block of the record at ``at``, all checked."""
    version = _VERSION_LINE.match(data, at)
    if version is None:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", version.end())
    if head_end < 0:
        raise Damaged("headers do not end")
    headers = _headers(data[version.end():head_end])
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no content length")
    start, end = head_end + 4, head_end + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record is cut or its length is wrong")
    block = data[start:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:]:
            raise Damaged("payload digest differs")
    return end + 4, headers, block


def _member(data: bytes, at: int) -> tuple[int, bytes]:
    """End offset and content of the gzip member at ``at``."""
    unpack = zlib.decompressobj(31)
    try:
        content = unpack.decompress(memoryview(data)[at:])
    except zlib.error as e:
        raise Damaged(f"gzip member: {e}") from None
    if not unpack.eof:
        raise Damaged("gzip member is cut")
    return len(data) - len(unpack.unused_data), content


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """(offset, length, headers, block, gap reason) of all records and gaps, in order.

    The bytes of all rows add up to the whole archive."""
    at = 0
    while at < len(data):
        packed = data.startswith(b"\x1f\x8b", at)
        try:
            if packed:
                end, content = _member(data, at)
                inner, headers, block = parse_record(content, 0)
                if inner != len(content):
                    raise Damaged("more than one record in a member")
            else:
                end, headers, block = parse_record(data, at)
            yield at, end - at, headers, block, None
            at = end
        except Damaged as e:
            nxt = _next_valid(data, at + 1)
            yield at, nxt - at, None, b"", str(e)
            at = nxt


def _next_valid(data: bytes, at: int) -> int:
    """The next offset where a whole valid record or member starts."""
    while True:
        line = _VERSION_LINE.search(data, at)
        plain = line.start() if line else len(data)
        packed = data.find(_MAGIC, at, plain)
        start = packed if packed >= 0 else plain
        if start >= len(data):
            return len(data)
        try:
            if packed >= 0:
                parse_record(_member(data, start)[1], 0)
            else:
                parse_record(data, start)
            return start
        except Damaged:
            at = start + 1


def _page_id(text: str) -> int | None:
    """A signed 64-bit id; anything else is none."""
    page = int(text) if re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return page if page is not None and -(1 << 63) <= page < 1 << 63 else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                        ("warc_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()),
                        ("refers_to", pa.string()), ("digest", pa.string()), ("payload", pa.binary()),
                        ("gap", pa.string())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name, out, size = path.as_py(), [], 0
            for offset, length, headers, block, gap in salvage(content.as_py()):
                h = headers or {}
                out.append((name, offset, length, h.get("warc-type"), h.get("warc-record-id"),
                            _page_id(h.get("x-page-id", "")), h.get("warc-refers-to"),
                            h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            None if gap else block, gap))
                size += len(block)
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records (``gap`` null) and quarantined byte gaps (``gap`` the reason)."""
    return (spark.read.format("binaryFile").load(folder).select("path", "content")
            .mapInArrow(_parsed, RECORD_SCHEMA))


def page_digests(spark: SparkSession, folder: str, quarantine: str | None = None) -> DataFrame:
    """Per page record: payload size and digest, type, and the response of a revisit.

    A revisit takes its payload from the response record it names.  If that one is lost, its
    own headers give the digest and the page it refers to; the size is then unknown.
    Gaps (path, offset, length, gap) are appended to the Parquet table ``quarantine``."""
    records = written(
        read_archives(spark, folder)
        .select("path", "offset", "length", "gap", "page_id", "record_id", "digest", F.col("refers_to").alias("refers_id"),
                F.col("warc_type").alias("record_type"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                sha1_base32(F.col("payload")).alias("payload_digest")), "warc-records")
    if quarantine is not None:
        records.where("gap is not null").select("path", "offset", "length", "gap").write.mode("append").parquet(quarantine)
    responses = (records.where("gap is null and record_type = 'response'")
                 .groupBy(F.col("record_id").alias("refers_id"))
                 .agg(F.min("page_id").alias("first_id"), F.min("payload_bytes").alias("b"),
                      F.min("payload_digest").alias("d")))
    named = F.regexp_extract("refers_id", "^<urn:x-page:(-?[0-9]+):", 1).try_cast("long")
    revisits = (records.where("gap is null and record_type = 'revisit'").join(responses, "refers_id", "left")
                .select("page_id", F.col("b").alias("payload_bytes"), F.coalesce("d", "digest").alias("payload_digest"),
                        "record_type", F.coalesce("first_id", named).alias("refers_to")))
    return (records.where("gap is null and record_type = 'response'")
            .select("page_id", "payload_bytes", "payload_digest", "record_type",
                    F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    return page_digests(spark, write_archives(pages, shared_path(spark, "warc"), min_bytes),
                        shared_path(spark, "warc-quarantine"))
