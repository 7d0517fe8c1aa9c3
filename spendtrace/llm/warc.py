"""WARC archives: a writer on Spark's text sink and a reader that salvages.

A record is `WARC/1.1`, header lines, an empty line, the block and two line
ends. The text sink with a line separator of CR LF writes exactly that, on any
storage that Spark can write to. Files are bounded in size, so the reader can
take one file at a time as binary.

The reader checks each record: version line, header lines, Content-Length, the
two line ends after the block, and the block digest. After a failed check it
searches for the next valid version line (or, in compressed archives, the next valid
member) and goes on there; what it passed over is reported as a gap with file, first
and last byte and reason. A record that only its digest condemns is passed over as a
whole, so nothing quoted inside it is taken for a record. The inflated bytes of a member
are salvaged in the same way, and of a member that breaks off the records are kept that
are whole, have a digest and are followed by another. What cannot be told apart: a record
quoted from the start of a line inside one with a damaged length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendtrace.llm.common import table
from spendtrace.session import materialize, new_folder

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
CRLF = "\r\n"
HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REQUIRED = frozenset(("warc-type", "warc-record-id", "content-length"))

READ_SCHEMA = (
    "file string, start long, stop long, reason string, headers map<string,string>, "
    "record_type string, record_id string, payload binary")


def choose_responses(pages: DataFrame, least_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """`pages` with payload_bytes, payload_digest and refers_to.

    Of rows with equal payloads of `least_bytes` or more, the smallest non-null
    page_id is the response; rows with that id refer to nothing, so a repeated
    row is a response again. Others refer to it. The smallest id per digest is
    combined before its shuffle, and the join back can be split on hot digests.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    first = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    first = materialize(first.drop("_n"), "warc-repeated")
    revisits = (F.col("payload_bytes") >= least_bytes) & F.col("_first").isNotNull() & ~F.col(
        "page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "payload_digest", "left").withColumn(
        "refers_to", F.when(revisits, F.col("_first"))).drop("_first")


def record_text(date: str = DATE):
    """A record as text, its last line end left to the sink's separator."""
    revisit = F.col("refers_to").isNotNull()
    # Line ends and other control characters cannot stand in a header.
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    lines = F.concat_ws(
        CRLF, F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block.cast("binary"), 256)),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(lines, F.lit(CRLF * 2), block, F.lit(CRLF))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row of `pages` (page_id, url, html) into `folder`.

    Null html is an empty payload, null url an empty one, a null page_id the
    name `null`. An empty table writes no record. Other columns are not used.
    The number of records per file follows from the mean record size, counted
    first, so that files stay near `archive_bytes`; a longer record is not cut.
    """
    rows = choose_responses(pages)
    mean = rows.agg(F.avg("payload_bytes")).first()[0] or 1.0
    rows.select(record_text().alias("value")).write.option("lineSep", CRLF).option(
        "maxRecordsPerFile", max(1, int(archive_bytes / (mean + 600)))).text(folder)


class Rejected(Exception):
    """Why bytes at some place are not a record, and where a condemned one ends."""

    def __init__(self, reason: str, stop: int | None = None) -> None:
        super().__init__(reason)
        self.stop = stop


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at `at`, or Rejected."""
    if not data.startswith(VERSION, at):
        raise Rejected("no version line")
    head_end = data.find(b"\r\n\r\n", at)
    if head_end < 0:
        raise Rejected("unfinished header")
    headers: dict[str, str] = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Rejected("bad header line")
        key = name.strip().decode("utf-8", "replace").lower()
        # A header cut off in the middle runs into the next record's.
        if key in headers and key in REQUIRED:
            raise Rejected("repeated header")
        headers[key] = value.strip().decode("utf-8", "replace")
    if not REQUIRED <= headers.keys():
        raise Rejected("missing header")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Rejected("bad content length")
    start = head_end + 4
    stop = start + int(length)
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Rejected("block does not end where it should")
    block = data[start:stop]
    if not digest_agrees(headers.get("warc-block-digest"), block):
        raise Rejected("block digest differs", stop + 4)
    return headers, block, stop + 4


def digest_agrees(stated: str | None, block: bytes) -> bool:
    """Whether a digest `algorithm:value` (hex or base 32) fits; unknown ones do."""
    kind, _, value = (stated or "").partition(":")
    if not value or kind.lower() not in ("sha256", "sha1", "md5"):
        return True
    digest = hashlib.new(kind.lower(), block).digest()
    return value.lower() == digest.hex() or value.upper() == base64.b32encode(digest).decode()


def inflate(data: bytes, at: int, step: int = 1 << 20) -> tuple[bytes, int | None, str]:
    """What the gzip member at `at` holds, its end, and why it has none."""
    unzip, parts = zlib.decompressobj(wbits=31), []
    view = memoryview(data)
    try:
        while at < len(data) and not unzip.eof:
            parts.append(unzip.decompress(view[at:at + step]))
            at += step
    except zlib.error:
        return b"".join(parts), None, "broken member"
    if not unzip.eof:
        return b"".join(parts), None, "unfinished member"
    return b"".join(parts), min(at, len(data)) - len(unzip.unused_data), ""


Found = tuple[int, int, str | None, dict | None, bytes | None]


def salvage(data: bytes) -> Iterator[Found]:
    """(start, stop, reason, headers, block) of all records and gaps of an archive.

    Records have no reason; gaps have nothing else. Together they cover the file.
    Starts and stops of a compressed archive are those of the member, for gaps inside
    a member too, whose reason names their bytes.
    """
    packed = data.startswith(MEMBER) or (VERSION not in data and MEMBER in data)
    return salvage_members(data) if packed else salvage_records(data)


def salvage_records(data: bytes) -> Iterator[Found]:
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            headers, block, stop = parse_record(data, at)
        except Rejected as reason:
            if gap is None:
                gap, why = at, str(reason)
            following = reason.stop if reason.stop and at_border(data, reason.stop) else data.find(VERSION, at + 1)
            at = len(data) if following < 0 else following
            continue
        if gap is not None:
            # Found by search: it begins a line, or another record or the end follows it.
            if data[at - 1:at] != b"\n" and not at_border(data, stop):
                following = data.find(VERSION, at + 1)
                at = len(data) if following < 0 else following
                continue
            yield gap, at, why, None, None
            gap = None
        yield at, stop, None, headers, block
        at = stop
    if gap is not None:
        yield gap, len(data), why, None, None


def at_border(data: bytes, at: int) -> bool:
    return at == len(data) or data.startswith(VERSION, at)


def salvage_members(data: bytes) -> Iterator[Found]:
    at, gap, why = 0, None, ""
    kept: list[tuple[dict, bytes]] = []  # records of broken members inside the gap
    while at < len(data):
        if data.startswith(MEMBER, at):
            inner, stop, reason = inflate(data, at)
        else:
            inner, stop, reason = b"", None, "no member"
        found = list(salvage_records(inner))
        if stop is not None and any(why_not is None for _, _, why_not, _, _ in found):
            if gap is not None:
                yield from ((gap, at, None, *record) for record in kept)
                yield gap, at, why, None, None
                gap, kept = None, []
            for low, high, why_not, headers, block in found:
                yield (at, stop, why_not and f"{why_not}, bytes {low} to {high} of the member",
                       headers, block)
            at = stop
            continue
        if gap is None:
            gap, why = at, reason or (found[0][2] if found else "empty member")
        if stop is not None:
            at = stop  # whole, but without a record
            continue
        kept += [(headers, block) for _, high, why_not, headers, block in found
                 if why_not is None and "warc-block-digest" in headers and inner.startswith(VERSION, high)]
        following = data.find(MEMBER, at + 1)
        at = len(data) if following < 0 else following
    if gap is not None:
        yield from ((gap, len(data), None, *record) for record in kept)
        yield gap, len(data), why, None, None


def http_payload(headers: dict[str, str], block: bytes) -> bytes:
    """The body behind the HTTP header, or the whole block of other records."""
    if headers.get("content-type", "").startswith("application/http"):
        head, mark, body = block.partition(b"\r\n\r\n")
        return body if mark else block
    return block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of all archives in `folder`, in the columns of READ_SCHEMA.

    A gap has a reason and null headers. Each file is one row of Spark's binary
    source; a task holds one file at a time. An empty folder gives no rows.
    """
    schema = ("path string, modificationTime timestamp, length long, content binary")
    files = spark.read.format("binaryFile").schema(schema).load(folder).select("path", "content")
    kinds = pa.schema([
        ("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())), ("record_type", pa.string()),
        ("record_id", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows: list[tuple] = []
                held = 0
                for start, stop, reason, headers, block in salvage(data):
                    headers, block = headers or {}, block or b""
                    payload = http_payload(headers, block) if reason is None else None
                    rows.append((path, start, stop, reason, list(headers.items()) or None,
                                 headers.get("warc-type"), headers.get("warc-record-id"), payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    return files.mapInArrow(read, READ_SCHEMA)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows), kinds)], schema=kinds)


def page_name(value):
    """The page id inside `<urn:page:...>`, null for the name `null`."""
    return F.regexp_extract(value, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def warc_query(spark, folder: str) -> DataFrame:
    """All pages written to archives, and what the archives say of them."""
    out = new_folder(spark, "warc")
    write_archives(table(spark, folder, "pages"), out)
    got = read_archives(spark, out).filter(F.col("reason").isNull())
    revisit = F.col("record_type") == "revisit"
    return got.select(
        page_name(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("headers")["x-payload-length"].cast("long"))
        .otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.substring_index(F.col("headers")["warc-payload-digest"], ":", -1))
        .otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", page_name(F.col("headers")["warc-refers-to"]).alias("refers_to"))


WARC_SQL = f"""
with rows as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest,
    strlen(coalesce(html, ''))::bigint as bytes from pages),
firsts as (select digest, min(page_id) as first from rows where bytes >= {MIN_REVISIT_BYTES}
  group by digest)
select page_id, bytes as payload_bytes, digest as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end
    as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from rows left join firsts using (digest)
"""
