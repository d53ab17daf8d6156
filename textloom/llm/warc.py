"""Op 8: WARC archives of pages, and a reader that salvages what damaged archives still hold.

Writing is plain DataFrame work: a record is one line of a text file whose line separator is the blank line that ends
a WARC record. Reading loads archives as binary files and parses each in its task.
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

from textloom.llm.common import quoted, written
from textloom.session import ship_package

# Payloads below this size are always stored whole.
REVISIT_BYTES = 1000
# An archive file is about this large; readers hold one file per task.
ARCHIVE_BYTES = 8 << 20

_VERSION = b"WARC/1."
_GZIP = b"\x1f\x8b\x08"
# What a member may hold, and the bytes that a damaged one is fed with at a time.
LARGEST_MEMBER, _FEED = 1 << 30, 64
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_RECORD_ID = "urn:textloom:page:"

RECORDS = (
    "path string, offset long, length long, record_type string, record_id string, refers_to string, target_uri string,"
    " payload_digest string, payload_bytes long, payload binary, reason string"
)


# ---------------------------------------------------------------- writing


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, html, digest, payload_bytes and refers_to (null unless the page is a revisit).

    Of equal payloads of ``REVISIT_BYTES`` or more the largest key is kept whole. A null html is an empty payload, a null
    key is written as a record without a page number. The digests are counted before they are joined back, so a payload that many pages
    share is one row of the counted side, and the join's large side can be split.
    """
    payload = F.encode(F.coalesce(quoted(html), F.lit("")), "UTF-8")
    rows = pages.select(
        quoted(key).cast("long").alias("page_id"),
        quoted(url).alias("url"),
        F.coalesce(quoted(html), F.lit("")).alias("html"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    shared = (
        rows.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("shared_digest"))
        .agg(F.max("page_id").alias("whole"), F.count("*").alias("pages"))
        .filter("pages > 1 and whole is not null")
    )
    # Stored first, so that Spark knows its size and leaves the pages where they are if it is small.
    return rows.join(written(shared, "shared-payloads"), (F.col("digest") == F.col("shared_digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left").select(
        "page_id", "url", "html", "digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("whole")), F.col("whole")).alias("refers_to")
    )


def record_text() -> Column:
    """The whole record of a planned row, without the blank line that ends it."""
    line = F.lit("\r\n")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <" + _RECORD_ID),
        name,
        F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nX-Payload-Length: "),
        F.col("payload_bytes").cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <" + _RECORD_ID),
                F.col("refers_to").cast("string"),
                F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nWARC-Block-Digest: sha1:"),
        F.sha1(F.encode(block, "UTF-8")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        line,
        line,
        block,
    )


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per page below ``folder`` as ``.warc`` files of about ``ARCHIVE_BYTES``; an empty table writes none."""
    size, rows = pages.agg(F.coalesce(F.sum(F.octet_length(quoted(html)) + 700), F.lit(0)), F.count("*")).first()
    records = plan_records(pages, key, url, html).select(record_text().alias("value"))
    per_file = max(1, int(rows) * ARCHIVE_BYTES // max(int(size), 1))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(folder)


def gzip_member(record: bytes) -> bytes:
    """A record, with its ending blank line, as one member of a ``.warc.gz`` archive."""
    return gzip.compress(record, mtime=0)


# ---------------------------------------------------------------- reading


def _parsed(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the record at ``at``; ValueError names the failed check."""
    if not data.startswith(_VERSION, at):
        raise ValueError("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("headers do not end")
    headers: dict[str, str] = {}
    for raw in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = raw.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no content length")
    start, end = head + 4, head + 4 + int(length)
    if end > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = data[start:end]
    digest = headers.get("warc-block-digest")
    if digest and digest.startswith("sha1:") and digest[5:].lower() != hashlib.sha1(block).hexdigest():
        raise ValueError("block digest differs")
    kind, _, own = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha1" and headers.get("warc-type") == "response" and own.lower() != hashlib.sha1(_payload(headers, block)).hexdigest():
        raise ValueError("payload digest differs")
    return end + 4, headers, block


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _member(data: bytes, at: int) -> tuple[int | None, bytes, str]:
    """End, content and fault of the gzip member at ``at``. A member that fails a check or is above ``LARGEST_MEMBER`` has no end and what
    could be decompressed of it; where no member starts, there is no content either."""
    if not data.startswith(_GZIP, at):
        return None, b"", "no member here"
    reader = zlib.decompressobj(31)
    try:
        content = reader.decompress(memoryview(data)[at:], LARGEST_MEMBER)
        if reader.eof:
            return len(data) - len(reader.unused_data), content, ""
        return None, content, "member does not end" if len(content) < LARGEST_MEMBER else "member is too large"
    except zlib.error as error:
        fault = f"bad member: {error}"
    # A call that fails gives nothing, so the member is fed again in small pieces.
    reader, parts, held = zlib.decompressobj(31), [], 0
    for low in range(at, len(data), _FEED):
        try:
            parts.append(reader.decompress(data[low : low + _FEED]))
        except zlib.error:
            break
        held += len(parts[-1])
        if reader.eof or held > LARGEST_MEMBER:
            break
    return None, b"".join(parts), fault


_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r\n")


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str | None]]:
    """Records and gaps of an archive in order: offset, length, headers, block, reason.

    A gap has no headers and a reason. After a failed check the reader looks for the next version line behind the failed start that
    begins a record passing all checks; everything before it is one gap. Records and gaps cover the archive without overlap.
    Offsets are those of the file as stored. In a gzip archive they are those of the member: the content of a member is
    searched in the same way, so a bad record costs itself alone and is a gap whose reason tells its bytes in the member. Of a damaged
    member the records before the damage are kept; a gap goes from its start to the next member.
    """
    zipped = data.startswith(_GZIP) or (not _VERSION_LINE.search(data) and _GZIP in data)
    return _of_members(data) if zipped else _of_records(data)


_Found = tuple[int, int, dict[str, str] | None, bytes, str | None]


def _of_records(data: bytes) -> Iterator[_Found]:
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            end, headers, block = _parsed(data, at)
        except ValueError as error:
            if gap is None:
                gap, why = at, str(error)
            following = _VERSION_LINE.search(data, at + 1)
            if following is None:
                break
            at = following.start()
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", why
            gap = None
        yield at, end - at, headers, block, None
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", why


def _of_members(data: bytes) -> Iterator[_Found]:
    at, gap, why, saved = 0, None, "", []

    def damaged(end: int) -> Iterator[_Found]:
        for headers, block in saved:
            yield gap, end - gap, headers, block, None
        yield gap, end - gap, None, b"", why

    while 0 <= at < len(data):
        end, content, fault = _member(data, at)
        found = list(_of_records(content))
        records = [(headers, block) for _, _, headers, block, _ in found if headers is not None]
        if gap is not None and (end is not None or records):
            yield from damaged(at)
            gap = None
        if end is not None:
            for low, length, headers, block, reason in found:
                yield at, end - at, headers, block, reason and f"bytes {low} to {low + length} of the member: {reason}"
            at = end
            continue
        if gap is None:
            gap, why, saved = at, fault, records
        at = data.find(_GZIP, at + 1)
    if gap is not None:
        yield from damaged(len(data))


def _bare(identifier: str | None) -> str | None:
    return identifier.strip("<>") if identifier is not None else None


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string())]
    kinds += [("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    schema = pa.schema([*kinds, ("payload", pa.binary()), ("reason", pa.string())])
    for batch in batches:
        for row in range(batch.num_rows):
            path, rows, held = batch.column(0)[row].as_py(), [], 0
            for offset, length, headers, block, reason in salvage(batch.column(1)[row].as_py() or b""):
                if headers is None:
                    rows.append((path, offset, length, "gap", None, None, None, None, None, None, reason))
                else:
                    payload = _payload(headers, block)
                    whole = headers.get("x-payload-length", "")
                    rows.append(
                        (path, offset, length, headers.get("warc-type"), _bare(headers.get("warc-record-id")), _bare(headers.get("warc-refers-to")))
                        + (headers.get("warc-target-uri"), headers.get("warc-payload-digest"))
                        + (int(whole) if whole.isascii() and whole.isdigit() else len(payload), payload, None)
                    )
                held += len(block) + 200
                if held > ARCHIVE_BYTES // 4:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records and quarantined gaps (``record_type = 'gap'``) of all ``.warc`` and ``.warc.gz`` archives below ``folder``.

    Columns are those of ``RECORDS``; ``payload_bytes`` is the length of the full payload, for revisits too where the writer noted
    it. A task holds one archive at a time, so archives should be well below 1 GB (Spark's reader takes 2 GB at most).
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(_rows, RECORDS)


def page_of(identifier: Column) -> Column:
    """The page number in a record id that ``write_warc`` made, else null."""
    return F.regexp_extract(identifier, f"^{_RECORD_ID}(-?[0-9]+)$", 1).try_cast("bigint")
