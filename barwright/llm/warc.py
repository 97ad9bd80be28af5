"""WARC archives: a writer made of column expressions, and a reader that salvages damaged files.

Writer: each row becomes one record; Spark's text writer appends the record's closing CRLF CRLF, so archives go to any file system
that Spark can write. Reader: files arrive as bytes, checked record by record; after a failed check the next valid gzip member or
version line is searched for, later records are recovered, and the bytes between are logged as a quarantined gap. The same is done
within the bytes of a gzip member, and within those that a damaged member still gives.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import scratch_path, stash

VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are filled to about this many bytes of payload.
ARCHIVE_BYTES = 32 << 20
#: No file's payloads and urls exceed this, unless a single record does.
FILE_LIMIT = 1 << 30
#: Bytes given to the inflater at a time, so that a member costs its own length only.
STEP = 1 << 16


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: five hex digits are four base32 digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(name: Column) -> Column:
    """A stable urn:uuid for a page, from the MD5 of its id."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(name.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Decide what each page is written as: ``page_id, payload_digest, payload_bytes, record_type, refers_to``.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the largest page_id is a response and others revisit it;
    rows that share that page_id are all responses, as are the rows of a group that has no page_id, and all smaller payloads.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = stash(rows, "warc-digests")
    last = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_last"))
    rows = rows.join(last, "payload_digest", "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return rows.select(
        "page_id", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def _line(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))


def record(date: str) -> Column:
    """The record of a row with page_id, url, html, payload_digest, record_type and refers_to, without its closing CRLF CRLF.

    Header values can't hold line breaks, so those in a url become spaces.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    n = F.octet_length(payload).cast("string")
    http = F.concat(_line("HTTP/1.1 200 OK"), _line("Content-Type: text/html; charset=utf-8"), _line("Content-Length: ", n), F.lit("\r\n"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, payload))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:unknown")), r"[\r\n]+", " ")
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    extra = F.concat(_line("WARC-Profile: ", PROFILE), _line("WARC-Refers-To: ", record_id(F.col("refers_to"))), _line("X-Refers-To-Page: ", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))
    return F.concat(
        _line("WARC/1.1"), _line("WARC-Type: ", F.col("record_type")), _line("WARC-Record-ID: ", record_id(F.col("page_id"))), _line(f"WARC-Date: {date}"),
        _line("WARC-Target-URI: ", url), _line("WARC-Payload-Digest: sha1:", F.col("payload_digest")), _line("WARC-Block-Digest: sha1:", base32_sha1(block.cast("binary"))),
        F.when(revisit, extra).otherwise(F.lit("")), _line("X-Page: ", ident), _line("Content-Type: application/http; msgtype=response"),
        _line("Content-Length: ", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2026-01-01T00:00:00Z") -> None:
    """Write one record for each row of ``pages`` (page_id, url, html; others are ignored) under ``path``.

    Null html is an empty payload, a null url ``urn:unknown``. An empty table writes no record.
    """
    pages = pages.select("page_id", "url", "html")
    plan = plan_records(pages, least_bytes)
    revisits = plan.filter("record_type = 'revisit'").select(F.col("page_id").alias("_id"), "payload_digest", "refers_to")
    # The digest tells rows with equal page_id apart. Spark broadcasts the revisits if they are few, so that payloads stay where they are.
    revisits = stash(revisits.dropDuplicates(["_id", "payload_digest"]), "warc-revisits").withColumnRenamed("payload_digest", "_digest")
    rows = pages.withColumn("payload_digest", base32_sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    rows = rows.withColumn("record_type", F.when(F.col("_digest").isNotNull(), "revisit").otherwise("response"))
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("long") + F.octet_length(F.coalesce(F.col("url"), F.lit("")))
    stats = pages.agg(F.avg(size).alias("mean"), F.max(size).alias("most")).first()
    per_file = max(1, int(archive_bytes / max(stats["mean"] or 1, 256)))

    def write(part: DataFrame, records: int) -> None:
        part.select(record(date).alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)

    # Files of the usual number of records stay readable in one piece unless some records are very large: those get files with fewer.
    if per_file * (stats["most"] or 0) <= FILE_LIMIT:
        write(rows, per_file)
    else:
        large = size > FILE_LIMIT // per_file
        write(rows.filter(~large), per_file)
        write(rows.filter(large), max(1, FILE_LIMIT // stats["most"]))


# --- reading ---

_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_VERSION_LINE = re.compile(rb"WARC/1\.[^\r\n]{0,32}\r\n")
TRUNCATED = "gzip: truncated"


def _digest_ok(field: bytes | None, data: bytes) -> bool:
    if not field or not field.lower().startswith(b"sha1:"):
        return True
    return field[5:].upper() == base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest())


def parse_record(data: bytes, at: int) -> tuple[dict[bytes, bytes], int, int] | str:
    """Headers, block start and block end of the record at ``at``, or the name of the check that failed."""
    line = _VERSION_LINE.match(data, at)
    if not line:
        return "no version line"
    head: dict[bytes, bytes] = {}
    place = line.end()
    while data[place : place + 2] != b"\r\n":
        m = _HEADER.match(data, place)
        if not m:
            return "bad header line" if data.find(b"\r\n", place) >= 0 else "headers do not end"
        head[m[1].strip().lower()] = m[2].strip()
        place = m.end()
    length = head.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return "no content length"
    start, stop = place + 2, place + 2 + int(length)
    if stop + 4 > len(data):
        return "truncated"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no record end"
    if not _digest_ok(head.get(b"warc-block-digest"), data[start:stop]):
        return "block digest differs"
    return head, start, stop


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` gives, where it ends or breaks, and the failed check if there is one."""
    engine, view, out, place = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while place < len(data) and not engine.eof:
            before = engine.copy()
            out.append(engine.decompress(view[place : place + STEP]))
            place += STEP
    except zlib.error as e:
        with contextlib.suppress(zlib.error):  # the failed step again, byte by byte, for what comes before the break
            while place < len(data):
                out.append(before.decompress(view[place : place + 1]))
                place += 1
        return b"".join(out), place, f"gzip: {e}"
    return b"".join(out), min(place, len(data)) - len(engine.unused_data), "" if engine.eof else TRUNCATED


def _plain(data: bytes) -> Iterator[tuple]:
    """Records and gaps of the bytes of a member, as :func:`scan` yields them; every byte lies in exactly one."""
    at, size, gap, why = 0, len(data), None, ""
    while at < size:
        r = parse_record(data, at)
        if isinstance(r, str):
            if gap is None:
                gap, why = at, r
            at = data.find(VERSION, at + 1)
            at = size if at < 0 else at
            continue
        if gap is not None:
            yield ("gap", gap, at, why)
            gap = None
        yield ("record", at, r[2] + 4, r[0], data[r[1] : r[2]])
        at = r[2] + 4
    if gap is not None:
        yield ("gap", gap, size, why)


def _member(inner: bytes, problem: str) -> tuple[list[tuple], int]:
    """Records and gaps of a member's bytes without offsets, and where the last record ends.

    After broken data only records with a block digest count as checked.
    """
    sure, out, last = problem in ("", TRUNCATED), [], 0
    for kind, a, b, *rest in _plain(inner):
        if kind == "record" and (sure or rest[0].get(b"warc-block-digest", b"").lower().startswith(b"sha1:")):
            out.append((kind, *rest))
            last = b
        else:
            out.append(("gap", f"{rest[0] if kind == 'gap' else 'no digest after ' + problem}, inflated bytes {a} to {b}"))
    return out + ([("gap", problem)] if problem else []), last


def _candidates(data: bytes, at: int) -> Iterator[int]:
    """Places after ``at`` where a version line or a gzip member may begin."""
    marks = {m: data.find(m, at + 1) for m in (VERSION, GZIP)}
    while places := [p for p in marks.values() if p >= 0]:
        at = min(places)
        yield at
        marks = {m: data.find(m, at + 1) if p == at else p for m, p in marks.items()}


def _after_break(data: bytes, at: int, last: int) -> int:
    """Where to go on after a broken member: the next mark behind the bytes that its first ``last`` inflated bytes came from.

    The inflater may run over the next member's beginning before it notices, so its own place would be too late.
    """
    engine, view, place = zlib.decompressobj(31), memoryview(data), at
    step = STEP
    while last > 0 and place < len(data):
        piece, before = view[place : place + step], engine.copy()
        try:
            last -= len(engine.decompress(piece, last))
        except zlib.error:  # the break is in this step: byte by byte, the bytes looked for come before it
            if step == 1:
                break
            engine, step = before, 1
            continue
        place += len(piece) - len(engine.unconsumed_tail)
    # It may have looked two bytes ahead.
    return next(_candidates(data, max(at, place - 3)), len(data))


def scan(data: bytes) -> Iterator[tuple]:
    """Records and gaps of an archive, in file order.

    Yields ``("record", offset, end, headers, block)`` and ``("gap", offset, end, failed check)``. Every byte of ``data`` lies in exactly one of them,
    but for gzip members that hold several records or gaps, which share the member's offsets.
    """
    at, size, gap, why = 0, len(data), None, ""
    while at < size:
        found: list[tuple] = []
        end = at
        if data[at : at + 3] == GZIP:
            inner, end, problem = _inflate(data, at)
            found, last = _member(inner, problem)
            if all(x[0] == "gap" for x in found):
                problem = problem or (found[0][1] if found else "empty member")
                found = []
            elif problem:
                end = _after_break(data, at, last)
        else:
            r = parse_record(data, at)
            problem = r if isinstance(r, str) else ""
            if not problem:
                found, end = [("record", r[0], data[r[1] : r[2]])], r[2] + 4
        if not found:
            if gap is None:
                gap, why = at, problem
            at = next(_candidates(data, at), size)
            continue
        if gap is not None:
            yield ("gap", gap, at, why)
            gap = None
        yield from ((kind, at, end, *rest) for kind, *rest in found)
        at = end
    if gap is not None:
        yield ("gap", gap, size, why)


def _payload(head: dict[bytes, bytes], block: bytes) -> tuple[bytes, int | None]:
    """Payload of an HTTP block, and the length that the HTTP headers state for it."""
    if not head.get(b"content-type", b"").lower().startswith(b"application/http"):
        return block, len(block)
    top, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)", top)
    return body, int(m[1]) if m else None


SCHEMA = (
    "path string, offset long, end_offset long, gap string, record_type string, record_id string, target_uri string, "
    "refers_to_id string, page_id string, refers_to string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"
)
_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("end_offset", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()),
])


def _rows(path: str, data: bytes, payloads: bool) -> Iterator[dict]:
    text = lambda head, name: head[name].decode("utf-8", "replace") if name in head else None
    for kind, at, end, *rest in scan(data):
        row = dict.fromkeys(_ARROW.names) | {"path": path, "offset": at, "end_offset": end}
        if kind == "gap":
            yield row | {"gap": rest[0]}
            continue
        head, block = rest
        body, stated = _payload(head, block)
        kind = text(head, b"warc-type")
        digest = text(head, b"warc-payload-digest")
        yield row | {
            "record_type": kind, "record_id": text(head, b"warc-record-id"), "target_uri": text(head, b"warc-target-uri"),
            "refers_to_id": text(head, b"warc-refers-to"), "page_id": text(head, b"x-page") or None, "refers_to": text(head, b"x-refers-to-page") or None,
            "payload": body if payloads else None, "payload_bytes": stated if kind == "revisit" else len(body),
            "payload_digest": digest.partition(":")[2].upper() if digest else None,
            "digest_ok": kind == "revisit" or _digest_ok(head.get(b"warc-payload-digest"), body),
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record under ``path``, and a row with ``gap`` set for each quarantined stretch of bytes.

    Handles plain records and gzip members, mixed in one file as well. A file is read whole by one task, so it must fit there.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows, held = [], 0
                for row in _rows(name.as_py(), content.as_py() or b"", payloads):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, SCHEMA)


def intact(records: DataFrame) -> DataFrame:
    """``records`` as they are; the job fails where it meets a gap, or a payload that its digest doesn't match, instead of leaving them out."""
    damaged = F.col("gap").isNotNull() | ~F.coalesce("digest_ok", F.lit(False))
    # A filter, since a column that nobody reads is never computed.
    return records.filter(F.when(damaged, F.raise_error(F.concat_ws(" ", F.lit("damaged archive:"), "path", "offset", "gap")).cast("boolean")).otherwise(True))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what the reader finds in them. An empty table gives an empty one; null html is an empty payload.

    Archives that were damaged since they were written make the job fail.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    found = intact(read_archives(pages.sparkSession, path, payloads=False))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
