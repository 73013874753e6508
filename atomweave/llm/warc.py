"""WARC archives: written by Spark's text sink, read back by a reader that salvages damaged files.

A record is text (its payload is UTF-8), so the sink writes records as they are, one file per task, with an optional
codec. The reader takes whole files as bytes. It trusts a record only if its header parses, its block has the stated
length, and its digest agrees; after a failed check it searches for the next version line (or, in compressed files, the
next gzip member), goes on from there, and lists the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shipping import map_batches

SMALLEST = 100  # bytes; smaller payloads are always written whole
RECORDS_PER_FILE = 5_000
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def with_origins(pages: DataFrame) -> DataFrame:
    """Adds ``payload``, ``payload_bytes``, ``payload_digest`` and ``refers_to`` (null for responses)."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = own.where(F.col("payload_bytes") >= SMALLEST).select("page_id", "payload_digest")
    shared = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    revisits = large.join(shared, "payload_digest").where("page_id > first").select("page_id", "payload_digest", F.col("first").alias("refers_to")).distinct()
    return own.join(revisits, ["page_id", "payload_digest"], "left")


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: the text of a record without its closing CRLF CRLF (the sink adds the second)."""
    crlf = "\r\n"
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat_ws(
        crlf, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_id(F.col("page_id")), F.lit("<urn:page:>"))), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return pages.select(F.concat(head, F.lit(crlf + crlf), body, F.lit(crlf)).alias("value"))


def write_warc(pages: DataFrame, path: str, codec: str | None = "gzip") -> None:
    """Writes a folder of WARC files, each at most ``RECORDS_PER_FILE`` records; of large equal payloads one is written."""
    out = records(with_origins(pages)).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE)
    (out.option("compression", codec) if codec else out).text(path)


def _unpacked(data: bytes) -> tuple[list[tuple[int, bytes]], list[tuple[int, int]]]:
    """``(offset, bytes)`` of the runs of a compressed file that could be read, and the ``(offset, length)`` that could not."""
    if not data.startswith(MEMBER):
        at = data.find(MEMBER)
        if _HEAD.search(data[:at] if at >= 0 else data) or at < 0:
            return [(0, data)], []
        runs, gaps, at = [], [(0, at)], at
    else:
        runs, gaps, at = [], [], 0
    while at < len(data):
        engine = zlib.decompressobj(31)
        parts, used = [], at
        try:
            view = memoryview(data)[at:]
            for step in range(0, len(view), 1 << 16):
                parts.append(engine.decompress(view[step:step + (1 << 16)]))
                used = at + min(len(view), step + (1 << 16))
                if engine.eof:
                    break
            parts.append(engine.flush())
            whole = engine.eof
        except zlib.error:
            whole = False
        runs.append((at, b"".join(parts)))
        if whole:
            following = used - len(engine.unused_data)
        else:  # what came before the damage is kept, the rest up to the next member is set aside
            found = data.find(MEMBER, at + len(MEMBER))
            following = found if found >= 0 else len(data)
            gaps.append((at, following - at))
        at = following
        if at < len(data) and not data.startswith(MEMBER, at):
            found = data.find(MEMBER, at)
            gaps.append((at, (found if found >= 0 else len(data)) - at))
            at = found if found >= 0 else len(data)
    return runs, gaps


def _agrees(stated: str, payload: bytes) -> bool:
    name, _, value = stated.partition(":")
    try:
        digest = hashlib.new(name.replace("-", ""), payload)
    except ValueError:
        return True  # an unknown algorithm proves nothing
    return value.lower() == digest.hexdigest() or value.rstrip("=").upper() == base64.b32encode(digest.digest()).decode().rstrip("=")


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record at ``at``, or None if any check fails."""
    head = _HEAD.match(data, at)
    blank = data.find(b"\r\n\r\n", at)
    if not head or blank < 0:
        return None
    fields = {}
    for line in data[head.end():blank].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or "warc-type" not in fields:
        return None
    begin = blank + 4
    end = begin + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    stated = fields.get("warc-payload-digest") if fields["warc-type"] != "revisit" else None
    return None if stated and not _agrees(stated, block) else (fields, block, end + 4)


def salvage(data: bytes) -> Iterator[tuple]:
    """``(offset, headers, block, None)`` for every good record and ``(offset, None, None, length)`` for every gap.

    Offsets in compressed files are those of the member that holds the record.
    """
    runs, gaps = _unpacked(data)
    for offset, length in gaps:
        yield offset, None, None, length
    for origin, run in runs:
        plain = origin == 0 and run is data
        at = 0
        while at < len(run):
            got = parse_record(run, at)
            if got:
                yield (at if plain else origin), got[0], got[1], None
                at = got[2]
                continue
            found = _HEAD.search(run, at + 1)
            following = found.start() if found else len(run)
            yield (at if plain else origin), None, None, following - at
            at = following


_READ = "file string, at long, record_type string, record_id string, uri string, digest string, stated_bytes long, refers_to string, payload binary, gap_bytes long"


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
            rows = [[] for _ in range(10)]
            held = 0

            def flush():
                types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.int64()]
                return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=[f.split()[0] for f in _READ.split(", ")])
            for at, fields, block, gap in salvage(data.to_pybytes()):
                f = fields or {}
                size = f.get("warc-payload-length", "")
                row = (name, at, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"),
                       int(size) if size.isascii() and size.isdigit() else (len(block) if fields else None), f.get("warc-refers-to"), block, gap)
                for into, value in zip(rows, row):
                    into.append(value)
                held += len(block or b"")
                if held > 8 << 20:
                    yield flush()
                    rows, held = [[] for _ in range(10)], 0
            yield flush()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files below ``path``, and one per quarantined gap (``gap_bytes`` set, the rest null)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_batches(files, _read, _READ)


def archived_pages(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records that ``read_warc`` recovered.

    A response's figures are taken from its payload as read, a revisit's from its headers.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return found.where("gap_bytes is null").select(
        number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("digest", "^sha256:", "")).alias("payload_digest"),
        "record_type", F.when(~response, number(F.col("refers_to"))).alias("refers_to"))


def round_trip(pages: DataFrame, path: str, codec: str | None = "gzip") -> DataFrame:
    """Writes ``pages`` below ``path`` and returns what the archives give back.

    Null html is an empty payload; null page ids give records without a number (page_id null) that are never referred
    to as such; a page_id that comes twice is two records, each judged by its own payload. An empty table gives no
    records. Further columns are ignored.
    """
    write_warc(pages, path, codec)
    return archived_pages(read_warc(pages.sparkSession, path))
