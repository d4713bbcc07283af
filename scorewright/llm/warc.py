"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own.  The reader's tasks take byte ranges:
each scans its range for gzip magic, accepts a candidate only if its start
decodes to a whole WARC header, decodes the member to its end, and owns exactly
the records that start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files, tokens
from .common import Scratch, bounded, only, only_cache, qualified, read, spread

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
FILE_BYTES = 256 << 20
_CHUNK = 1 << 20
#: Bytes to have at hand before a header is read; longer headers are read on.
_AHEAD = 1 << 16
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, serial: int = 0) -> bytes:
    """One record as a gzip member."""
    digest = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, f'{digest.hexdigest()}:{serial}')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, f'{digest.hexdigest()}:0')}", f"X-Refers-To-Page-Id: {refers_to}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _write(folder: str, file_bytes: int):
    schema = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def write(batches):
        only_cache()
        part = TaskContext.get().partitionId()
        out, name, size, count = None, "", 0, 0
        done = []
        for row, page_id, url, html, keep, keep_row in tokens.rows(batches, "row", "page_id", "url", "html", "keep_id", "keep_row"):
            if out is None:
                name = f"{folder}/part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.gz"
                out, size, count = files.open_out(name), 0, 0
            revisit = keep_row is not None and keep_row != row
            member = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), keep if revisit else None, revisit, 0 if keep_row == row else row + 1)
            out.write(member)
            size, count = size + len(member), count + 1
            if size >= file_bytes:
                out.close()
                done.append((name, size, count))
                out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], schema=schema)

    return write


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page; returns the files written: file, bytes, records.

    The payload is the html in UTF-8, null as empty.  Of payloads that are equal
    and have at least ``least_bytes`` bytes, one row with the largest id is
    written whole (response), the others as revisits of it, rows that repeat id
    and payload as well.  A page without id is smaller than any other; equal
    payloads of which none has an id are all written whole.  Html and urls may
    have any length.  An empty table writes no file.

    The pages are written once with a row number; which of them stays is decided
    on ids, row numbers and digests alone.  Only where many payloads recur does
    html move, by digest, in a join that can split a digest with many rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = qualified(spark, folder) if folder else scratch.path("archives")
    files.make_dir(folder)
    base = spread(only(pages, page_id=id_col, url=url_col, html=html_col)).withColumn("html", F.coalesce("html", F.lit("")))
    base = scratch.keep(base.withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha1(F.col("html").cast("binary"))}), "pages")
    groups = base.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("top")).where("n > 1 and top.page_id is not null")
    groups = scratch.keep(groups.select(F.col("digest").alias("d"), F.col("top.page_id").alias("keep_id"), F.col("top.row").alias("keep_row")), "groups")
    rows = base.join(bounded(groups), F.col("digest") == F.col("d"), "left").select("row", "page_id", "url", "html", "keep_id", "keep_row")
    done = scratch.keep(rows.mapInArrow(_write(folder, file_bytes), "file string, bytes long, records long"), "files")
    scratch.drop(base, groups)
    return done


class _Window:
    """Bytes of a file from some offset on, read in chunks; forgets what lies behind."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.pos, self.data = file, size, 0, 0, bytearray()

    @property
    def at(self) -> int:
        return self.base + self.pos

    def more(self, n: int = _CHUNK) -> bool:
        end = self.base + len(self.data)
        got = self.file.read_at(min(n, self.size - end), end) if end < self.size else b""
        self.data += got
        return bool(got)

    def move(self, offset: int) -> None:
        self.pos = offset - self.base
        if not 0 <= self.pos <= len(self.data):
            self.base, self.pos, self.data = offset, 0, bytearray()
        elif self.pos > _CHUNK:
            del self.data[: self.pos]
            self.base, self.pos = offset, 0


def _header(window: _Window) -> bool:
    """Does a gzip member here begin with a whole WARC header?"""
    z, seen, i, looked = zlib.decompressobj(31), bytearray(), window.pos, 0
    try:
        while seen.find(b"\r\n\r\n", max(0, looked - 3)) < 0:
            looked = len(seen)
            if z.eof or (i >= len(window.data) and not window.more()):
                return False
            seen += z.decompress(window.data[i : i + 512])
            i += 512
            if seen and not b"WARC/1.".startswith(seen[:7]) and not seen.startswith(b"WARC/1."):
                return False
    except zlib.error:
        return False
    return b"\r\nWARC-Type:" in seen


def _member(window: _Window) -> tuple[bytes, int] | None:
    """The member here decoded, and how many bytes it has; None if it is damaged."""
    z, parts, i = zlib.decompressobj(31), [], window.pos
    try:
        while not z.eof:
            if i >= len(window.data) and not window.more():
                return None
            piece = window.data[i : i + (1 << 16)]
            parts.append(z.decompress(piece))
            i += len(piece)
    except zlib.error:
        return None
    return b"".join(parts), i - len(z.unused_data) - window.pos


def records(uri: str, start: int, end: int):
    """Decoded records of a file whose first byte lies in [start, end)."""
    with files.open_in(uri) as file:
        window = _Window(file, file.size())
        window.move(start)
        while window.at < end:
            found = window.data.find(MAGIC, window.pos)
            if found < 0:
                window.move(max(window.at, window.base + len(window.data) - 2))
                if window.at >= end or not window.more():
                    return
                continue
            if window.base + found >= end:
                return
            window.move(window.base + found)
            if len(window.data) - window.pos < _AHEAD:
                window.more()
            if not _header(window) or (got := _member(window)) is None:
                window.move(window.at + 1)
                continue
            yield got[0]
            window.move(window.at + got[1])


def parse(raw: bytes) -> dict:
    """Fields of a decoded record of this module's writer."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    else:
        size, digest, payload = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), stated, None
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload": payload, "payload_bytes": size, "payload_digest": digest, "refers_to": number("x-refers-to-page-id")}


_READ = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _read(batches):
    for batch in batches:
        for split in batch.to_pylist():
            held, size = [], 0
            for raw in records(split["file"], split["start"], split["end"]):
                held.append({"file": split["file"]} | parse(raw))
                size += len(raw)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=_READ)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=_READ)


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of archives (file, bytes): file, page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    Files are cut into byte ranges that know nothing of record limits; every
    record comes from the one range it starts in.  Bytes between records that
    decode to no header are passed over.  A revisit has no payload of its own;
    its length and digest are those of the full payload.
    """
    splits = archives.where("bytes > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / split_bytes))))
    splits = splits.select("file", (F.col("k") * split_bytes).alias("start"), F.least((F.col("k") + 1) * split_bytes, "bytes").alias("end"))
    n = max(1, min(splits.count(), 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    schema = "file string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return splits.repartition(n, "file", "start").mapInArrow(_read, schema)


def check_read(archives: DataFrame, found: DataFrame) -> None:
    """Raise unless ``found`` (with a column file) has as many rows of each archive as were written to it."""
    read_back = found.groupBy("file").agg(F.count("*").alias("n"))
    wrong = archives.join(read_back, "file", "full").where(~F.coalesce(F.col("records") == F.coalesce("n", F.lit(0)), F.lit(False))).where("records > 0 or records is null")
    some = wrong.select("file", "records", "n").take(5)
    if some:
        raise RuntimeError(f"records read differ from records written: {[tuple(r) for r in some]}")


def op10_splittable_warc(spark, sf_dir: str) -> DataFrame:
    archives = write_warc(read(spark, sf_dir, "pages"))
    found = read_warc(archives).select("file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = Scratch(spark, "warc-records").keep(found, "records")
    check_read(archives, found)
    return found.drop("file")


OP10_SQL = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM pages
WINDOW g AS (PARTITION BY coalesce(html, ''))
"""
