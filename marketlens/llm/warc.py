"""WARC archives: a writer, and a reader that splits archives into byte ranges.

Every page becomes one gzip member. Of the records with equal payloads the one with
the largest page id is the ``response``; the others are ``revisit`` records that
name it and carry no payload. The reader deals byte ranges of the archives to
tasks: a task looks for the gzip magic in its range, accepts a candidate only if a
whole member decodes there and starts with a valid WARC header, and owns the
records that start inside its range, reading past its end for the last one.

Archives are written to the shared folder by the tasks themselves, under a name
that no other attempt uses; only the files that a successful attempt reports are
read, so a lost or repeated task leaves nothing behind in the result.

Defined cases: a null payload is empty; a null page id keeps its record (an equal
payload with an id is then the response; without one, all are responses); rows that
repeat the largest id are all responses; control characters in a URL are
percent-encoded in the header; payloads of any length are written whole; an empty table
writes no archive and gives no rows. Extra columns, of any name, never reach the operator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm.common import stored
from marketlens.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 20
RECORDS = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
           "refers_to long, payload binary")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, keeper, date: str) -> bytes:
    """One record, uncompressed. ``keeper`` is the page it revisits, or None."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if keeper is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if keeper is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"X-Refers-To-Page-Id: {keeper}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, *, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write rows (page_id, url, payload, keeper) and return the manifest (path, size)."""
    def run(batches):
        out = None
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        size = 0
        for b in batches:
            if out is None and b.num_rows:
                out = fs.open_output_stream(name, compression=None, buffer_size=READ_BYTES)
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                payload = row[2].encode("utf-8", "surrogatepass")
                size += out.write(z.compress(_record(row[0], row[1], payload, row[3], date)) + z.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": pa.array([size], pa.int64())})

    manifest = pages.select("page_id", "url", "payload", "keeper").mapInArrow(run, "path string, size long")
    return stored(manifest, "warc-manifest")


def _header(data: bytes):
    """Fields of a decoded member, and where its block starts; None if it isn't a record."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    try:
        length = int(fields[b"content-length"])
    except (KeyError, ValueError):
        return None
    if b"warc-type" not in fields or len(data) != end + 4 + length + 4:
        return None
    return fields, end + 4


class _Window:
    """Bytes of a file from an offset on, read in pieces and dropped once passed."""

    def __init__(self, source, start: int, size: int):
        self.source, self.base, self.size, self.data = source, start, size, b""
        source.seek(start)

    def more(self) -> bool:
        piece = self.source.read(min(READ_BYTES, self.size - self.base - len(self.data)))
        self.data += piece
        return bool(piece)

    def drop(self, upto: int) -> None:
        if upto - self.base >= READ_BYTES:
            self.data, self.base = self.data[upto - self.base:], upto

    def find(self, at: int, end: int) -> int:
        """Offset of the next magic in [at, end), or -1."""
        while True:
            hit = self.data.find(MAGIC, at - self.base)
            if hit >= 0:
                return self.base + hit if self.base + hit < end else -1
            at = max(at, self.base + len(self.data) - len(MAGIC) + 1)
            if at >= end or not self.more():
                return -1

    def member(self, at: int):
        """Decoded bytes of the member at an offset and the offset behind it, or None."""
        z, parts, pos = zlib.decompressobj(31), [], at - self.base
        try:
            first = True
            while not z.eof:
                if pos >= len(self.data) and not self.more():
                    return None
                piece = self.data[pos:]
                pos += len(piece)
                got = z.decompress(piece)
                parts.append(got)
                if first and got:
                    if not got.startswith(b"WARC/1."[:len(got)]):
                        return None
                    first = False
        except zlib.error:
            return None
        return b"".join(parts), self.base + pos - len(z.unused_data)


def read_range(uri: str, start: int, end: int, size: int):
    """Records of one archive that start in [start, end), as tuples in RECORDS' order."""
    fs, _ = _open(uri.rpartition("/")[0])
    with fs.open_input_file(_open(uri)[1]) as source:
        w, at = _Window(source, start, size), start
        while (hit := w.find(at, end)) >= 0:
            got = w.member(hit)
            parsed = _header(got[0]) if got else None
            if parsed is None:
                at = hit + 1
                continue
            (data, at), (fields, body) = got, parsed
            yield _parsed(data, fields, body)
            w.drop(at)


def _parsed(data: bytes, fields: dict, body: int):
    block = data[body:-4]
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields[b"warc-type"].decode()
    num = lambda k: int(fields[k]) if k in fields else None
    uri = fields.get(b"warc-target-uri")
    return (num(b"x-page-id"), None if uri is None else uri.decode(), kind,
            fields[b"warc-payload-digest"].decode().removeprefix("sha1:"), length, num(b"x-refers-to-page-id"),
            payload if kind == "response" else None)


def read_archives(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives in a manifest (path, size), dealt by byte range."""
    spark: SparkSession = manifest.sparkSession
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = (manifest.where("size > 0").select("path", "size", start.alias("start"))
              .repartition(max(1, spark.sparkContext.defaultParallelism * 4)))
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for path, size, at in zip(*(b.column(i).to_pylist() for i in range(3))):
                for rec in read_range(path, at, min(size, at + range_bytes), size):
                    rows.append(rec)
                    held += len(rec[6] or b"") + 300
                    if held > 4 * READ_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return ranges.mapInArrow(run, RECORDS)


def with_keeper(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, keeper): keeper is the page a record revisits, or null.

    Only payload digests that occur more than once meet the pages again.
    """
    p = pages.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = (p.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
              .agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
              .where((F.col("n") > 1) & F.col("top").isNotNull()).select("sha", "top"))
    revisits = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return (p.join(groups, "sha", "left")
            .select("page_id", "url", "payload", F.when(revisits, F.col("top")).alias("keeper")))


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write (page_id, url, html) to archives in the shared folder and read them back."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                       F.coalesce("html", F.lit("")).alias("payload"))
    manifest = write_archives(with_keeper(src, min_bytes=min_bytes), scratch_path(pages.sparkSession, "warc"))
    return read_archives(manifest, range_bytes=range_bytes)
