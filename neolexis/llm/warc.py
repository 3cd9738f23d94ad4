"""WARC archives: segmented records with chunked transfer framing, written and read back through Spark.

Records are gzip members of their own, as the format advises. Spark's text writer puts them into files under
its commit protocol, so lost executors leave no half files: a row is a bundle of compressed records, and the
writer's line separator is an empty gzip member, which readers skip. That writer passes a string's bytes on as they
are, valid UTF-8 or not.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, scratch_path

#: Bytes of block in one record; larger ones go on in continuation records.
SEGMENT = 64 << 10
#: Compressed bytes of records that make up one row of the writer, about, and rows of a file: files have up to 48 MB
#: or so, whatever the sizes of pages, which bounds a reading task's memory and the number of files.
BUNDLE, BUNDLES_A_FILE = 1 << 20, 48
CHUNK = 8 << 10
#: Bytes handed to the decompressor at once.
PIECE = 16 << 10
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PARTS = "origin string, number int, total long, kind string, page_id long, refers_to long, digest string, payload_bytes long, block binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer coding of a payload."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked framing: sizes in hex with optional extensions, then trailers. Raises ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_records(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> Iterator[bytes]:
    """The compressed records of a page: one, or a first segment and its continuations."""
    uri = "".join(c for c in (url or "urn:none") if c > " ") or "urn:none"
    common = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload))]
    if page_id is not None:
        common.append(("X-Page-ID", str(page_id)))
    kind = "application/http; msgtype=response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *common, *extra, ("Content-Type", kind)], http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), *common, ("Content-Type", kind)]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        own = uuid.uuid5(uuid.UUID(record_id), str(n))
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(fields, part)


def write_warc(pages: DataFrame, path: str, least_revisit: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html); other columns play no part.

    Of rows with equal payloads of at least least_revisit bytes, those with the smallest page_id are responses
    and the others revisit it; null ids come last, and rows repeated with the smallest id are all responses. A
    null html is an empty payload. Payloads are compared by SHA-1 and length.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("same", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = rows.groupBy("same", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("size") >= least_revisit)).drop("n")
    # written first: Spark splits the tasks of a payload that a third of all pages share only in joins whose sides
    # come straight from a shuffle
    first = Scratch(pages.sparkSession).save(first, "first")
    joined = rows.join(first, ["same", "size"], "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, done, held, kept = [], [], 0, 0
            for page, url, payload, first_page in zip(*(c.to_pylist() for c in batch.columns)):
                row += 1
                # one task writes all segments of a page, and only one attempt of a task is committed
                record_id = str(uuid.uuid5(uuid.NAMESPACE_OID, f"{part} {row} {page}"))
                revisit = first_page is not None and page != first_page
                for record in page_records(record_id, page, url, payload, first_page, revisit, date):
                    done.append(record)
                    held += len(record)
                    if held > BUNDLE:
                        rows.append(b"".join(done))
                        done, kept, held = [], kept + held, 0
                if kept > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                    rows, kept = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([*rows, b"".join(done)] if done else rows, pa.binary())], names=["value"])

    records = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    records.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", BUNDLES_A_FILE).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        # in pieces: what follows a member is handed back as a copy, which must not be the whole rest of the file
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("cut gzip member")
            piece = view[at : at + PIECE]
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        raw = b"".join(parts)
        if not raw:
            continue
        head, _, block = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, block[: int(fields["content-length"])]


def reassemble(parts: list[tuple[int, bytes, int | None]]) -> bytes:
    """A block from its segments (number, bytes, total length, which the last one has); verified."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[1] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or repeated")
    if len(parts) > 1 and (parts[-1][2] is None or parts[-1][2] != len(block)):
        raise ValueError("segments don't add up to the total length")
    return block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits, or if not asked for).

    Files are read whole; their size is bounded. Records are shuffled by origin
    identifier, and only segments carry their bytes along: a page's segments may lie in any files. Payload and digest of a response
    are computed from the decoded bytes and compared with the digest in the archive; ValueError says what is
    broken.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    part_names, part_kinds = [x.split()[0] for x in _PARTS.split(", ")], [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    read_names, read_kinds = [x.split()[0] for x in _READ.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    def checked(page: int | None, digest: str, payload: bytes) -> tuple[str, int, bytes | None]:
        own = sha1_base32(payload)
        if "sha1:" + own != digest:
            raise ValueError(f"payload of page {page} doesn't have the archive's digest")
        return own, len(payload), payload if payloads else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a record that is whole is decoded here; number 0 marks it
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for fields, block in parse_warc(batch.column(0)[i].as_buffer().to_pybytes()):
                    number = lambda name: int(fields[name]) if name in fields else None  # noqa: E731, B023
                    kind, page, refers, digest = fields["warc-type"], number("x-page-id"), number("x-refers-to-page"), fields.get("warc-payload-digest")
                    if kind == "revisit":
                        size = int(block.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        rows.append((fields["warc-record-id"], 0, None, kind, page, refers, digest.removeprefix("sha1:"), size, None))
                    elif "warc-segment-number" not in fields:
                        own, size, payload = checked(page, digest, payload_of(block))
                        rows.append((fields["warc-record-id"], 0, None, kind, page, None, own, size, payload))
                        held += len(payload or b"")
                    else:
                        origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
                        rows.append((origin, number("warc-segment-number"), number("warc-segment-total-length"), kind, page, None, digest, None, block))
                        held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows, part_names, part_kinds)
                        rows, held = [], 0
                yield batch_of(rows, part_names, part_kinds)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def page() -> tuple:
            block = reassemble([(r[1], r[8], r[2]) for r in held])
            own, size, payload = checked(held[0][4], held[0][6], payload_of(block))
            return held[0][4], size, own, held[0][3], None, payload

        for batch in batches:
            done = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != r[0]:
                    done.append(page())
                    held = []
                if r[1] == 0:
                    done.append((r[4], r[7], r[6], r[3], r[5], r[8]))
                else:
                    held.append(r)
            yield batch_of(done, read_names, read_kinds)
        if held:
            yield batch_of([page()], read_names, read_kinds)

    return files.mapInArrow(parse, _PARTS).repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(together, _READ)


def archive(pages: DataFrame, least_revisit: int = 0, payloads: bool = False) -> DataFrame:
    """Write pages to the shared folder and read the archives back. An empty table gives an empty result."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, least_revisit)
    return read_warc(spark, path, payloads)
