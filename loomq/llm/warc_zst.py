"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record.

An archive is a file part-*.warc.zst-like of: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one
Zstandard frame a record. Spark's committed text writer makes the files; the line separator it puts after each value is
an empty skippable frame (magic 0x184D2A50), which every reader of the format skips. An archive is rolled at a fixed size,
so their number follows the bytes and not the partitions, and one fits a task that reads it whole.

Defined cases: null html is an empty payload, and so equal to all other empty ones; null page_ids and urls come back null
(url as ''). Repeated rows are records each. An html of any length is one record, and an archive of its own where it is
larger than that size. An empty table gives no archives and no rows. Columns but page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: The dictionary is fitted on this many payloads at most, those of the smallest hashes, and this many bytes of each: it only
#: serves compression. Parameters of write_archives.
SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 512, 16_384, 65_536
#: Bytes at which an archive is closed and the next one begun.
ARCHIVE_BYTES = 32 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends: from its block headers, without decompressing it."""
    start = at
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME_MAGIC:
            checksum = data[at + 4] & 4
            at += zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                head = int.from_bytes(data[at : at + 3], "little") if at + 3 <= len(data) else None
                if head is None:
                    raise ValueError(f"the frame at byte {start} is cut off")
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError(f"the frame at byte {start} has a block of no known kind")
                at += 3 + (1 if kind == 1 else size)
            at += 4 * bool(checksum)
        else:
            raise ValueError(f"byte {start} begins no frame")
    except (struct.error, zstandard.ZstdError) as e:
        raise ValueError(f"the frame at byte {start} is cut off") from e
    if at > len(data):
        raise ValueError(f"the frame at byte {start} is cut off")
    return at


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; ValueError for anything but one whole record."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError("a record does not begin with a WARC version and headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record lacks {name}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ValueError(f"content-length {headers['content-length']!r}")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a record of content-length {n} has {len(rest) - 4} bytes")
    return headers, rest[:n]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, each from a frame of its own."""
    view, at, unzip = memoryview(data), 0, zstandard.ZstdDecompressor()
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICT_MAGIC:
        at = frame_end(view, 0)
        body = bytes(view[8:at])
        if body[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", view, at)[0] == FRAME_MAGIC:
            yield parse_record(unzip.decompressobj().decompress(view[at:end]))
        at = end


def fitted_dictionary(pages: DataFrame, column: str = "html", *, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from at most sample_pages distinct payloads, those of the smallest hashes; b"" if they are too few to fit one.

    Hashes are chosen first, so that no task sends payloads that are not taken.
    """
    rows = pages.where(F.length(column) > 0).select(F.substring(F.encode(column, "UTF-8"), 1, sample_bytes).alias("x"), F.xxhash64(column).alias("h"))
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    taken = rows.where(F.col("h").isin(least)).groupBy("h").agg(F.min("x").alias("x")) if least else None
    samples = [bytes(r.x) for r in sorted(taken.collect(), key=lambda r: r.h)] if taken else []
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_digest, record_type and refers_to.

    Of equal payloads the largest page_id is the response and the others revisit it; rows that share that page_id are
    all responses, as are rows of a payload whose page_ids are all null. A null page_id beside others is a revisit.
    Payloads count as equal if length and SHA-1 are. The digest's group is aggregated before the shuffle, and the join
    back is one that Spark can split where a payload is very common.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    best = rows.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("best"))
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return rows.join(best, ["sha1", "payload_bytes"]).select(
        "page_id", "url", "payload", "payload_bytes", "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"),
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit has payload None: it keeps the digest and length, not the bytes."""
    block = HTTP_HEAD % n + (payload or b"")
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    lines = [VERSION, b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + clean]
    lines += [b"WARC-Payload-Digest: sha1:" + digest.encode(), f"X-Payload-Length: {n}".encode()]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: " + REVISIT_PROFILE.encode()]
    lines += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", level: int = 3, archive_bytes: int = ARCHIVE_BYTES, sample_pages: int = SAMPLE_PAGES, sample_bytes: int = SAMPLE_BYTES) -> None:
    """Archives of about archive_bytes of pages (page_id, url, html), into folder."""
    dictionary = fitted_dictionary(pages, sample_pages=sample_pages, sample_bytes=sample_bytes)
    head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row an archive."""
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
        archive = bytearray()
        for b in batches:
            for k in range(b.num_rows):
                page_id, url, payload, n, sha1, kind, refers = (c[k].as_py() for c in b.columns)
                frame = squeeze.compress(record_bytes(page_id, url, payload, n, base64.b32encode(sha1).decode(), kind, refers, date))
                if archive and len(archive) + len(frame) > archive_bytes:
                    yield pa.record_batch({"archive": pa.array([bytes(archive)], pa.binary())})
                    archive = bytearray()
                archive += frame if archive else head + frame
        if archive:
            yield pa.record_batch({"archive": pa.array([bytes(archive)], pa.binary())})

    rows = with_revisits(pages)
    rows = rows.select("page_id", "url", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "payload_bytes", "sha1", "record_type", "refers_to")
    archives = _shared.arrow(rows, encode, "archive binary")
    archives = archives.select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", SEPARATOR.decode()).option("compression", "none").option("maxRecordsPerFile", 1).text(folder)


def read_archives(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """Every record of the archives in folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload].

    A record that is cut off, has no such headers, a wrong length or a payload that its digest does not fit, is an error.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for data in b.column(0):
                rows: list[tuple] = []
                for headers, block in read_archive(data.as_buffer()):
                    kind, n = headers["warc-type"], int(headers["x-payload-length"])
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and (len(payload) != n or payload_digest(payload) != digest):
                        raise ValueError(f"the payload of {headers['warc-record-id']} does not fit its digest")
                    rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, kind, number(headers.get("warc-refers-to")), *[payload] * payloads))
                    if len(rows) == 2000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return _shared.arrow(files, decode, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back; one row a page."""
    folder = f"{_shared.shared_folder(pages.sparkSession)}/warc"
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)
