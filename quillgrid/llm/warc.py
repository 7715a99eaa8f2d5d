"""Zstandard WARC archives: a writer and a reader.

An archive file begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is a frame of its own.  Files are written through Spark's
text writer, whose line separator is an empty skippable frame: the writer's commit
protocol and any Hadoop file system serve, and every reader skips the separators.

The reader loads the dictionary of each file, decodes frame by frame, and checks
that a frame holds one record, that the version, the required headers and both
content lengths hold, and that a response's digest is that of its payload.

A payload that occurs in several pages is stored once: the page with the smallest
id is the response, the others revisit it.

Defined results: a null payload is empty; a null id is written without a number and
read as null, is never chosen as response over a number, and such a page refers to
no page (if all copies have null ids, all are responses); rows with one id and one payload
are of one type; control characters in an address are percent-encoded; an empty
table writes no file and gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_path

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class BadArchive(ValueError):
    """A file that is no such archive, with the file's name and the place."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    name = lambda p: f"<urn:x-page:{'' if p is None else p}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve as the dictionary
        return b"".join(samples)[:size] or b"\r\n\r\n\r\n\r\n"


def first_of_payload(pages: DataFrame, *, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """(page, hash, first): the pages that revisit another, and the page they revisit.

    Counted by hash first (copies meet as one row a task), then joined back by the
    hash as text, so that a hash with many pages is a split join and not one task.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    hashed = pages.select(F.col(key).cast("long").alias("page"), F.sha1(raw).alias("hash"), F.octet_length(raw).alias("size"))
    counted = (
        hashed.filter(F.col("size") >= least_bytes)
        .groupBy(F.unhex("hash").alias("raw"))
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull())
        .select(F.lower(F.hex("raw")).alias("of"), "first")
    )
    met = hashed.join(counted, F.col("hash") == F.col("of"))
    return met.filter(F.col("page").isNull() | (F.col("page") != F.col("first"))).select("page", "hash", "first").distinct()


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0, dictionary_bytes: int = 16_384, train_bytes: int = 1 << 20, level: int = 3) -> None:
    """Write one archive file a partition.  A file's dictionary is trained on its first ``train_bytes``."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    again = first_of_payload(pages, key=key, payload=payload, least_bytes=least_bytes)
    left = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("payload")).withColumn("sha", F.sha1("payload"))
    # joined by the id, of which no value is hot; a null id takes part
    joined = left.join(again, F.coalesce("page_id", F.xxhash64("sha")).eqNullSafe(F.coalesce("page", F.xxhash64("hash"))) & left["page_id"].eqNullSafe(again["page"]) & (left["sha"] == again["hash"]), "left")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, press = [], 0, None

        def frames(records: list[bytes]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(records, pa.binary())], names=["frame"])

        def begin() -> list[bytes]:
            nonlocal press
            body = train_dictionary(held, dictionary_bytes)
            press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(body), write_checksum=True, write_content_size=True)
            return [struct.pack("<II", DICTIONARY_FRAME, len(body)) + body, *map(press.compress, held)]

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [record(p, u, d, r, date) for p, u, d, r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                if press is None:
                    held += made
                    size += sum(map(len, made))
                    if size >= train_bytes:
                        yield frames(begin())
                        held.clear()
                else:
                    yield frames([press.compress(r) for r in made])
        if held:
            yield frames(begin())

    encoded = joined.select("page_id", "url", "payload", "first").mapInArrow(encode, "frame binary")
    encoded.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "none").mode("overwrite").text(path)


def frames(data: bytes, name: str = "") -> Iterator[bytes]:
    """The decoded frames of an archive file."""
    view, at, engine = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise BadArchive(f"{name}: {len(view) - at} bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise BadArchive(f"{name}: the skippable frame at {at} is cut off")
            if magic == DICTIONARY_FRAME and at == 0:
                body = bytes(view[8 : 8 + size])
                if body[:4] == struct.pack("<I", FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body)
                engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if magic != FRAME:
            raise BadArchive(f"{name}: no frame at {at}")
        decoder, parts, begun = engine.decompressobj(), [], at
        try:
            while not decoder.eof and at < len(view):
                piece = view[at : at + 16_384]
                parts.append(decoder.decompress(piece))
                at += len(piece)
        except zstandard.ZstdError as e:
            raise BadArchive(f"{name}: the frame at {begun} can't be decoded: {e}") from e
        if not decoder.eof:
            raise BadArchive(f"{name}: the frame at {begun} is cut off")
        at -= len(decoder.unused_data)
        yield b"".join(parts)


def _headers(lines: list[bytes], where: str) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    for line in lines:
        k, colon, v = line.partition(b":")
        if not colon or not k.strip() or k.strip().lower() in out:
            raise BadArchive(f"{where}: header {line[:60]!r}")
        out[k.strip().lower()] = v.strip()
    return out


def parse(frame: bytes, where: str = "") -> tuple:
    """A frame's only record as the fields of RECORD."""
    head, gap, rest = frame.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise BadArchive(f"{where}: no WARC version")
    h = _headers(lines[1:], where)
    if missing := [k for k in REQUIRED if k not in h]:
        raise BadArchive(f"{where}: no header {missing[0].decode()}")
    if not h[b"content-length"].isdigit() or len(rest) != int(h[b"content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"{where}: the block's length is not its content-length")
    top, gap, body = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not top.startswith(b"HTTP/"):
        raise BadArchive(f"{where}: no HTTP header")
    http = _headers(top.split(b"\r\n")[1:], where)
    kind, sha = h[b"warc-type"].decode(), h.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    if not http.get(b"content-length", b"").isdigit():
        raise BadArchive(f"{where}: no length of the payload")
    size = int(http[b"content-length"])
    page, refers = (re.fullmatch(rb"<urn:x-page:(-?\d*)>", h[k]) if k in h else None for k in (b"warc-record-id", b"warc-refers-to"))
    if page is None or kind == "revisit" and (refers is None or body):
        raise BadArchive(f"{where}: a record's name or a revisit's target")
    if kind == "response" and (size != len(body) or sha != digest(body)):
        raise BadArchive(f"{where}: the payload's length or digest")
    if kind not in ("response", "revisit"):
        raise BadArchive(f"{where}: type {kind}")
    number = lambda m: int(m[1]) if m and m[1] else None
    return number(page), h.get(b"warc-target-uri", b"").decode(), size, sha, kind, number(refers) if kind == "revisit" else None, body if kind == "response" else None


def read(spark, path: str, *, payloads: bool = True) -> DataFrame:
    """One row of RECORD for each record of the archive files under ``path``; a revisit has no payload."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                for k, f in enumerate(frames(data.as_py(), name.as_py())):
                    r = parse(f, f"{name}, record {k}")
                    rows.append(r if payloads else (*r[:-1], None))
                    size += len(f)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(decode, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path, payloads=False)
