"""WARC archives in Zstandard with a dictionary: writer, reader and deduplication.

Archive layout (the public ``.warc.zst`` convention): a leading skippable frame
(magic 0x184D2A5D) holds the dictionary, then every record is one Zstandard frame.
Each archive is one row of bytes, written by Spark's text sink as one file; the
sink's line separator is an empty skippable frame, which every Zstandard reader
passes over.  Archives are read back with Spark's ``binaryFile`` source, so both
directions work on any store that Spark reaches.

The dictionary is trained on a bounded sample: at most ``SAMPLE_ROWS`` payloads and
``SAMPLE_BYTES`` bytes.  A corpus too small to train on gets archives without one.

Defined results
* A null payload is empty; a null url is written as ``about:blank``; control
  characters, spaces and non-ASCII characters of a url are percent-encoded.
* A null page id is written as ``null``; it comes after all ids when the record to
  keep is chosen.
* Of equal payloads of at least ``min_bytes``, the one with the largest id is the
  response.  Repeated rows tied on that id are all responses.
* An empty table writes no archive and reads back no record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the formats
DICT_MAGIC = 0x184D2A5D
SKIP_MAGIC = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
DICT_HEAD = 0xEC30A437
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 4 << 20
DICT_BYTES = 64 << 10
ARCHIVE_BYTES = 4 << 20
BROADCAST_ROWS = 200_000

_FEED = 1 << 14

RECORDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
           "url string, payload binary, error string")


class WarcError(ValueError):
    """An archive that breaks the container or record rules."""


# ------------------------------------------------------------------ one record

def record_uri(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_of(uri: str):
    if not (uri.startswith("<urn:x-page:") and uri.endswith(">")):
        raise WarcError(f"unknown record id {uri!r}")
    word = uri[12:-1]
    return None if word == "null" else int(word)


def build_record(page_id, url: str | None, payload: bytes, digest_hex: str, refers_to=None, revisit: bool = False) -> bytes:
    """Bytes of one uncompressed WARC/1.1 record around an HTTP response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    heads = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}",
             f"WARC-Date: {WARC_DATE}", f"WARC-Target-URI: {quote(url or 'about:blank', safe=chr(37) + '/:?#[]@!$&()*+,;=~' + chr(39))}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        heads += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, first: bytes) -> tuple[dict[str, str], int]:
    """Header fields after the first line, and where the body starts."""
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        raise WarcError("headers do not end")
    lines = data[:stop].split(b"\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"starts with {lines[0][:20]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:40]!r}")
        if (key := name.decode("ascii", "replace").lower()) in fields:
            raise WarcError(f"header {key} twice")
        fields[key] = value.strip().decode("utf-8", "replace")
    return fields, stop + 4


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError("no valid Content-Length")
    return int(value)


def parse_record(data: bytes) -> dict:
    """Validate one record and return its fields; raises ``WarcError``."""
    fields, at = _headers(data, b"WARC/1.1")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    size = _length(fields)
    if data[at + size:] != b"\r\n\r\n":
        raise WarcError(f"block of {size} bytes does not end where the record does")
    block = data[at:at + size]
    http, body = _headers(block, b"HTTP/1.1 ")
    full, payload = _length(http), block[body:]
    algorithm, _, coded = fields["warc-payload-digest"].partition(":")
    if algorithm != "sha1" or len(coded) != 32:
        raise WarcError("payload digest is not sha1")
    digest = base64.b32decode(coded).hex()
    kind, refers = fields["warc-type"], None
    if kind == "response":
        if len(payload) != full or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("payload does not have its stated length and digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
            raise WarcError("revisit with a payload or without its reference")
        refers = _page_of(fields["warc-refers-to"])
    else:
        raise WarcError(f"record type {kind!r}")
    return {"page_id": _page_of(fields["warc-record-id"]), "payload_bytes": full, "payload_digest": digest, "record_type": kind,
            "refers_to": refers, "url": fields["warc-target-uri"], "payload": payload, "error": None}


# ----------------------------------------------------------------- one archive

def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive.

    A broken record comes back as a row with ``error`` set; a break in the
    container's framing ends the archive with such a row.
    """
    at, opener, first = 0, zstandard.ZstdDecompressor(), True
    view = memoryview(data)
    while at < len(data):
        try:
            if at + 8 > len(data):
                raise WarcError("cut off inside a frame header")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIP_MAGIC:
                if at + 8 + size > len(data):
                    raise WarcError("cut off inside a skippable frame")
                if magic == DICT_MAGIC:
                    if not first:
                        raise WarcError("dictionary after the first frame")
                    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(_plain_dictionary(data[at + 8:at + 8 + size])))
                at, first = at + 8 + size, False
                continue
            if magic != ZSTD_MAGIC:
                raise WarcError(f"unknown frame magic {magic:#x}")
            first = False
            frame = opener.decompressobj()
            parts, fed = [], at
            while not frame.eof and fed < len(data):
                parts.append(frame.decompress(view[fed:fed + (_FEED)]))
                fed += _FEED
            if not frame.eof:
                raise WarcError("cut off inside a record frame")
            at = min(fed, len(data)) - len(frame.unused_data)
        except (WarcError, zstandard.ZstdError) as error:
            yield _broken(f"at byte {at}: {error}")
            return
        try:
            yield parse_record(b"".join(parts))
        except (WarcError, ValueError) as error:
            yield _broken(str(error))


def _plain_dictionary(data: bytes) -> bytes:
    """The convention also allows the dictionary itself to be a Zstandard frame."""
    if data[:4] == struct.pack("<I", ZSTD_MAGIC):
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=64 << 20)
    if data[:4] != struct.pack("<I", DICT_HEAD):
        raise WarcError("leading frame holds no dictionary")
    return data


def _broken(why: str) -> dict:
    return dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")) | {"error": why}


# -------------------------------------------------------------------- on tables

def train_dictionary(pages: DataFrame, payload_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of payloads (empty if there are too few)."""
    per_row = SAMPLE_BYTES // SAMPLE_ROWS
    rows = (pages.filter(F.octet_length(payload_col) > 0).select(F.encode(F.substring(payload_col, 1, per_row), "utf-8").alias("b"))
            .limit(SAMPLE_ROWS).collect())
    samples, left = [], SAMPLE_BYTES
    for row in rows:
        if len(row.b) <= left:
            samples.append(bytes(row.b))
            left -= len(row.b)
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, samples)) // 4), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 1000) -> DataFrame:
    """(page, url, payload, digest, keeper): ``keeper`` is the id of the response if another row is, else null.

    Only digests that occur more than once take part in the join; a list of at most
    ``BROADCAST_ROWS`` of them (counted first) is broadcast, a longer one shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("long", F.octet_length("payload") >= min_bytes)
    keepers = (rows.filter("long").groupBy("digest").agg(F.max("page").alias("most"), F.count(F.lit(1)).alias("n"))
               .filter("n > 1").select(F.col("digest").alias("same"), "most"))
    small = keepers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(keepers) if small else keepers, F.col("long") & (F.col("digest") == F.col("same")), "left")
    other = F.col("most").isNotNull() & ~F.col("page").eqNullSafe(F.col("most"))
    return joined.select("page", "url", "payload", "digest", F.when(other, F.col("most")).alias("keeper"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> None:
    """Write one WARC record per row of ``pages`` as archives under ``path``.

    An archive is closed once it holds ``archive_bytes`` compressed bytes, so a task
    holds one archive and one batch of rows.
    """
    dictionary = train_dictionary(pages, payload_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
        parts, size = [archive_head(dictionary)], 0
        for batch in batches:
            for page, url, html, digest, keeper in zip(*(batch.column(i) for i in range(5))):
                payload = html.as_py()
                record = build_record(page.as_py(), url.as_py(), payload, digest.as_py(), keeper.as_py(), keeper.is_valid)
                parts.append(packer.compress(record))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, size = [archive_head(dictionary)], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    archives = mark_revisits(pages, id_col, url_col, payload_col, min_bytes).mapInArrow(pack, "archive binary")
    (archives.select(F.col("archive").cast("string")).write.option("lineSep", SEPARATOR.decode("ascii"))
     .option("maxRecordsPerFile", 1).text(path))


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (``RECORDS``).

    With ``strict`` the first broken record fails the job; without it, it is a row
    with ``error`` set.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for record in read_archive(data.as_py()):
                    if strict and record["error"]:
                        raise WarcError(record["error"])
                    rows.append(record)
                    size += len(record["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, RECORDS)
