"""Zstandard web archives (operator 7).

An archive starts with a skippable frame that holds the compression dictionary;
after it comes one Zstandard frame per WARC record.  The reader loads the
dictionary, walks the frames by their headers, decodes one at a time and checks
the record's version line, its headers, its lengths and its payload digest.

Scale.  Archives are cut at ``archive_bytes`` of records while a partition
streams by, so a task holds one archive at a time; they are stored as rows
(archive_id, content) of a table in the shared folder, which any Hadoop file
system can hold and a lost executor cannot take along.  ``save_archives`` and
``load_archives`` exchange the same bytes as ``.warc.zst`` files.  Equal payloads
are found by an aggregate on their digests; only groups with two or more records
come back, broadcast when their number is checked to be small and joined
otherwise, so a payload shared by a third of all rows costs no single task more.

Edge cases: a null html is an empty payload; a null url is written as
``urn:x-unknown``; control characters in a url are percent-encoded; a null
page_id is written as an empty id and read back as null (as the largest of its
group it never wins against a number); rows repeated with the winning page_id
are all responses; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, materialize

DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: Bytes; the format has no smaller one.
LEAST_DICTIONARY = 256
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads up to this number are broadcast (under 100 bytes each).
BROADCAST_GROUPS = 200_000


class ArchiveError(ValueError):
    """An archive or record that breaks the format."""


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a record that refers to another one carries no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-unknown")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ArchiveError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"header {name} is missing")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ArchiveError("Content-Length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length says {n}, the record has {len(rest) - 4}")
    return Record(headers, rest[:n])


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its headers alone."""
    import zstandard

    magic, n = struct.unpack_from("<II", data, at) if len(data) >= at + 8 else (0, 0)
    if magic in SKIPPABLE:
        end = at + 8 + n
    elif magic == FRAME_MAGIC:
        head = data[at : at + 18]
        end, last = at + zstandard.frame_header_size(head), False
        while not last:
            if len(data) < end + 3:
                raise ArchiveError("a frame is cut off")
            h = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = h & 1, h >> 1 & 3, h >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * zstandard.get_frame_parameters(head).has_checksum
    else:
        raise ArchiveError(f"no frame at byte {at}")
    if end > len(data):
        raise ArchiveError("a frame is cut off")
    return end


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of one archive, one frame each."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        at = frame_end(data, 0)
        body = data[8:at]
        if body[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        end = frame_end(data, at)
        if struct.unpack_from("<I", data, at)[0] == FRAME_MAGIC:
            try:
                raw = decoder.decompressobj().decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the frame at byte {at} cannot be decoded: {e}") from e
            yield parse_record(raw)
        at = end


def train_dictionary(pages: DataFrame, samples: int = 400, sample_chars: int = 8192, size: int = 32768) -> bytes:
    """A compression dictionary from a bounded sample (``samples`` pages in hash order); empty if there is too little to train on."""
    import zstandard

    rows = bounded_sample(pages.where("html is not null").select("page_id", F.substring("html", 1, sample_chars).alias("html")), ["page_id"], samples, 7).collect()
    texts = sorted(r["html"].encode("utf-8", "surrogatepass") for r in rows)
    # a small sample gives a small dictionary
    size = min(size, sum(map(len, texts)) // 8)
    while size >= LEAST_DICTIONARY:
        try:
            return zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to names the response that a repeated payload revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    base = base.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})
    groups = base.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1").select("digest", "n", "last")
    groups = materialize(groups, "warc-groups")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    joined = base.join(groups, ["digest", "n"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, least: int = 1000, archive_bytes: int = 8 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z", dictionary: bytes | None = None) -> DataFrame:
    """(archive_id, content): the archives of ``pages``, stored in the shared folder."""
    spark = pages.sparkSession
    trained = spark.sparkContext.broadcast(train_dictionary(pages) if dictionary is None else dictionary)  # 32 KB

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        head = archive_head(trained.value)
        encoder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained.value) if trained.value else None, write_checksum=True)
        parts, raw = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([head + b"".join(parts)], pa.binary())], names=["archive_id", "content"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, date)
                parts.append(encoder.compress(record))
                raw += len(record)
                if raw >= archive_bytes:
                    yield flush()
                    parts, raw = [], 0
        if parts:
            yield flush()

    return materialize(with_revisits(pages, least).mapInArrow(kernel, "archive_id string, content binary"), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives in column ``content``; a record that fails validation fails the job."""

    def ident(value: str | None) -> int | None:
        m = re.fullmatch(rf"<{re.escape(URN)}(-?\d*)>", value or "")
        if value is not None and not m:
            raise ArchiveError(f"unknown record id {value[:60]!r}")
        return int(m[1]) if m and m[1] else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_archive(content.as_py()):
                    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = re.search(rb"(?mi)^content-length:\s*(\d+)\s*$", r.block.partition(b"\r\n\r\n")[0])
                    if not length or not re.fullmatch("[0-9a-f]{40}", digest):
                        raise ArchiveError("a record has no payload length or digest")
                    kind, n = r.headers["warc-type"], int(length[1])
                    if kind == "response":
                        if len(r.payload) != n or hashlib.sha1(r.payload).hexdigest() != digest:
                            raise ArchiveError("a payload does not match its length or digest")
                    elif kind != "revisit" or r.headers.get("warc-profile") != PROFILE or "warc-refers-to" not in r.headers or r.payload:
                        raise ArchiveError(f"a bad record of type {kind[:20]!r}")
                    rows.append((ident(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), n, digest, kind, ident(r.headers.get("warc-refers-to")), r.payload if kind == "response" else None))
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return archives.select("content").mapInArrow(kernel, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def save_archives(archives: DataFrame, folder: str) -> None:
    """Each archive as ``<archive_id>.warc.zst`` in a folder that all executors mount."""

    def kernel(rows) -> None:
        import os

        for row in rows:
            path = os.path.join(folder, f"{row['archive_id']}.warc.zst")
            with open(path + ".part", "wb") as f:
                f.write(row["content"])
            os.replace(path + ".part", path)

    archives.foreachPartition(kernel)


def load_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(archive_id, content) of the ``.warc.zst`` files in a folder of any file system."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.warc\.zst$", 1).alias("archive_id"), "content")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from the archives."""
    return read_archives(write_archives(pages)).drop("url", "payload")
