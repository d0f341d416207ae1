"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive starts with a skippable frame that holds the dictionary, built from the archive's own first
records; then comes one frame for each record. Records whose payload equals that of another page are
written as revisits. Archives are closed after ``ARCHIVE_BYTES`` of records, so that a reader's task stays
small, and appear under their name only when complete; the list of archives is the result of writing.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, fresh_dir, written
from .files import created, opened

#: Fixed values of the formats: the skippable frame that carries a dictionary, and the dictionary's own start.
SKIPPABLE, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
#: Bytes of records from which a dictionary is built, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
LEVEL = 3
#: Repeated payloads whose table may be broadcast.
MAX_BROADCAST_ROWS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = urn[len("<urn:x-page:") : -1] if urn else "none"
    return None if found == "none" else int(found)


def _quoted(url: str) -> str:
    """A URL without line ends or other control characters."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or the revisit record of a payload that another page's record has."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_quoted(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}, rest


def parsed(data: bytes) -> dict:
    """What a record holds; the payload of a revisit is None, its size and digest are those announced."""
    head, rest = _headers(data)
    block = rest[: int(head["content-length"])]
    http, payload = _headers(block)
    out = {"page_id": _page(head["warc-record-id"]), "url": head["warc-target-uri"], "record_type": head["warc-type"]}
    if head["warc-type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(http["content-length"]), "payload_digest": head["warc-payload-digest"][5:], "refers_to": _page(head["warc-refers-to"])}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "refers_to": None}


def dictionary_of(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the records' own start where they are too few to train on."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(total // 8, 256)), records, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: holds the first records back until its dictionary can be built."""

    def __init__(self, out) -> None:
        self.out, self.held, self.size, self.n = out, [], 0, 0
        self.packer: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.n += 1
        if self.packer:
            self.out.write(self.packer.compress(data))
            return
        self.held.append(data)
        if self.size >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        if self.packer:
            return
        table = dictionary_of(self.held)
        body = table.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_checksum=True)
        for data in self.held:
            self.out.write(self.packer.compress(data))
        self.held = []


def records_of(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    body = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    data, more = b"", True
    while data or more:
        if not data:
            data = stream.read(1 << 20)
            more = bool(data)
            continue
        one, out = unpacker.decompressobj(), io.BytesIO()
        while True:
            out.write(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(1 << 20)
            if not data:
                raise EOFError("the archive ends within a record")
        yield out.getvalue()


def with_origin(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)`` of each page.

    Payloads are equal if SHA-1, length and a second 64-bit hash agree. The table of repeated payloads
    is broadcast only up to a checked number of rows; else it is joined by shuffle, where a payload
    that very many pages share is split by adaptive skew handling.
    """
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("mix"))
    keys = ["digest", "size", "mix"]
    again = own.where(F.col("size") >= LEAST_REVISIT).groupBy(*keys).agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    again = written(again.where("n > 1 and first is not null").select(*keys, "first"), "repeated")
    how = "broadcast" if again.count() <= MAX_BROADCAST_ROWS else "merge"
    both = own.join(again.hint(how), keys, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write one record for each page, and return the archives: ``(path, records, bytes)``.

    Of the records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest id is
    a response and the others revisit it (rows that repeat that id are responses too; a null id comes
    last). A null payload counts as empty, a null URL as ``about:blank``. Only the named columns are read.
    """
    spark = pages.sparkSession
    arrow_rows(spark, 200)
    folder = folder or fresh_dir(spark, "warc")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)
        while row:
            with created(folder, "pages.warc.zst") as (out, path):
                archive = Archive(out)
                while row and archive.size < ARCHIVE_BYTES:
                    archive.add(record(*row))
                    row = next(rows, None)
                archive.begin()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([archive.n], pa.int64()), pa.array([archive.size], pa.int64())], ["path", "records", "bytes"])

    rows = with_origin(pages, id_col, url_col, payload_col)
    return written(rows.mapInArrow(told, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of listed archives.

    ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])``; size and digest of a
    response are taken from its payload, those of a revisit are the ones it announces.
    """
    arrow_rows(archives.sparkSession, 200)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"payload": pa.binary()} if with_payload else {}
    n = max(1, archives.count())

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[dict] = []
                with opened(path) as stream:
                    for data in records_of(stream):
                        held.append(parsed(data))
                        if len(held) == 200:
                            yield pa.RecordBatch.from_pylist([{k: h[k] for k in kinds} for h in held], pa.schema(kinds))
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist([{k: h[k] for k in kinds} for h in held], pa.schema(kinds))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").repartition(n).mapInArrow(told, schema + (", payload binary" if with_payload else ""))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back and tell what they hold, without the payloads."""
    out = read_archives(write_archives(pages), with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
