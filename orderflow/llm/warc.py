"""WARC archives, compressed record by record with a shared Zstandard dictionary.

Each task writes archives of bounded size to the shared folder. An archive
starts with a skippable frame that holds a dictionary built from records of
that archive; then every record is a Zstandard frame of its own. File names
are unique for each attempt; only files in the (checkpointed) manifest of
finished tasks are read, so a lost or repeated task leaves nothing that counts.

Of records with equal payloads of ``REVISIT_BYTES`` or more the one with the
smallest page id is a response; the others are revisits that refer to it.

Defined cases: a null page text is the empty payload; rows that repeat the
smallest id and its payload are responses too; a page without an id is a
revisit of an equal page with an id, else a response; a missing URL is written
as ``about:blank``, control characters and blanks in a URL as %XX.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import cut_lineage, ensure_checkpoint_dir

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20            # of payload; then a new archive begins
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20   # the dictionary, and the records it is built from
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"       # pages carry no date


def record_plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null for responses."""
    payload = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first.select("digest", "first"), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    target = "".join(c if 32 < ord(c) != 127 else f"%{ord(c):02X}" for c in url or "") or "about:blank"
    headers = [("WARC-Record-ID", _page_urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", headers, http + payload)
    return _record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_urn(refers_to))], http)


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where the samples allow it, else their own bytes as a raw dictionary."""
    size = min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(s[:2048] for s in samples)[-size:].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One file: dictionary frame, then a frame for each record."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self._out = path, store.open_output_stream(path, compression=None)
        self._waiting: list[bytes] = []
        self._sampled, self.payload_bytes, self.records = 0, 0, 0
        self._compress: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.payload_bytes += len(record)
        if self._compress is not None:
            self._out.write(self._compress.compress(record))
            return
        self._waiting.append(record)
        self._sampled += len(record)
        if self._sampled >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        dictionary = build_dictionary(self._waiting)
        raw = dictionary.as_bytes()
        self._out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        for record in [info, *self._waiting]:
            self._out.write(self._compress.compress(record))
        self._waiting = []

    def close(self) -> None:
        if self._compress is None:
            self._begin()
        self._out.close()


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":/" in folder else os.path.abspath(folder))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of ``record_plan``; the manifest (path, records) of finished tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        done, archive = [], None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(5))):
                if archive is None:
                    archive = Archive(store, f"{base}/{uuid.uuid4().hex}.warc.zst")
                archive.add(page_record(*(v.as_py() for v in row)))
                if archive.payload_bytes >= ARCHIVE_BYTES:
                    archive.close()
                    done.append(archive)
                    archive = None
        if archive is not None:
            archive.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([a.path for a in done], pa.string()), pa.array([a.records for a in done], pa.int64())], names=["path", "records"])

    return cut_lineage(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"))


def frames(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed records of an archive, one at a time."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't start with a dictionary frame")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    data, one, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if one is not None:
                    raise ValueError("the archive ends inside a record")
                return
        one = one or decompress.decompressobj()
        parts.append(one.decompress(data))
        data = b""
        if one.eof:
            yield b"".join(parts)
            data, one, parts = one.unused_data, None, []


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(headers["content-length"])
    if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:size]


def _page_id(urn: str | None) -> int | None:
    return int(urn[len("<urn:x-page:"):-1]) if urn and urn.startswith("<urn:x-page:") else None


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of all records
    but warcinfo; digests of responses are computed anew and must agree with their headers."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def rows(path: str, store: fs.FileSystem) -> Iterator[tuple]:
        with store.open_input_stream(path, compression=None) as stream:
            for record in frames(stream):
                headers, block = parse(record)
                if headers["warc-type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                response = headers["warc-type"] == "response"
                if response and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: payload and digest differ")
                yield (_page_id(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], size, digest,
                       _page_id(headers.get("warc-refers-to")), payload if response else None)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        pack = lambda some: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some, size = [], 0
                for row in rows(path, store):
                    some.append(row)
                    size += row[3]
                    if size >= 8 << 20 or len(some) >= 2000:
                        yield pack(some)
                        some, size = [], 0
                if some:
                    yield pack(some)

    spread = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("path").repartition(max(spread, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(run, schema)


def archive_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
