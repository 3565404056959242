"""Dictionary-compressed WARC archives."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.session import scratch_folder, shuffle_width

#: Magic number of the skippable frame that holds the dictionary of a .warc.zst file.
DICTIONARY_FRAME = 0x184D2A5D
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

_MANIFEST = "path string, records bigint, bytes bigint"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, valid boolean"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` with a row per page.

    Of pages with equal payloads of `least` bytes or more, that with the largest id is
    written in full; `refers_to` of the others is its id. Null html is an empty payload.
    Rows that repeat the largest id are all written in full, as are rows without an id
    where no equal page has one.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    full = (
        rows.filter(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("full_id"), F.count("*").alias("n"))
        .filter("n > 1 and full_id is not null").select(F.col("digest").alias("same"), "full_id")
    )
    # An empty or short payload never has a partner, so its digest meets no row here.
    joined = rows.join(full, F.col("digest") == F.col("same"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("full_id")), F.col("full_id"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _uri(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    if page_id is None:
        return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}#{digest}').urn}>"
    return f"<urn:page:{page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, url, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, None, '')}", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; where they are too few to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\r\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Archive:
    """One file: the dictionary in a skippable frame, then a frame for each record."""

    def __init__(self, folder: str, sample_bytes: int, dictionary_bytes: int, level: int) -> None:
        self.store, base = open_folder(folder)
        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.sample_bytes, self.dictionary_bytes, self.level = sample_bytes, dictionary_bytes, level
        self.waiting: list[bytes] = []
        self.size = self.records = 0
        self.out = self.compressor = None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.records += 1
        if self.compressor is None:
            self.waiting.append(record)
            if self.size >= self.sample_bytes:
                self._start()
        else:
            self.out.write(self.compressor.compress(record))

    def _start(self) -> None:
        dictionary = build_dictionary(self.waiting, self.dictionary_bytes)
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        self.out = self.store.open_output_stream(self.path, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=dictionary)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> dict:
        if self.compressor is None:
            self._start()
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.size}


def write_archives(
    records: DataFrame,
    folder: str,
    *,
    archive_bytes: int = 64 << 20,
    sample_bytes: int = 2 << 20,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
) -> DataFrame:
    """Write planned records as ``.warc.zst`` files into `folder`; returns ``path, records, bytes``.

    Each task starts a new file after `archive_bytes` of records. The dictionary of a file is
    built from its first `sample_bytes` of records. Files have names of their own, so that a
    task that is run again never meets half a file; only files of tasks that ended well are in
    the returned table, and others are deleted. No row gives no file.
    """
    spark = records.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                page_id, url, payload, digest, refers_to = (value.as_py() for value in row)
                archive = archive or _Archive(folder, sample_bytes, dictionary_bytes, level)
                archive.add(record_bytes(page_id, url, payload, digest, refers_to))
                if archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    store, base = open_folder(folder)
    store.create_dir(base)
    listed = f"{folder}/manifest"
    records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, _MANIFEST).write.parquet(listed)
    manifest = spark.read.schema(_MANIFEST).parquet(listed)
    kept = {r.path for r in manifest.select("path").toLocalIterator()}
    for info in store.get_file_info(fs.FileSelector(base)):
        if info.path.endswith(".warc.zst") and not any(info.path.endswith(p.rsplit("/", 1)[1]) for p in kept):
            store.delete_file(info.path)
    return manifest


def read_records(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record of an open ``.warc.zst`` file."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(length)))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True)
    lines = io.BufferedReader(reader, 1 << 20)
    while lines.readline():
        fields = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = lines.read(int(fields["content-length"]))
        lines.read(4)
        yield fields, block


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>")
    return int(name[len("urn:page:") :]) if name.startswith("urn:page:") else None


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of written archives: ids, sizes, digests, kinds, and payloads if asked for.

    `valid` tells whether the digest of a payload read back is the one in its header; a
    revisit has no payload, and its size and digest come from its headers.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        names = schema.names
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for fields, block in read_records(stream):
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        kind = fields["warc-type"]
                        found = hashlib.sha1(body).hexdigest() if kind == "response" else digest
                        row = (
                            _page(fields["warc-record-id"]), fields["warc-target-uri"], length, found, kind,
                            _page(fields.get("warc-refers-to")), found == digest and (kind != "response" or len(body) == length),
                        )
                        rows.append(row + ((body if kind == "response" else None),) * payload)
                        size += len(block) if payload else 200
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names)

    ddl = _RECORD + ", payload binary" * payload
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("valid", pa.bool_())] + [("payload", pa.binary())] * payload
    )
    return manifest.select("path").repartition(shuffle_width(spark), "path").mapInArrow(read, ddl)


def archive_folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
