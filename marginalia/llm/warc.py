"""WARC archives with per-archive Zstandard dictionaries, written and read back.

:func:`assign` decides by native aggregation which row of each group of equal
payloads is the response (the largest id) and which revisit it.
:func:`write_archives` turns rows into archives: a dictionary is trained on the
first records of the archive, embedded in a leading skippable frame, and every
record becomes one frame of its own, so any record can be read alone.  Archives
are rows of ``archive, content``; Spark's own writer commits them, to whatever
store it writes, and a lost executor costs only its tasks.  Their size is
bounded by ``archive_bytes`` of records.  :func:`export` puts them out as
``.warc.zst`` files, :func:`read_archives` parses them again.

Payload groups are joined with their response by payload digest; only that join
moves payloads, once.  Groups that hold more than one in ``HOT_SHARES`` of all
shared payloads, at most as many, meet a broadcast instead and are dealt evenly.

Defined results: null html is the empty payload; rows that repeat the
response's id are responses too; a null id never wins over a number (a group
without any has only responses); a null url becomes a URN; an empty table gives
no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import runtime

#: Magic number of the skippable frame that holds a dictionary (fixed value of the format).
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HOT_SHARES = 256
_SAMPLE_BYTES = 2 << 20
_DICTIONARY_BYTES = 32 << 10


def assign(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload"))
    shared = keyed.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    shared = runtime.materialize(shared, "shared")
    held = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARES > held
    often = shared.filter(hot).select("digest", "size", F.col("response").alias("often"), F.lit(True).alias("hot"))
    told = keyed.join(F.broadcast(often), ["digest", "size"], "left")
    # A hot row has its answer; a key of its own deals it evenly and meets nothing.
    key = F.when(F.col("hot"), F.concat("digest", F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("digest"))
    seldom = shared.filter(~hot).select(F.col("digest").alias("key"), "size", "response")
    joined = told.withColumn("key", key).join(seldom.hint("shuffle_hash"), ["key", "size"], "left")
    response = F.coalesce("response", "often")
    refers = F.when(~F.col("page_id").eqNullSafe(response), response)
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def _record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = "".join([f"{name}: {value}\r\n" for name, value in fields.items()])
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _urn(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One response, or a revisit whose block keeps the HTTP header only."""
    target = "".join([c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or ""]) or f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC-Record-ID": _urn(page_id, target), "WARC-Date": date, "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response"}
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if refers_to is None:
        return _record("response", fields, http + payload)
    return _record("revisit", fields | {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)}, http)


class ArchiveWriter:
    """Collects records of one archive and renders it as bytes."""

    def __init__(self, level: int = 3):
        self.level = level
        self.early: list[bytes] = []
        self.size = 0
        self.out = io.BytesIO()
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.size += len(record)
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.early.append(record)
        if self.size >= _SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(_DICTIONARY_BYTES, [r[: 64 << 10] for r in self.early], level=self.level)
        except zstandard.ZstdError:  # too few or too small records to train on: their content itself serves
            trained = zstandard.ZstdCompressionDict((b"".join(self.early)[-_DICTIONARY_BYTES:]).ljust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = trained.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for record in self.early:
            self.out.write(self.compressor.compress(record))
        self.early = []

    def finish(self) -> bytes:
        if not self.compressor:
            self._begin()
        return self.out.getvalue()


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record, frame after frame, with the embedded dictionary."""
    magic, size = struct.unpack_from("<II", content)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    held = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    decompressor = zstandard.ZstdDecompressor(dict_data=held)
    with decompressor.stream_reader(io.BytesIO(content[8 + size :]), read_across_frames=True) as stream:
        lines = io.BufferedReader(stream, 1 << 16)
        while version := lines.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {version[:20]!r}")
            fields: dict[str, str] = {}
            while (line := lines.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            block = lines.read(int(fields["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where it should")
            yield fields, block


def write_archives(assigned: DataFrame, *, date: str = "2025-01-01T00:00:00Z", archive_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Rows ``archive, content``, one per archive of at most ``archive_bytes`` and one record more."""
    runtime.ship(assigned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, writer = TaskContext.get().partitionId(), 0, None

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:04d}.warc.zst"]), pa.array([writer.finish()], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, refers_to, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(2)):
                if writer is None:
                    writer = ArchiveWriter(level)
                    about = f"software: marginalia\r\nformat: WARC File Format 1.1\r\npart: {part}-{number}\r\n".encode()
                    writer.add(_record("warcinfo", {"WARC-Record-ID": _urn(part, f"warcinfo-{number}"), "WARC-Date": date, "Content-Type": "application/warc-fields"}, about))
                writer.add(page_record(page_id, url, payload.as_py(), refers_to, date))
                if writer.size >= archive_bytes:
                    yield emit()
                    writer, number = None, number + 1
        if writer is not None:
            yield emit()

    return assigned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, *, keep_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page record."""
    runtime.ship(archives.sparkSession)
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", url string, payload binary" * keep_payload
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def parsed(content: bytes) -> Iterator[tuple]:
        for fields, block in read_records(content):
            if fields["WARC-Type"] == "warcinfo":
                continue
            head, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"payload of page {fields.get('X-Page-ID')} does not match its digest")
            ids = [int(x) if (x := fields.get(name)) is not None else None for name in ("X-Page-ID", "X-Refers-To-Page-ID")]
            yield (ids[0], size, digest, fields["WARC-Type"], ids[1], fields["WARC-Target-URI"], payload if fields["WARC-Type"] == "response" else None)[: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parsed(content.as_py()))
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return archives.select("content").mapInArrow(run, schema)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file below ``folder`` (any Arrow filesystem URI); returns names and sizes."""
    runtime.ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                store.create_dir(root, recursive=True)
                partial = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(partial) as out:
                    out.write(data)
                store.move(partial, f"{root}/{name}")  # a retried task replaces, never doubles
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes bigint")


def archive_round_trip(pages: DataFrame, *, least_bytes: int = 0, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages to archives in the shared folder, then read those back."""
    archives = runtime.materialize(write_archives(assign(pages, least_bytes=least_bytes), archive_bytes=archive_bytes), "warc")
    return read_archives(archives)
