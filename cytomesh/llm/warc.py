"""WARC archives whose records are Zstandard frames that share a dictionary.

Every archive file starts with a skippable frame that holds the dictionary, built from records of that file; each record
is one frame of its own after it, so any record can be read alone. Tasks write files of bounded size to a folder that all
executors reach and report them as rows; only the reports of finished tasks are kept, so files of lost or repeated tasks
are never read.

A payload that was archived before, with at least ``REVISIT_BYTES`` bytes, becomes a revisit record that refers to the
page with the smallest id among those with the same bytes.

Defined results: a null payload is empty. Rows that repeat the smallest id of a payload are responses too. A null id
never is the one referred to while another exists. Empty tables give no files and an empty result. Extra columns are not
archived. ``url`` may be missing or null; line breaks in it are percent-encoded.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomesh.llm.common import scratch_path, table, written

#: Fixed by the archive format: magic number of the leading skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed by the task: payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: A file is closed after so many bytes of records before compression.
FILE_BYTES = 32 << 20
#: A file's dictionary is built from its first records, up to so many bytes, and has at most DICTIONARY_BYTES.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3

MANIFEST = "path string, records bigint, bytes bigint"
READ_BACK = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">") if uri else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC headers, HTTP headers, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record, headers of the HTTP message and the payload that is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; where there are too few to train on, their own bytes."""
    try:
        if len(records) >= 16:
            return zstandard.train_dictionary(DICTIONARY_BYTES, records, level=LEVEL)
    except zstandard.ZstdError:
        pass
    return zstandard.ZstdCompressionDict(b"".join(records)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one file; the first records wait until the dictionary is built from them."""

    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.stream = f"{folder}/{name}", self.fs.open_output_stream(f"{base}/{name}", compression=None)
        self.waiting: list[bytes] = []
        self.compressor: zstandard.ZstdCompressor | None = None
        self.records = self.bytes = self.raw = 0

    def add(self, raw: bytes) -> None:
        self.raw += len(raw)
        self.records += 1
        if self.compressor is None:
            self.waiting.append(raw)
            if self.raw >= SAMPLE_BYTES:
                self._start()
        else:
            self._put(self.compressor.compress(raw))

    def _put(self, frame: bytes) -> None:
        self.stream.write(frame)
        self.bytes += len(frame)

    def _start(self) -> None:
        # a dictionary learns from parts of very long records as well as from whole ones
        dictionary = build_dictionary([r[: SAMPLE_BYTES // 8] for r in self.waiting])
        raw = dictionary.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
        for r in self.waiting:
            self._put(self.compressor.compress(r))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.compressor is None:
            self._start()
        self.stream.close()
        return self.path, self.records, self.bytes


def read_records(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of a file in order, with no more in memory than a record and a chunk."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        magic, size = struct.unpack("<II", stream.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri} does not start with a dictionary")
        raw = stream.read(size)
        trained = raw[:4] == b"\x37\xa4\x30\xec"
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
        frame, parts, rest = decompressor.decompressobj(), [], b""
        while data := rest or stream.read(chunk):
            parts.append(frame.decompress(data))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                yield b"".join(parts)
                frame, parts = decompressor.decompressobj(), []
        if any(parts):
            raise ValueError(f"{uri} ends inside a record")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and for revisits the page they refer to."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy(F.col("digest").alias("_d"))
    # only payloads that several rows share are looked up; their rows, not the others, may be many for one digest
    first = first.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_d", "first")
    looked = rows.join(first, F.col("digest") == F.col("_d"), "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull())
    return looked.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archive all pages below ``folder``; the written files as a table (path, records, bytes)."""

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, writer = uuid.uuid4().hex, 0, None

        def report(w: ArchiveWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in w.close()], ["path", "records", "bytes"])

        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                if writer is None:
                    writer, n = ArchiveWriter(folder, f"part-{task}-{n:05d}.warc.zst"), n + 1
                writer.add(record(*(x.as_py() for x in r)))
                if writer.raw >= FILE_BYTES:
                    yield report(writer)
                    writer = None
        if writer is not None:
            yield report(writer)

    return written(plan_records(pages).mapInArrow(archived, MANIFEST))


def read_archives(manifest: DataFrame) -> DataFrame:
    """What the archives hold, record by record; every payload that is there is held against its digest."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_BACK.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def block(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for raw in read_records(path):
                    warc, http, payload = parse(raw)
                    digest = warc["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind, size = warc["WARC-Type"], int(http["Content-Length"])
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"payload of {warc['WARC-Record-ID']} does not match its digest")
                    rows.append((_page(warc["WARC-Record-ID"]), size, digest, kind, _page(warc.get("WARC-Refers-To")), warc["WARC-Target-URI"] or None))
                    if len(rows) >= 10_000:
                        yield block(rows)
                        rows = []
        if rows:
            yield block(rows)

    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(opened, READ_BACK)


WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(manifest).drop("url")
