"""WARC archives with one Zstandard frame per record and a dictionary of their own.

Each task writes its partition to archives: a dictionary is trained on the first records (a bounded
number of bytes, long records in pieces), embedded in a leading skippable frame, and every record becomes a
frame that can be read alone.  Only an archive of too few bytes to train on, some kilobytes, has none.  A file gets its name only when it is whole, and the manifest, written from the tasks that
succeeded, says which files count; what a lost task left is not in it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import scratch

#: Fixed values of the formats: magic numbers, and the profile of a revisit with an equal payload.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Bytes of records that wait for a dictionary, its size, the pieces that records are cut into for training, and the size at which a new archive begins.
SAMPLE_BYTES, DICTIONARY_BYTES, PIECES, PIECE_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 64, (256, 16 << 10), 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, records long, bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none:' + uuid.uuid4().hex if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    tail = (record_id or "").strip("<>").removeprefix("urn:x-page:")
    return None if not tail or tail.startswith("none:") else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}",
        # a URL may not carry line breaks or blanks into the header
        *([f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Archive:
    """An archive being written; records wait until there are enough to train the dictionary on."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = _filesystem(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.waiting: list[bytes] = []
        self.held = self.records = self.bytes = self.dictionary_bytes = 0
        self.compress = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compress is not None:
            self._write(self.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        import zstandard

        # long records count as many pieces, so that a few of them train as well as many short ones
        n = min(max(self.held // PIECES, PIECE_BYTES[0]), PIECE_BYTES[1])
        left, pieces = SAMPLE_BYTES, []
        for data in self.waiting:
            pieces += [data[at : at + n] for at in range(0, min(len(data), left), n)]
            left = max(0, left - len(data))
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, self.held // 16)), pieces)
        except zstandard.ZstdError:  # too little, or too even, to learn from
            trained = None
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        if trained is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            self.dictionary_bytes = len(trained.as_bytes())
            self._write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True).compress
        for data in self.waiting:
            self._write(self.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int, int]:
        if self.compress is None:
            self._begin()
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri, self.records, self.bytes, self.dictionary_bytes


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, digest, refers_to, revisit = (b.column(c)[i] for c in range(6))
                if archive is None:
                    archive = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                archive.add(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py(), revisit.as_py()))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        cols = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["path", "records", "bytes", "dictionary_bytes"])

    return run


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit): equal payloads of some length refer to the one of smallest id.

    Pages do not move: digests that occur more than once, as two numbers and the first id, are looked up,
    and only where they are too many to be broadcast are pages and digests merged.
    """
    def half(k: int):
        return F.conv(F.substring("digest", 1 + 16 * k, 15), 16, 10).cast("long")  # 120 of the 256 bits in all

    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"), F.sha2(html, 256).alias("digest"))
    large = F.octet_length(html) >= REVISIT_BYTES
    first = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    first = scratch.lookup(scratch.write(first.select(half(0).alias("_d0"), half(1).alias("_d1"), "first"), "repeated-payloads"))
    revisit = F.col("first").isNotNull() & large & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.withColumn("_h0", half(0)).withColumn("_h1", half(1)).join(first, (F.col("_h0") == F.col("_d0")) & (F.col("_h1") == F.col("_d1")), "left")
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) rows as archives under ``folder`` and returns the manifest, also kept there.

    Null html is an empty payload, a null URL leaves its header out, a null id gets a random record id
    and reads back as null.  Rows that repeat the smallest id of a payload are responses each.  An empty
    table writes no archive.  Other columns are not read.
    """
    spark = pages.sparkSession
    with_revisits(pages).mapInArrow(_writer(folder, archive_bytes), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, with or without a dictionary, read as a stream."""
    import zstandard

    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        head = f.read(8)
        trained = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
            data = f.read(struct.unpack("<I", head[4:])[0])
            if data.startswith(FRAME):
                data = zstandard.ZstdDecompressor().decompress(data)
            trained = zstandard.ZstdCompressionDict(data)
        else:
            f.seek(0)
        with zstandard.ZstdDecompressor(dict_data=trained).stream_reader(f, read_size=1 << 20, read_across_frames=True) as z:
            buffer = b""

            def need(n: int) -> bool:
                nonlocal buffer
                parts, have = [buffer], len(buffer)
                while have < n:
                    more = z.read(1 << 20)
                    if not more:
                        break
                    parts.append(more)
                    have += len(more)
                buffer = b"".join(parts)
                return have >= n

            while need(1):
                while (end := buffer.find(b"\r\n\r\n")) < 0:
                    if not need(len(buffer) + 1):
                        raise ValueError(f"{uri} ends inside a record's header")
                lines = buffer[:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{uri}: no record where one should begin")
                header = dict(line.split(": ", 1) for line in lines[1:])
                size = int(header["Content-Length"])
                if not need(end + 4 + size + 4):
                    raise ValueError(f"{uri} ends inside a record")
                yield header, buffer[end + 4 : end + 4 + size]
                buffer = buffer[end + 8 + size :]


def _reader(payloads: bool):
    def row(header: dict[str, str], block: bytes):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, kind = header["WARC-Payload-Digest"].removeprefix("sha256:"), header["WARC-Type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"{header['WARC-Record-ID']}: the payload is not what its digest says")
        return (_page_id(header["WARC-Record-ID"]), header.get("WARC-Target-URI"), payload if payloads and kind == "response" else None, size, digest, kind,
                _page_id(header.get("WARC-Refers-To")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for header, block in read_records(path):
                    rows.append(row(header, block))
                    held += len(block)
                    if held >= 8 << 20 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives; a response whose payload does not match its digest fails the query."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n).mapInArrow(_reader(payloads), RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.new_path(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
"""
