"""WARC archives with a Zstandard dictionary of their own.

Each task writes one archive: it collects its first records, builds a dictionary from them, writes the dictionary in a
leading skippable frame (magic 0x184D2A5D, length, dictionary) and then every record as a frame of its own. Readers
need nothing but the file. Payloads seen before are written as revisit records that refer to the first page.

Archives go to a folder all executors see. A task writes under a name of its attempt and reports it; only reported
names count, so a lost executor's half-written file is never read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash

#: Magic of a skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 * 1024
#: A dictionary is built from an archive's first records, up to this many bytes and records.
SAMPLE_BYTES, SAMPLE_RECORDS = 4 << 20, 1000
LEVEL = 3
#: Bytes read at a time.
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose capture time is not known.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (pafs.LocalFileSystem(), folder)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b > 126 else chr(b) for b in (url or "").encode("utf-8", "surrogatepass"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the response's header lines alone.

    ``place`` (archive and number) makes its ID unique. A revisit names the first page by its URL and date, which need
    no look into another archive, and by its page_id.
    """
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    refers = [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {UNKNOWN_DATE}"]
    if refers_url is not None:
        refers.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {UNKNOWN_DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url is not None else []),
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *(refers if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Header fields of one record, with its payload (empty for revisits) and the full payload's length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    out: dict = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(out["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if out["WARC-Type"] == "response":
        if len(payload) != full or f"sha1:{digest_of(payload)}" != out["WARC-Payload-Digest"]:
            raise ValueError("a payload differs from its digest")
    return out | {"payload": payload, "payload_bytes": full}


class Writer:
    """Writes one archive to an open binary stream."""

    def __init__(self, stream) -> None:
        self.stream, self.held, self.size, self.compressor = stream, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor is None:
            self.held.append(data)
            self.size += len(data)
            if self.size >= SAMPLE_BYTES or len(self.held) >= SAMPLE_RECORDS:
                self._start()
        else:
            self.stream.write(self.compressor.compress(data))

    def _start(self) -> None:
        content = b""
        try:
            content = zstandard.train_dictionary(DICTIONARY_BYTES, self.held, k=256, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            content = b"".join(self.held)[-DICTIONARY_BYTES:]  # too few records to train on: they are the dictionary
        self.stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True, write_checksum=True)
        held, self.held = self.held, []
        for data in held:
            self.stream.write(self.compressor.compress(data))

    def close(self) -> None:
        if self.compressor is None:
            self._start()


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, one decompressed frame each, read in chunks."""
    magic, size = struct.unpack("<II", _exactly(stream, 8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no leading dictionary frame")
    content = _exactly(stream, size)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    rest = b""
    while True:
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                rest = stream.read(CHUNK)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("the archive is cut short")
    return data


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): refers_to is the smallest page_id with the same payload, null for that page itself.

    Payloads are told apart by SHA-1 and length. Only digests are grouped; the pages move once, to meet their result.
    A null page_id never is a first page; of pages that repeat the smallest page_id one is enough, so each is a response.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    keyed = pages.select("page_id", "url", F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size"))
    keyed = keyed.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
    shared = keyed.groupBy("sha", "size").agg(F.min(F.struct("page_id", "url")).alias("f"), F.count("*").alias("n")).where("n > 1")
    shared = stash(shared.select("sha", "size", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")), "warc-firsts")
    marked = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("size"))
    joined = marked.join(shared, ["sha", "size"], "left")
    other = ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of ``pages`` to archives in ``folder``; returns their manifest (path, n_records).

    Null html is an empty payload, null url and page_id leave their fields out. Repeated rows give a record each, with
    IDs of their own. A record is held in memory once, so a page may be as long as a task's memory allows. Other columns
    are ignored. An empty table gives no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = writer = None
        n = 0
        try:
            for batch in small_batches(batches, 256):
                for page_id, url, page, refers_to, refers_url in zip(*batch.columns, strict=True):
                    if writer is None:
                        store, root = _filesystem(folder)
                        store.create_dir(root, recursive=True)
                        task = TaskContext.get()
                        name = posixpath.join(root, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst")
                        stream = store.open_output_stream(name, compression=None)
                        writer = Writer(stream)
                    payload = (page.as_py() or "").encode("utf-8", "surrogatepass")
                    writer.add(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), f"{name}#{n}", refers_url.as_py()))
                    n += 1
            if writer is not None:
                writer.close()
        finally:
            if stream is not None:
                stream.close()
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([n], pa.int64())], ["path", "n_records"])

    planned = plan(pages, least_bytes).select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.col("refers_to").cast("long"), F.col("refers_url").cast("string"))
    return stash(planned.mapInArrow(run, "path string, n_records long"), "warc-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html): every record of the archives.

    html is null in revisits. Digests of responses are checked against their payloads. Records come back one for one,
    repeated and null ones too; an empty manifest gives no row. Damaged or lost records raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]
        )

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, count in zip(batch.column(0), batch.column(1), strict=True):
                rows, n = [], 0
                with store.open_input_stream(path.as_py(), compression=None) as stream:
                    for data in read_records(stream):
                        r = parse(data)
                        first = r["WARC-Type"] == "response"
                        rows.append(
                            (
                                int(r["X-Page-ID"]) if "X-Page-ID" in r else None,
                                r.get("WARC-Target-URI"),
                                r["payload_bytes"],
                                r["WARC-Payload-Digest"].removeprefix("sha1:"),
                                r["WARC-Type"],
                                None if first else int(r["X-Refers-To-Page-ID"]),
                                r["payload"].decode("utf-8", "surrogatepass") if first else None,
                            )
                        )
                        n += 1
                        if len(rows) == 256:
                            yield batch_of(rows)
                            rows = []
                if n != count.as_py():
                    raise ValueError(f"{path} holds {n} records, its manifest says {count}")
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    spread = manifest.repartitionByRange(min(files, 10_000), "path")  # by hash, several archives would fall into one task
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
