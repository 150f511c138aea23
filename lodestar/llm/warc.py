"""WARC archives, and the normaliser of monolithic gzip ones.

write() puts the pages of each partition into one archive that is a single gzip stream, as some tools
leave them: no record can be read without inflating all before it. normalise() inflates each such stream once,
rewrites every record as a gzip member of its own, and writes a sidecar index of each record's offset and
length. read() takes records from a normalised archive by that index.

Of the pages with equal payloads the one with the smallest page_id is a `response`; the others are `revisit`
records without a body, which name it. A null html is an empty payload. Rows with the same page_id and
payload as the response are responses too. Null page_ids come before all others; ids must be of an integer type. Very
large payloads are held one at a time. Other columns are not written. An empty table has no archives. Every attempt of a task
writes files under a name of its own, and only the names given back by attempts that ended are read, so a lost
executor leaves no half-written file in use.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import long_id, new_path, small, stored
from ._text import tidy

LEVEL, CHUNK = 6, 1 << 18
#: A date for all records: an archive of the same rows has the same bytes.
DATE = "2024-01-01T00:00:00Z"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's URI or of a local path; object stores by their Hadoop names too."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3', 'gcs': 'gs', 'wasbs': 'abfss'}.get(scheme, scheme) }://{rest}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page with that id."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",  # line ends in a url must not end the header
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class RecordStream:
    """Cuts an inflated stream, fed in any pieces, into records."""

    def __init__(self) -> None:
        self._held = bytearray()
        self._need: int | None = None

    def feed(self, data: bytes) -> Iterator[bytes]:
        self._held += data
        while True:
            if self._need is None:
                end = self._held.find(b"\r\n\r\n")
                if end < 0:
                    return
                self._need = end + 4 + int(fields(bytes(self._held[:end]))["content-length"]) + 4
            if len(self._held) < self._need:
                return
            out = bytes(self._held[: self._need])
            del self._held[: self._need]
            self._need = None
            yield out

    def close(self) -> None:
        if self._held:
            raise ValueError(f"the archive ends within a record, after {len(self._held)} bytes of it")


def fields(head: bytes) -> dict[str, str]:
    """The fields of a record's header by lower-case name."""
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def parsed(raw: bytes) -> dict[str, Any]:
    """What a record says: page_id, url, type, digest, length, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    f = fields(head)
    page = lambda name: int(f[name][len("<urn:page:") : -1]) if f.get(name, "<urn:page:>") != "<urn:page:>" else None
    return {"page_id": page("warc-record-id"), "url": json.loads(f'"{f["warc-target-uri"]}"'), "type": f["warc-type"], "digest": f["warc-payload-digest"].removeprefix("sha1:"), "length": int(f["x-payload-length"]), "refers_to": page("warc-refers-to"), "payload": rest[: int(f["content-length"])]}


def inflated(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """What a gzip stream of any number of members holds, read once from its start."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            yield inflate.decompress(data)
            data = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            else:
                break


def member(raw: bytes) -> bytes:
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and refers_to (null for a response) of each page."""
    page_id = long_id(pages, "page_id")
    rows = pages.select(page_id, F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    hashed = pages.select(page_id, F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("hash"))
    low = F.min(F.struct("page_id")).alias("low")
    firsts = stored(hashed.groupBy("hash").agg(low, F.count("*").alias("n")).where("n > 1").select("hash", F.col("low.page_id").alias("first")), "firsts")
    joined = rows.withColumn("hash", F.sha2("payload", 256)).join(F.broadcast(firsts) if small(firsts, 120) else firsts, "hash", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes typed() pages as one monolithic archive a partition; path and records of each, as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        final = f"{base}/part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        deflate, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        with files.open_output_stream(final, compression=None) as out:
            for batch in batches:
                for lo in range(0, batch.num_rows, 64):
                    for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)):
                        out.write(deflate.compress(record(page_id, url, payload, refers_to)))
                        count += 1
            out.write(deflate.flush())
        if count:
            yield pa.RecordBatch.from_pydict({"path": [final], "records": [count]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))
        else:
            files.delete_file(final)

    return stored(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(tidy(run), "path string, records long"), "archives")


INDEX = "path string, offset long, length long, page_id long, type string, digest string"
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("type", pa.string()), ("digest", pa.string())])


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive of the column path with a member a record; the rows of the sidecar indexes."""

    def one(source: str) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        name = source.rsplit("/", 1)[-1].removesuffix(".warc.gz")
        name = f"{name}-{uuid.uuid4().hex[:8]}"
        finals = (f"{base}/{name}.warc.gz", f"{base}/{name}.index.jsonl")
        origin, at = opened(source)
        offset, stream, rows = 0, RecordStream(), []
        with origin.open_input_stream(at, compression=None) as raw, files.open_output_stream(finals[0], compression=None) as out, files.open_output_stream(finals[1]) as index:
            for data in inflated(raw):
                for text in stream.feed(data):
                    packed = member(text)
                    f = parsed(text)
                    row = {"path": finals[0], "offset": offset, "length": len(packed), "page_id": f["page_id"], "type": f["type"], "digest": f["digest"]}
                    out.write(packed)
                    index.write((json.dumps(row) + "\n").encode())
                    offset += len(packed)
                    rows.append(row)
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, _INDEX)
                        rows = []
            stream.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield from one(source)

    count = max(1, archives.count())
    return stored(archives.select("path").repartition(count, "path").mapInArrow(tidy(run), INDEX), "index")


def read(index: DataFrame) -> DataFrame:
    """The records at these places of normalised archives: page_id, url, payload, payload_bytes, payload_digest,
    record_type and refers_to. A response's length and digest are taken anew from what it holds."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for where, offset, length in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    if where != path:
                        if source is not None:
                            source.close()
                        files, at = opened(where)
                        path, source = where, files.open_input_file(at)
                    f = parsed(zlib.decompress(source.read_at(length, offset), 31))
                    held = f["type"] == "response"
                    rows.append({"page_id": f["page_id"], "url": f["url"], "payload": f["payload"], "payload_bytes": len(f["payload"]) if held else f["length"], "payload_digest": digest(f["payload"]) if held else f["digest"], "record_type": f["type"], "refers_to": f["refers_to"]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return index.select("path", "offset", "length").sortWithinPartitions("path", "offset").mapInArrow(tidy(run), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from the archives."""
    spark = pages.sparkSession
    archives = write(typed(pages), new_path(spark, "warc"))
    index = normalise(archives, new_path(spark, "warc-members"))
    return read(index).drop("payload", "url")
