"""WARC files as a table of chunks: a record is rows of its identifier and a chunk number, none longer than `chunk` bytes.

Reader and writer go through a record piece by piece and carry its digest along: each row has the digest of the record up to and
with its chunk, the last row tells whether it is the one that the record states. No record is held whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import qualified
from .shared import folder, frugal

CHUNK, DATE = 16 << 10, "1970-01-01T00:00:00Z"
#: Bytes of a line of a head at most.
LINE = 64 << 10
#: Bytes of chunks that one Arrow batch holds at most.
HELD = 8 << 20
CHUNKS = "record_id string, kind string, url string, chunk_no int, begin long, n_bytes int, chunk binary, digest string, is_last boolean, is_valid boolean"
_ARROW = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("chunk_no", pa.int32()), ("begin", pa.int64()), ("n_bytes", pa.int32()), ("chunk", pa.binary()), ("digest", pa.string()), ("is_last", pa.bool_()), ("is_valid", pa.bool_())])


def header(record_id: str, url: str | None, size: int, digest: str) -> bytes:
    """The head of a resource record. Line breaks in a URL are percent-encoded."""
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Block-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _write(path: str, compress: bool, chunk: int):
    def put(out: BinaryIO, record_id: str, url: str | None, block: memoryview) -> None:
        total = hashlib.sha256()
        for a in range(0, len(block), chunk):
            total.update(block[a : a + chunk])
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31) if compress else None
        send = (lambda raw: out.write(deflate.compress(raw))) if deflate else out.write
        send(header(record_id, url, len(block), total.hexdigest()))
        for a in range(0, len(block), chunk):
            send(block[a : a + chunk])
        send(b"\r\n\r\n")
        if deflate:
            out.write(deflate.flush())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = located(path)
        name = f"{base}/part-{task.partitionId():06d}.warc" + ".gz" * compress
        draft = f"{base}/.{task.taskAttemptId()}-{uuid.uuid4().hex}"
        n = 0
        with files.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                for page, url, html in zip(*batch.columns):
                    put(out, f"urn:page:{page.as_py()}", url.as_py(), memoryview(html.as_buffer() if html.is_valid else b""))
                    n += 1
        if n:
            files.move(draft, name)  # an attempt that is repeated puts the same file in its place
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name.rpartition('/')[2]}"]), pa.array([n])], ["path", "n"])
        else:
            files.delete_file(draft)

    return run


def write(pages: DataFrame, path: str, compress: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(path, n) of the files written into the folder `path`, which all executors must reach, one for each partition of the pages that has a record.

    A page becomes a resource record urn:page:PAGE_ID. A null html has no record, an empty one an empty block; a null url gives a record
    without target, a null page_id urn:page:None. Repeated rows give repeated records. Other columns are not read.
    """
    path = qualified(pages.sparkSession, path)
    files, base = located(path)
    files.create_dir(base, recursive=True)
    frugal(pages.sparkSession)
    rows = pages.where("html is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode("html", "utf-8").alias("html"))
    spark = pages.sparkSession
    done = rows.mapInArrow(_write(path, compress, chunk), "path string, n long").collect()
    return spark.createDataFrame(done, "path string, n long")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as Spark and Hadoop write them, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} names no file system; qualify it, as tables.qualified() does")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    return fs.FileSystem.from_uri(f"{scheme}:{rest}" if rest.startswith("//") else f"{scheme}://{rest}")


def agrees(stated: str, total: Any) -> bool:
    """Whether a digest as a record states it, in hexadecimal or base32, is that of `total`."""
    stated = stated.rstrip("=")
    if len(stated) == 2 * total.digest_size:
        return stated.lower() == total.hexdigest()
    return stated.upper() == base64.b32encode(total.digest()).decode().rstrip("=")


def chunks(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of CHUNKS of a WARC stream; an empty block is one empty chunk.

    A record that breaks off ends with an invalid last row. One whose head has a line of more than LINE bytes or no length that can be
    read is one empty, invalid row, and what follows is skipped up to the next line that begins a record. A digest of an unknown
    algorithm is not checked, digests without one are read as sha256. A stream that doesn't begin with a record is a ValueError.
    """
    begun = False
    while line := stream.readline(LINE):
        if not line.startswith(b"WARC/"):
            if not line.strip() or begun:
                continue
            raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        begun = True
        fields: dict[str, str] = {}
        broken = False
        while (line := stream.readline(LINE)) and line.strip():
            broken |= not line.endswith(b"\n")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        head = fields.get("warc-record-id", "").strip("<>"), fields.get("warc-type"), fields.get("warc-target-uri")
        algorithm, colon, stated = fields.get("warc-block-digest", "").rpartition(":")
        algorithm = algorithm.lower().replace("-", "") or "sha256"
        known = algorithm in hashlib.algorithms_available and hashlib.new(algorithm).digest_size > 0
        total = hashlib.new(algorithm) if stated and known else hashlib.sha256()
        if broken or not (size.isascii() and size.isdigit()):
            yield *head, 0, 0, 0, b"", total.hexdigest(), True, False
            continue
        left, at, number = int(size), 0, 0
        while True:
            part = stream.read(min(chunk, left))
            while part is not None and len(part) < min(chunk, left) and (more := stream.read(min(chunk, left) - len(part))):
                part += more
            total.update(part)
            left -= len(part)
            last = not left or not part
            valid = (not left and (not stated or not known or agrees(stated, total))) if last else None
            yield *head, number, at, len(part), part, total.hexdigest(), last, valid
            at, number = at + len(part), number + 1
            if last:
                break


def _read(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, base = located(path)
                with files.open_input_stream(base, compression=None, buffer_size=1 << 20) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if base.endswith(".gz") else raw
                    held, size = [], 0
                    for row in chunks(stream if hasattr(stream, "peek") else _Lines(stream), chunk):
                        held.append(row)
                        size += row[5] + 200
                        if size >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)

    return run


class _Lines:
    """readline() for a stream that has none."""

    def __init__(self, raw):
        self.raw, self.rest = raw, b""

    def read(self, n: int) -> bytes:
        if self.rest:
            out, self.rest = self.rest[:n], self.rest[n:]
            return out
        return self.raw.read(n)

    def readline(self, most: int) -> bytes:
        while b"\n" not in self.rest[:most] and len(self.rest) < most and (more := self.raw.read(4096)):
            self.rest += more
        at = self.rest.find(b"\n", 0, most)
        end = at + 1 if at >= 0 else min(most, len(self.rest))
        out, self.rest = self.rest[:end], self.rest[end:]
        return out


def read(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """The rows of CHUNKS of WARC files (.warc or .warc.gz), a task for each file; broken records as chunks() has them.

    A repeated path gives its records again, no path no row, a file without a record none.
    """
    files = spark.createDataFrame([(qualified(spark, p),) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(_read(chunk), CHUNKS)


def joined(rows: DataFrame) -> DataFrame:
    """(record_id, url, block) of records put together again; for those that fit in memory."""
    block = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), F.lit(b""), lambda a, x: F.concat(a, x["chunk"]))
    return rows.groupBy("record_id", "url").agg(block.alias("block"))


def through(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of pages written as WARC into the shared folder and read again."""
    path = f"{folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(pages.sparkSession, [r["path"] for r in write(pages, path, chunk=chunk).collect()], chunk)
