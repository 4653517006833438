"""WARC archives written and read as a table of payload chunks."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, evaluated, non_empty, saved, scratch_path

ARROW_ROWS = 500
CHUNK_BYTES = 64 * 1024
# A writer starts a new archive after so many compressed bytes; one archive is read by one task.
FILE_BYTES = 32 * 1024 * 1024
READ_BYTES = 256 * 1024
# Archives that one task reads where there are many.
TASK_ARCHIVES = 16
MAX_HEADER = 1024 * 1024
CHUNK_SCHEMA = ("file string, record_id string, record_type string, target_uri string, refers_to string, "
                "chunk_no long, data binary, payload_bytes long, payload_digest string, last boolean")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 0, id_col: str = "page_id",
                url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """The payloads as rows of at most ``chunk_bytes``: id, url, sha1, size, revisit, refers_to, chunk_no, last, data.

    Of payloads that are equal and have ``min_bytes`` or more, that with the
    smallest id is written out, the others name it and carry one empty chunk.
    Copies are found by digest and size, combined in each task first.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    low = (p.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("id").alias("low"), F.count("*").alias("m"))
           .where("m > 1 AND low IS NOT NULL").select("sha1", "size", "low"))
    p = p.join(low, ["sha1", "size"], "left")
    revisit = F.col("low").isNotNull() & ~F.col("id").eqNullSafe(F.col("low"))
    p = p.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("low")))
    chunks = F.when(F.col("revisit"), 1).otherwise(F.greatest(F.ceil(F.col("size") / chunk_bytes), F.lit(1))).cast("int")
    p = p.withColumn("chunks", chunks)
    p = evaluated(p.withColumn("x", F.col("payload")), "x", "body")
    p = p.select("id", "url", "sha1", "size", "revisit", "refers_to", "chunks", "body",
                 F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(
        F.substring("body", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return p.select("id", "url", "sha1", "size", "revisit", "refers_to", "chunk_no",
                    (F.col("chunk_no") == F.col("chunks") - 1).alias("last"), data.alias("data"))


class _Archive:
    """One .warc.gz file; each record is a gzip member of its own, compressed as its chunks arrive."""

    def __init__(self, fs, path: str):
        self.out, self.path = fs.open_output_stream(path, compression=None), path
        self.bytes = self.records = 0

    def begin(self, header: bytes):
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(header)

    def put(self, data: bytes):
        if data:
            self.emit(self.member.compress(data))

    def end(self):
        self.put(b"\r\n\r\n")
        self.emit(self.member.flush())
        self.records += 1

    def emit(self, data: bytes):
        self.bytes += len(data)
        self.out.write(data)


def _record_head(row, date: str) -> bytes:
    """The WARC header and the HTTP header of a page."""
    digest = base32(bytes.fromhex(row.sha1))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.size}\r\n\r\n".encode()
    name = lambda v: f"<urn:page:{'null' if pd.isna(v) else int(v)}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row.revisit else 'response'}", f"WARC-Record-ID: {name(row.id)}",
             f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(row.url or '', safe=''.join(map(chr, range(33, 127))))}",
             f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {row.size}",
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + (0 if row.revisit else row.size)}"]
    if row.revisit:
        lines[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      f"WARC-Refers-To: {name(row.refers_to)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + http


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        archive, done = None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.chunk_no == 0:
                    if archive is None:
                        # the attempt is part of the name: what a lost attempt left is not listed
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                        archive = _Archive(fs, f"{base}/{name}")
                        done.append((f"{folder}/{name}", archive))
                    archive.begin(_record_head(row, date))
                archive.put(row.data)
                if row.last:
                    archive.end()
                    if archive.bytes >= file_bytes:
                        archive.out.close()
                        archive = None
        if archive is not None:
            archive.out.close()
        yield pd.DataFrame({"file": [f for f, _ in done], "records": [a.records for _, a in done],
                            "bytes": [a.bytes for _, a in done]})
    return non_empty(run)


def write_warc(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z",
               chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES, min_bytes: int = 0,
               id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a WARC record for each row of ``pages`` and return the list of archives: file, records, bytes.

    ``folder`` must be one that all executors share (by default a new one
    below the checkpoint folder).  Payloads (UTF-8; null is empty) stream
    through the writers chunk by chunk.  Rows that repeat the smallest id
    and its payload are all written as responses; a null id is written as
    ``null`` and is never the smallest; copies that have null ids only are
    all responses.  Empty table: an empty list.  Other columns are not used.
    """
    spark = pages.sparkSession
    arrow_rows(spark, ARROW_ROWS)
    folder = folder or scratch_path(spark, "warc")
    chunks = chunk_table(pages, chunk_bytes, min_bytes, id_col, url_col, payload_col)
    return saved(chunks.mapInPandas(_writer(folder, date, file_bytes), "file string, records long, bytes long"),
                 "archives")


class _Members(io.RawIOBase):
    """The bytes of a file of gzip members, one after the other, never held as a whole."""

    def __init__(self, stream):
        self.stream, self.member, self.left, self.rest = stream, None, b"", b""

    def readable(self):
        return True

    def readinto(self, b):
        while True:
            if self.member is None or self.member.eof:
                raw = (self.member.unused_data if self.member else b"") or bytes(self.stream.read(READ_BYTES))
                if not raw:
                    return 0
                self.member, self.left = zlib.decompressobj(31), raw
            elif not self.left:
                self.left = bytes(self.stream.read(READ_BYTES))
                if not self.left:
                    raise EOFError("archive ends inside a record")
            out = self.member.decompress(self.left, len(b))
            self.left = self.member.unconsumed_tail
            if out:
                b[:len(out)] = out
                return len(out)


def _header(stream: io.BufferedReader) -> tuple[str, dict[str, str]] | None:
    first = stream.readline(MAX_HEADER)
    if not first:
        return None
    fields: dict[str, str] = {}
    while line := stream.readline(MAX_HEADER).rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    return first.decode("ascii").strip(), fields


def _reader(chunk_bytes: int, with_data: bool):
    def records(file: str):
        fs, path = _open(file)
        with fs.open_input_stream(path, compression=None) as raw:
            stream = io.BufferedReader(_Members(raw), READ_BYTES)
            while (head := _header(stream)) is not None:
                version, f = head
                if not version.startswith("WARC/"):
                    raise ValueError(f"{file}: no WARC record where one is due")
                left = int(f["content-length"])
                if f.get("content-type", "").startswith("application/http"):
                    while left and (line := stream.readline(min(left, MAX_HEADER))):
                        left -= len(line)
                        if line == b"\r\n":
                            break
                kind, n, no = f["warc-type"], 0, 0
                sha, told = hashlib.sha1(), f.get("warc-payload-digest", "").removeprefix("sha1:")
                while True:
                    data = stream.read(min(left, chunk_bytes))
                    left -= len(data)
                    n += len(data)
                    sha.update(data)
                    last = left == 0
                    if kind == "revisit":
                        size, digest = int(f["payload-length"]), told
                    else:
                        size, digest = n, base32(sha.digest())
                        if last and told and digest != told:
                            raise ValueError(f"{file}: the payload of {f['warc-record-id']} does not match its digest")
                    if last or with_data:
                        yield (file, f["warc-record-id"], kind, f.get("warc-target-uri"), f.get("warc-refers-to"), no,
                               data if with_data else None, size, digest, last)
                    no += 1
                    if last:
                        break
                    if not data:
                        raise EOFError(f"{file}: {f['warc-record-id']} is cut off")
                stream.read(4)  # CRLF CRLF

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        rows, held = [], 0
        for pdf in batches:
            for file in pdf["file"]:
                for r in records(file):
                    rows.append(r)
                    held += len(r[6] or b"") + 200
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)
    return non_empty(run)


def read_warc(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK_BYTES,
              with_data: bool = True) -> DataFrame:
    """The records of ``archives`` (file) as chunk rows, read as streams, up to ``TASK_ARCHIVES`` a task.

    Columns: file, record_id, record_type, target_uri, refers_to, chunk_no,
    data, payload_bytes and payload_digest (bare base32 SHA-1) up to and with
    this chunk, last.  In a record's last row the two are those of its whole
    payload; a revisit takes them from its header.  Without ``with_data``
    only the last rows come, with null data.  A payload that does not match
    its recorded digest, or a cut-off archive, raises an error.
    """
    n = archives.count()
    # a task for each archive while there are few, then several archives a task
    n = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ARCHIVES))))
    return archives.select("file").repartition(n).mapInPandas(_reader(chunk_bytes, with_data), CHUNK_SCHEMA)
