"""WARC archives from and to a chunked record table.

A payload is never one value on the way: it is rows of (record, chunk number, bytes), which a task writes to its archive
as they come. Reading streams an archive through a fixed buffer and gives the chunks of each record with the digest and
length so far, so the last chunk carries those of the whole payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import as_bytes
from frameloom.operators.spread import settle
from frameloom.session import fresh_folder

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30  # a task begins a new archive after so many bytes of payload
REVISIT_FROM = 100  # payloads of so many bytes may be replaced by a reference

# Fixed by the format: version line, line ends, and the profile of a revisit by identical payload.
VERSION, EOL = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time


def with_references(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """``pages(page_id, url, payload)`` -> the same with ``digest, size, refers_to``.

    ``refers_to`` is the smallest page_id among equal payloads of at least ``least`` bytes, NULL for that page itself.
    Rows that share that page_id and the payload are all stored; a NULL page_id comes last. Only digests that occur
    more than once are joined back: a combined minimum, then a join the engine plans by the measured size.
    """
    digested = pages.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    repeated = settle(
        digested.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1"), "repeated"
    ).select(F.col("digest").alias("_digest"), "first_id")
    refers = F.when((F.col("first_id").isNotNull()) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))), F.col("first_id"))
    joined = digested.join(repeated, (F.col("digest") == F.col("_digest")) & (F.col("size") >= least), "left")
    return joined.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of a stored payload, in order; a payload that is empty or only referred to is one empty chunk."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / chunk_bytes)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * chunk_bytes + 1, F.lit(chunk_bytes)))
    return records.select("page_id", "url", "digest", "size", "refers_to", F.posexplode(parts).alias("chunk_no", "chunk"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """The record's header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (size if refers_to is None else 0))),
    ]
    if url:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    return VERSION + EOL + b"".join(f"{k}: {v}".encode() + EOL for k, v in fields) + EOL + http


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write chunk rows to gzipped archives, one gzip member per record; returns ``(path, records, bytes)`` per archive.

    A task writes archives of its own under new names and reports them only when they are complete. Archives of a lost
    or repeated attempt are never reported, and so never read. ``folder`` has to be reachable from all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = pafs.FileSystem.from_uri(folder)
        out = path = packer = None
        records = written = 0

        def close() -> pa.RecordBatch:
            out.write(packer.compress(EOL + EOL) + packer.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [written]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk_no"] == 0:
                    if out is not None and written >= archive_bytes:
                        yield close()
                        out, records, written = None, 0, 0
                    if out is None:
                        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out = place.open_output_stream(path, compression=None)
                    else:
                        out.write(packer.compress(EOL + EOL) + packer.flush())
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    records += 1
                    out.write(packer.compress(_head(row["page_id"], row["url"], row["digest"], row["size"], row["refers_to"])))
                out.write(packer.compress(row["chunk"]))
                written += len(row["chunk"])
        if out is not None:
            yield close()

    return chunks.mapInArrow(run, "path string, records long, bytes long")


class _Stream:
    """Inflated bytes of an archive by line or by count, through a fixed buffer; members follow each other."""

    def __init__(self, file, buffer: int):
        self.file, self.buffer, self.held, self.packed, self.inflater = file, buffer, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflater.eof:
            self.packed, self.inflater = self.inflater.unused_data, zlib.decompressobj(31)
        source = self.inflater.unconsumed_tail or self.packed or self.file.read(self.buffer)
        self.packed = b""
        if not source:
            return False
        self.held += self.inflater.decompress(source, self.buffer)
        return True

    def line(self) -> bytes | None:
        while (at := self.held.find(EOL)) < 0:
            if not self._more():
                return None
        found, self.held = self.held[:at], self.held[at + 2 :]
        return found

    def take(self, most: int) -> bytes:
        while not self.held:
            if not self._more():
                raise EOFError("archive ends inside a record")
        found, self.held = self.held[:most], self.held[most:]
        return found


def _fields(stream: _Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        key, _, value = line.decode().partition(":")
        out[key.strip().lower()] = value.strip()
    return out


CHUNKS = (
    "page_id bigint, record_type string, refers_to bigint, named_digest string, named_bytes bigint, chunk_no int, "
    "chunk binary, bytes_so_far bigint, digest_so_far string, last boolean"
)


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _records(stream: _Stream, chunk_bytes: int, with_chunks: bool) -> Iterator[tuple]:
    while (line := stream.line()) is not None:
        if not line:
            continue
        if line != VERSION:
            raise ValueError(f"no record at {line[:40]!r}")
        head = _fields(stream)
        left = int(head["content-length"])
        before = stream.line()  # the block's status line
        left -= len(before) + 2
        http = {}
        while line := stream.line():
            left -= len(line) + 2
            key, _, value = line.decode().partition(":")
            http[key.lower()] = value.strip()
        left -= 2
        sha, count, number = hashlib.sha256(), 0, 0
        whole = head["warc-type"], _page(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
        while True:
            parts, size = [], 0
            while left and size < chunk_bytes:
                part = stream.take(min(left, chunk_bytes - size))
                sha.update(part)
                left, size = left - len(part), size + len(part)
                if with_chunks:
                    parts.append(part)
            count += size
            yield (_page(head["warc-record-id"]), *whole, number, b"".join(parts), count, sha.hexdigest(), not left)
            if not left:
                break
            number += 1


def read_archives(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True) -> DataFrame:
    """``archives(path)`` -> chunk rows with the digest and length up to and including each chunk.

    One archive is one row of input and is read by one task; memory holds a chunk, not a record.
    """
    names = [part.strip().split(" ")[0] for part in CHUNKS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            (n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[t])
            for n, t in (part.strip().split(" ") for part in CHUNKS.split(","))
        ])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                place, inner = pafs.FileSystem.from_uri(path)
                held, size = [], 0
                with place.open_input_stream(inner, compression=None) as file:
                    for row in _records(_Stream(file, chunk_bytes), chunk_bytes, with_chunks):
                        held.append(row)
                        size += len(row[6]) + 200
                        if size >= 4 * chunk_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], names=names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], names=names)

    return archives.select("path").mapInArrow(run, CHUNKS)


def archive_pages(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write one record per row and return the table of archives written (``path, records, bytes``).

    A NULL payload is empty, a NULL url is left out of its record, a NULL page_id is named ``null`` and read as NULL.
    Rows that repeat a page_id have a record each. An empty table writes no archive.
    """
    folder = fresh_folder(spark, "warc")
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made)
    narrow = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), as_bytes(html).alias("payload"))
    written = write_archives(chunked(with_references(narrow), chunk_bytes), folder)
    return settle(written.withColumn("path", _uri(folder, F.col("path"))), "archives")


def _uri(folder: str, path: Column) -> Column:
    """The path within a file system, with the scheme and host that the folder was named by."""
    found = re.match(r"[a-z0-9+.-]+://[^/]*", folder)
    return F.concat(F.lit(found[0]), path) if found and not folder.startswith("s3") else F.concat(F.lit(f"{folder}/"), F.element_at(F.split(path, "/"), -1))


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk. A stored payload has the digest and length read; a reference has those it names.

    A stored payload that disagrees with its header fails the job: the archive is damaged.
    """
    stored = F.col("record_type") == "response"
    wrong = stored & ((F.col("digest_so_far") != F.col("named_digest")) | (F.col("bytes_so_far") != F.col("named_bytes")))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))).cast("string")).otherwise(F.col("digest_so_far"))
    return chunks.where("last").select(
        "page_id", F.when(stored, F.col("bytes_so_far")).otherwise(F.col("named_bytes")).alias("payload_bytes"),
        F.when(stored, checked).otherwise(F.col("named_digest")).alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks"),
    )
