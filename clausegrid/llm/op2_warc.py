"""WARC archives as a chunked record table.

Pages become chunk rows (record, chunk number, bytes), which tasks stream into gzip-per-record WARC files of bounded size
in the folder all executors share; reading streams the files back into chunk rows. Each chunk row carries the SHA-1 of the
payload up to its end, so the last one has the whole payload's digest and no step holds a whole record. Only archives
named in the writers' committed index are read, so a lost or repeated task leaves nothing that counts.

Of records with equal payloads the one with the largest page id is the response, the others are revisits that refer to it.

Cases: a null html is the empty payload; rows that repeat the largest page id of a payload are all responses; a null
page_id is a response without identifier; a null url has no target header; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import keep, scratch

CHUNK_CHARS, CHUNK_BYTES, ARCHIVE_BYTES = 1 << 18, 1 << 18, 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SAFE = "!#$&'()*+,/:;=?@[]~%-._"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def records(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, sha1, refers_to of every page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("sha1"))
    same = rows.where(F.col("payload_bytes") >= at_least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    same = same.where("n > 1").select("sha1", "last")
    rows = rows.join(same, "sha1", "left")
    refers_to = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    return rows.select("page_id", "url", F.when(refers_to.isNull(), F.col("html")).alias("html"), "payload_bytes", "sha1", refers_to.alias("refers_to"))


def chunk_rows(recs: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per chunk of a record, in order: page_id, url, payload_bytes, sha1, refers_to, chunk, text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("html", F.lit(""))) / F.lit(chars))).cast("int")
    small = F.array(F.struct(F.lit(0).alias("chunk"), F.col("html").alias("text")))
    large = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("chunk"), F.substr("html", k * chars + 1, F.lit(chars)).alias("text")))
    part = F.explode(F.when(n == 1, small).otherwise(large)).alias("part")
    return recs.select("page_id", "url", "payload_bytes", "sha1", "refers_to", part).select(
        "page_id", "url", "payload_bytes", "sha1", "refers_to", F.col("part.chunk").alias("chunk"), F.col("part.text").alias("text"))


def _header(page_id, url, size: int, sha1: str, refers_to) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    else:
        lines.append(f"WARC-Record-ID: <urn:sha1:{_base32(sha1)}>")
    lines.append("WARC-Date: 2024-01-01T00:00:00Z")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{_base32(sha1)}", f"X-Payload-Length: {size}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(_HTTP) + (size if refers_to is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + _HTTP


class _Archive:
    """An open archive; each record is a gzip member of its own."""

    def __init__(self, folder: str):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self.path, self.out, self.bytes, self.records, self.zip = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, None

    def begin(self, header: bytes) -> None:
        self.zip, self.sha, self.records = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), self.records + 1
        self.put(header)

    def put(self, data: bytes, payload: bool = False) -> None:
        if payload:
            self.sha.update(data)
        packed = self.zip.compress(data)
        self.out.write(packed)
        self.bytes += len(packed)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        packed = self.zip.flush()
        self.out.write(packed)
        self.bytes, self.zip = self.bytes + len(packed), None

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, sha1, done = None, None, []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            for page_id, url, size, digest, refers_to, chunk, text in zip(*cols, b.column(6)):
                if chunk == 0:
                    if archive is not None:
                        archive.end()
                        if sha1 is not None and archive.sha.hexdigest() != sha1:
                            raise ValueError(f"chunks do not add up to the payload {sha1}")
                        if archive.bytes >= archive_bytes:
                            done.append(archive.close())
                            archive = None
                    archive = archive or _Archive(folder)
                    archive.begin(_header(page_id, url, size, digest, refers_to))
                    sha1 = digest if refers_to is None else None
                if text.is_valid and refers_to is None:
                    archive.put(text.as_py().encode(), payload=True)
        if archive is not None:
            archive.end()
            if sha1 is not None and archive.sha.hexdigest() != sha1:
                raise ValueError(f"chunks do not add up to the payload {sha1}")
            done.append(archive.close())
        names, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return run


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns their index: archive, records, bytes."""
    return keep(chunks.mapInArrow(_write(folder, archive_bytes), "archive string, records long, bytes long"), "warc-index")


def _parse(path: str, chunk_bytes: int):
    """Chunk rows of one archive, streamed."""
    fs, base = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(base, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record at its place in {path}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                head[name.lower().decode()] = value.decode()
            left = int(head["content-length"])
            while left and (line := f.readline()):  # the HTTP head
                left -= len(line)
                if line == b"\r\n":
                    break
            number = lambda key: int(head[key][10:-1]) if head.get(key, "").startswith("<urn:page:") else None
            uri = head.get("warc-target-uri")
            fixed = (number("warc-record-id"), uri, head["warc-type"], number("warc-refers-to"),
                     head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"]))
            sha, chunk = hashlib.sha1(), 0
            while True:
                data = f.read(min(left, chunk_bytes)) if left else b""
                if left and not data:
                    raise ValueError(f"{path} ends inside a record")
                left -= len(data)
                sha.update(data)
                yield (*fixed, chunk, data, base64.b32encode(sha.digest()).decode(), left == 0)
                chunk += 1
                if not left:
                    break


_CHUNK = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()),
                    ("digest_so_far", pa.string()), ("last", pa.bool_())])
CHUNK_TABLE = ("page_id long, target_uri string, record_type string, refers_to long, declared_digest string, payload_bytes long, "
               "chunk int, data binary, digest_so_far string, last boolean")


def _read(chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for row in _parse(path, chunk_bytes):
                    rows.append(row)
                    size += len(row[7])
                    if size >= 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)

    return run


def read_archives(index: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives: one row per record and chunk number, with the digest up to the chunk's end."""
    archives = index.select("archive").distinct()
    return archives.repartition(max(1, archives.count())).mapInArrow(_read(chunk_bytes), CHUNK_TABLE)


def verified(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to. A response whose bytes do not match its header fails the job."""
    wrong = (F.col("record_type") == "response") & (F.col("digest_so_far") != F.col("declared_digest"))
    return chunks.where("last").select(
        "page_id", "target_uri", "payload_bytes",
        F.when(wrong, F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?")))).cast("string"))
        .otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to")


def decode_uri(uri: str) -> str:
    return unquote(uri)


def archive_round_trip(spark: SparkSession, pages: DataFrame, at_least: int = 0) -> DataFrame:
    index = write_archives(chunk_rows(records(pages, at_least)), scratch(spark, "warc"))
    return verified(read_archives(index))


SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
digested AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM payloads),
coded AS (
  SELECT *, array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * j + 1)::INT, 5))::BIGINT >> s) & 31)::INT, 1)), '')), '') AS payload_digest FROM digested)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to FROM coded
"""
