"""Operator 9: WARC archives as a chunked record table.

An archive is a table of byte rows (archive, offset, record_id, chunk_no, data): concatenating an
archive's rows in offset order gives a WARC/1.1 file. A record's head is the start of chunk 0, and a
payload larger than a chunk continues in further rows, so no task holds a whole oversized record
beside its cell in the input batch. Every chunk carries the SHA-1 of the payload up to its end, which
lets the reader check a record chunk by chunk with one running digest.

Any file system Spark can write holds the table, and a lost task is written again by Spark's commit
protocol. Records of one chunk are read back where they lie; only chunks of oversized records are
brought together, by record, in chunk order.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, small_batches, table

CHUNK_BYTES = 64 * 1024
BATCH_BYTES = 8 * 1024 * 1024
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SPACE = uuid.UUID("7b1d7c0e-6a1f-4a53-9b7e-5d3c1a2f9e40")

CHUNK_SCHEMA = "archive int, offset long, record_id string, chunk_no int, is_last boolean, data binary, payload_sha1 binary"


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record_head(kind: str, record_id: str, url: str | None, page_id, digest: str, payload_bytes: int, refers_to, refers_url: str | None = None) -> bytes:
    """Header block of a record; for a revisit without a payload the length of the payload is kept too."""
    block = len(HTTP_HEAD) + (payload_bytes if kind == "response" else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
    ]
    if kind == "revisit":
        lines[4:4] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {one_line(refers_url)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"


def with_record_types(pages: DataFrame, id_col: str, url_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """Pages with payload, record type and the page a revisit refers to.

    Only (id, digest) rows meet on the digest, counted on the map side first; payloads move once, by
    id and digest, so a payload shared by a third of all pages is no hot key for them.
    """
    # one column each, so extra columns of the input cannot clash
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = base.withColumn("sha1", F.unhex(F.sha1("payload")))
    small = keyed.select("page_id", "sha1", "url", F.octet_length("payload").alias("n")).groupBy("page_id", "sha1").agg(F.min("url").alias("url"), F.first("n").alias("n"))
    first = small.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url"))
    typed = small.join(first, "sha1", "left").select(F.col("page_id").alias("k_page"), F.col("sha1").alias("k_sha1"), "first_page", "first_url")
    joined = keyed.join(typed, F.col("page_id").eqNullSafe(F.col("k_page")) & (F.col("sha1") == F.col("k_sha1")))
    is_response = F.col("first_page").isNull() | F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select(
        "page_id",
        "url",
        F.when(is_response, F.col("payload")).alias("payload"),
        "sha1",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(is_response, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_response, F.col("first_page")).alias("refers_to"),
        F.when(~is_response, F.col("first_url")).alias("refers_url"),
    )


def write_records(records: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one WARC record per row of ``records`` into the chunk table at ``path``."""

    def run(batches):
        archive = TaskContext.get().partitionId()
        offset = number = 0
        rows: list[tuple] = []
        held = 0
        fields = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names)
            rows, held = [], 0
            return out

        for batch in batches:
            page, url, payload, sha1, size, kind, refers, refers_url = batch.columns
            for k in range(batch.num_rows):
                page_id, what = page[k].as_py(), kind[k].as_py()
                record_id = uuid.uuid5(RECORD_SPACE, f"{page_id}/{archive}/{number}").urn
                number += 1
                head = record_head(what, record_id, url[k].as_py(), page_id, base64.b32encode(sha1[k].as_py()).decode(), size[k].as_py(), refers[k].as_py(), refers_url[k].as_py()) + HTTP_HEAD
                body = memoryview(payload[k].as_buffer()) if what == "response" else memoryview(b"")
                digest, at, chunk_no = hashlib.sha1(), 0, 0
                while True:
                    piece = body[at : at + chunk_bytes]
                    digest.update(piece)
                    at += len(piece)
                    last = at >= len(body)
                    data = b"".join((head if not chunk_no else b"", piece, b"\r\n\r\n" if last else b""))
                    rows.append((archive, offset, record_id, chunk_no, last, data, digest.digest()))
                    offset += len(data)
                    held += len(data)
                    chunk_no += 1
                    if held >= BATCH_BYTES:
                        yield flush()
                    if last:
                        break
        if rows:
            yield flush()

    records.mapInArrow(run, CHUNK_SCHEMA).write.parquet(path)


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields of a record and the place where its block begins."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode("utf-8").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines), end + 4


def read_records(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Read a chunk table back: one row per record, payloads checked against length and digests.

    A record whose chunks are missing, out of order or changed raises an error.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path).select("record_id", "chunk_no", "is_last", "data", "payload_sha1")
    schema = f"page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def run(batches):
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in schema.split(", ")]
        current = None  # (record id, header, digest, payload bytes so far, next chunk)
        for batch in batches:
            out = []
            ids, numbers, lasts, sums = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for k, (record, number, last, running) in enumerate(zip(ids, numbers, lasts, sums)):
                data = memoryview(batch.column(3)[k].as_buffer())
                if number == 0:
                    if current is not None:
                        raise ValueError(f"{current[0]}: its last chunk is missing")
                    head, at = parse_head(bytes(data))
                    if bytes(data[at : at + len(HTTP_HEAD)]) != HTTP_HEAD:
                        raise ValueError(f"{record}: unknown HTTP head")
                    data = data[at + len(HTTP_HEAD) :]
                    current = [record, head, hashlib.sha1(), 0, 0]
                if current is None or (current[0], current[4]) != (record, number):
                    raise ValueError(f"{record}: chunk {number} is out of place")
                if last:
                    if bytes(data[-4:]) != b"\r\n\r\n":
                        raise ValueError(f"{record}: no end mark")
                    data = data[:-4]
                current[2].update(data)
                current[3] += len(data)
                current[4] += 1
                if current[2].digest() != running:
                    raise ValueError(f"{record}: chunk {number} does not match its digest")
                if last:
                    head, kind = current[1], current[1]["WARC-Type"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["X-Payload-Length"])
                    if int(head["Content-Length"]) != len(HTTP_HEAD) + current[3]:
                        raise ValueError(f"{record}: wrong length")
                    if kind == "response":
                        if current[3] != size or base64.b32encode(running).decode() != digest:
                            raise ValueError(f"{record}: wrong payload")
                    out.append((head["X-Page-ID"] or None, head["WARC-Target-URI"], size, digest, kind, head.get("X-Refers-To-Page-ID")))
                    current = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if current is not None:
            raise ValueError(f"{current[0]}: its last chunk is missing")

    whole = (F.col("chunk_no") == 0) & F.col("is_last")
    oversized = chunks.filter(~whole).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    records = chunks.filter(whole).mapInArrow(run, schema).union(oversized.mapInArrow(run, schema))
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a WARC record per page into a new chunk table at ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the smallest id is a
    response and the others revisit it; rows that repeat the smallest id are responses each. Null
    payloads and urls count as empty, so empty payloads can revisit each other too. Smaller payloads
    are always responses. An empty table gives an archive without records.
    """
    small_batches(pages.sparkSession)
    write_records(with_record_types(pages, id_col, url_col, text_col, min_bytes), path, chunk_bytes)


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write the archives of a chunk table as flat ``.warc`` files into a folder all executors mount.

    Returns a lazy frame of (file, bytes); a file appears under its name once it is whole.
    """

    def run(batches):
        name, out, done = None, None, []

        def close():
            out.close()
            os.replace(out.name, name)
            done.append((name, os.path.getsize(name)))

        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                file = os.path.join(folder, f"part-{archive:06d}.warc")
                if file != name:
                    if out is not None:
                        close()
                    name, out = file, open(f"{file}.{os.getpid()}", "wb")  # noqa: SIM115
                out.write(data.as_buffer())
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done]), pa.array([n for _, n in done], pa.int64())], ["file", "bytes"])

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path).select("archive", "offset", "data")
    return chunks.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(run, "file string, bytes long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), new_folder(spark, "warc")
    archive_pages(pages, path)
    return read_records(spark, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_sql() -> str:
    """Base32 of the hex SHA-1, five bits a character, in DuckDB."""
    return """
with p as (select page_id, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select h, min(page_id) as first_page from p group by h)
select p.page_id, cast(p.n as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    (cast('0x' || substr(p.h || '00', 1 + (5 * i) // 4, 2) as integer) // cast(pow(2, 3 - (5 * i) % 4) as integer)) % 32 as integer), 1)), 'string_agg', '') as payload_digest,
  case when p.page_id = f.first_page then 'response' else 'revisit' end as record_type,
  case when p.page_id <> f.first_page then f.first_page end as refers_to
from p join f using (h)
"""
