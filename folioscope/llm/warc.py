"""WARC archives as a chunked record table (operator 4).

A record is stored as rows (archive, record, chunk number), each with at most
chunk_bytes of payload: gzip bytes that make one member for each record when they
are joined, the payload's length so far and its SHA-1 so far.  Payloads are cut by
the JVM, so no Python worker holds more than a chunk and a compressor's window,
and a reader takes one chunk after another through a decompressor and a digest.
An archive's rows in order are a valid .warc.gz file.

Equal payloads: the one with the smallest id is the response, the others revisit
it.  That is found by digest and length on narrow rows.  Payloads of which a
thousandth of all rows have a copy are at most a thousand, and joined by
broadcast.  Rows move once more, by id, next to what they revisit.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_counts import hot_join

CHUNK_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "archive int, record long, chunk long, last boolean, offset long, payload_upto long, sha1_upto string, data binary"
_ARROW = pa.schema([("archive", pa.int32()), ("record", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("offset", pa.int64()), ("payload_upto", pa.int64()), ("sha1_upto", pa.string()), ("data", pa.binary())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(b'%s|%s' % (str(key).encode(), digest)).digest())}>"


def header(row: dict) -> bytes:
    """The record's header with its closing empty line."""
    revisit = row["refers_to"] is not None
    uri = "".join(c if 32 < ord(c) else f"%{ord(c):02X}" for c in row["url"] or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['key'], row['digest'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32(row['digest'])}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'], row['digest'])}", f"Refers-To-Page: {row['refers_to']}"]
    lines += [f"Page: {row['key']}"] * (row["key"] is not None)
    lines += [f"Payload-Length: {row['n_bytes']}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else row['n_bytes']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _write(batches):
    archive, record, offset = TaskContext.get().partitionId(), -1, 0
    z = sha = None
    upto = 0
    for b in batches:
        out = []
        for row in b.to_pylist():
            data = b""
            if row["chunk"] == 0:
                record, upto = record + 1, 0
                z, sha = zlib.compressobj(LEVEL, wbits=31), hashlib.sha1(usedforsecurity=False)
                data = z.compress(header(row))
            part = row["part"]
            sha.update(part)
            upto += len(part)
            data += z.compress(part)
            if row["last"]:
                data += z.compress(b"\r\n\r\n") + z.flush()
            else:
                data += z.flush(zlib.Z_SYNC_FLUSH)
            out.append((archive, record, row["chunk"], row["last"], offset, upto, sha.hexdigest(), data))
            offset += len(data)
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(list(zip(*out, strict=True)) or [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES, min_revisit: int = 0) -> None:
    """Writes a record for each row of pages to path.

    Of rows with equal payloads of at least min_revisit bytes, those with the
    smallest key are responses, the others revisits.  A null payload is empty; a
    null key sorts after all others and is a response, as nothing could name it
    otherwise; repeated rows give a record each; an empty table gives an empty
    archive; other columns are not looked at.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "n_bytes": F.length("payload").cast("long")})
    narrow = rows.where((F.col("n_bytes") >= min_revisit) & F.col("key").isNotNull()).select("key", "digest", "n_bytes")
    groups = common.written(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("refers_to")).where("n > 1"), "payloads")
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    linked = hot_join(narrow, groups.drop("n"), groups.select("digest", "n"), "digest", n_rows)
    linked = linked.where("key <> refers_to").select("key", "digest", "refers_to").distinct()
    # payloads are cut where they are read, so that no shuffle or sort holds a whole one
    count = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring("payload", k * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "key", "url", "digest", "n_bytes", count.alias("n_chunks"), F.posexplode(parts).alias("chunk", "part"))
    rows = rows.join(linked.hint("shuffle_hash"), ["key", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    rows = rows.where(~revisit | (F.col("chunk") == 0))
    last = revisit | (F.col("chunk") == F.col("n_chunks") - 1)
    rows = rows.select("row", "key", "url", "digest", "n_bytes", "refers_to", F.col("chunk").cast("long").alias("chunk"), last.alias("last"), F.when(revisit, F.lit(b"")).otherwise(F.col("part")).alias("part"))
    rows.sortWithinPartitions("row", "chunk").drop("row").mapInArrow(_write, ROWS).write.option("compression", "none").parquet(path)


def archive_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(path)


def archive_bytes(spark: SparkSession, path: str, archive: int) -> Iterator[bytes]:
    """One archive as the bytes of a .warc.gz file, chunk by chunk; memory is that of a partition of chunks."""
    rows = archive_chunks(spark, path).where(F.col("archive") == archive).orderBy("record", "chunk").select("data")
    for r in rows.toLocalIterator():
        yield bytes(r["data"])


class _Reader:
    """Takes a record's chunks in order."""

    def __init__(self):
        self.z, self.sha, self.n, self.head, self.fields = zlib.decompressobj(wbits=31), hashlib.sha1(usedforsecurity=False), 0, b"", None
        self.length = 0

    def feed(self, data: bytes) -> None:
        plain = self.z.decompress(data)
        if self.fields is None:
            self.head += plain
            top, found, plain = self.head.partition(b"\r\n\r\n")
            if not found:
                return
            self.fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
            self.length = int(self.fields["Content-Length"])
        plain = plain[: self.length - self.n]
        self.sha.update(plain)
        self.n += len(plain)

    def row(self) -> tuple:
        f = self.fields
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and (self.n != self.length or base32(self.sha.digest()) != digest):
            raise ValueError(f"record {f['WARC-Record-ID']}: the payload doesn't have the digest in its header")
        page, first = f.get("Page"), f.get("Refers-To-Page")
        return int(page) if page else None, int(f["Payload-Length"]), digest, f["WARC-Type"], int(first) if first else None, f["WARC-Target-URI"]


def _read(batches):
    reader = None
    for b in batches:
        out = []
        for chunk, last, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "last", "data")), strict=True):
            if chunk == 0:
                reader = _Reader()
            reader.feed(data)
            if last:
                out.append(reader.row())
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(list(zip(*out, strict=True)) or [[]] * len(_RECORDS), _RECORDS, strict=True)], schema=_RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri; responses' digests are checked.

    Records of one chunk are read where they lie; only those of several are brought together.
    """
    rows = archive_chunks(spark, path).select("archive", "record", "chunk", "last", "data")
    single = (F.col("chunk") == 0) & F.col("last")
    many = rows.where(~single).repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return rows.where(single).mapInArrow(_read, RECORDS).unionByName(many.mapInArrow(_read, RECORDS))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC records and reads the archives back."""
    path = common.scratch(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


ORACLE_SQL = """
with p as (select page_id, url, coalesce(html, '') as h, unhex(sha1(coalesce(html, ''))) as d from pages),
b as (select page_id, url, cast(strlen(h) as bigint) as n, d, min(page_id) over (partition by d, strlen(h)) as f from p),
bits as (select page_id, list_reduce(list_transform(range(4), lambda k:
    list_aggregate(list_transform(range(8), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
      ((list_reduce(list_transform(range(5), lambda i: cast(('0x' || substr(hex(d), cast(1 + 10 * k + 2 * i as int), 2)) as hugeint)), lambda x, y: x * 256 + y)
        // cast(pow(32, 7 - j) as hugeint)) % 32) as int), 1)), 'string_agg', '')), lambda x, y: x || y) as b32 from b)
select b.page_id, n as payload_bytes, b32 as payload_digest,
  case when b.page_id = f then 'response' else 'revisit' end as record_type,
  case when b.page_id = f then null else f end as refers_to, url as target_uri
from b join bits on b.page_id = bits.page_id
"""
