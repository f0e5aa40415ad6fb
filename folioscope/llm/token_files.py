"""Token-id files with shuffled planes (operator 2).

File format: a Parquet table of chunk rows, so that Spark's committer settles
which attempt of a task counts and any store that Spark writes to will do.  A
shard is a range of keys, its ids are cut into chunks of CHUNK_IDS whatever the
document, and a chunk's ids are transposed into byte planes (plane k has byte k
of every id) or bit planes, each compressed with zstandard; planes that are all
zero have length 0.  The other columns are the chunk index: the id number where
the chunk begins in its shard, its count of ids, and the documents it holds.
Reading the index alone reads no payload.

Plan: one range shuffle of the texts on (key, content hash), so equal keys can
split; ids are made after it and never shuffled.  Reading is a map over chunks
and an aggregate of one narrow row for each document and chunk.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_IDS = 1 << 16
LEVEL = 3
SEGMENT = pa.struct([("ordinal", pa.int64()), ("key", pa.int64()), ("before", pa.int64()), ("n", pa.int32())])
CHUNKS = "shard int, chunk long, id_start long, n_ids int, bits boolean, plane_bytes array<int>, payload binary, segments array<struct<ordinal: long, key: long, before: long, n: int>>"
_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("id_start", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.bool_()), ("plane_bytes", pa.list_(pa.int32())), ("payload", pa.binary()), ("segments", pa.list_(SEGMENT))])


def pack(ids: np.ndarray, bits: bool = False, level: int = LEVEL) -> tuple[list[int], bytes]:
    """Compressed sizes of the planes of ids (unsigned 32 bits), and the planes in a row."""
    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        planes = np.concatenate([np.packbits((plane[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1) for plane in planes])
    z = zstandard.ZstdCompressor(level=level)
    parts = [z.compress(plane.tobytes()) if plane.any() else b"" for plane in planes]
    return list(map(len, parts)), b"".join(parts)


def unpack(n_ids: int, sizes: list[int], payload: bytes, bits: bool = False) -> np.ndarray:
    """What pack() packed."""
    z, at, planes = zstandard.ZstdDecompressor(), 0, []
    for size in sizes:
        planes.append(np.frombuffer(z.decompress(payload[at : at + size]), np.uint8) if size else None)
        at += size
    out = np.zeros((n_ids, 4), np.uint8)
    for k, plane in enumerate(planes):
        if plane is not None and bits:
            out[:, k // 8] |= np.unpackbits(plane, count=n_ids) << (k % 8)
        elif plane is not None:
            out[:, k] = plane
    return out.reshape(-1).view("<u4")


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return out


@functools.cache
def _zero_bytes(power: int) -> tuple[int, ...]:
    """The bit matrix by which 2 ** power zero bytes change a crc32, worked out once by each process."""
    if power == -3:  # an eighth of a byte: one zero bit
        return (0xEDB88320, *(1 << k for k in range(31)))
    half = _zero_bytes(power - 1)
    return tuple(_times(half, x) for x in half)


def crc32_join(first: int, second: int, length: int) -> int:
    """crc32(a + b) from crc32(a), crc32(b) and len(b)."""
    power = 0
    while length:
        if length & 1:
            first = _times(_zero_bytes(power), first)
        length, power = length >> 1, power + 1
    return first ^ second


def _write(name: str, end: int | None, chunk_ids: int, bits: bool):
    def run(batches):
        e, shard = common.encoder(name), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        segments: list[dict] = []
        state = {"n": 0, "chunk": 0, "start": 0, "ordinal": 0}

        def row():
            sizes, payload = pack(np.concatenate(held) if held else np.zeros(0, "<u4"), bits)
            out = pa.record_batch([pa.array([x], f.type) for x, f in zip([shard, state["chunk"], state["start"], state["n"], bits, sizes, payload, segments[:]], _ARROW, strict=True)], schema=_ARROW)
            state["start"] += state["n"]
            state["chunk"] += 1
            state["n"] = 0
            held.clear()
            segments.clear()
            return out

        for b in batches:
            keys = b.column("key").to_pylist()
            for key, ids in zip(keys, e.each(b.column("text")), strict=True):
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                at = 0
                while True:
                    take = min(len(ids) - at, chunk_ids - state["n"])
                    held.append(ids[at : at + take])
                    segments.append({"ordinal": state["ordinal"], "key": key, "before": at, "n": take})
                    state["n"] += take
                    at += take
                    if state["n"] == chunk_ids:
                        yield row()
                    if at >= len(ids):
                        break
                state["ordinal"] += 1
        if segments:
            yield row()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int | None = 1, key: str = "doc_id", text: str = "text", chunk_ids: int = CHUNK_IDS, bits: bool = False) -> None:
    """Writes the ids of all texts to path in ascending order of key, each followed by end.

    Nulls: a null text is the empty one; rows without a key come first.  Equal keys
    are ordered by text.  An empty table gives an empty file.  key must be an
    integer; other columns are not looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    rows.mapInArrow(_write(tokenizer, end, chunk_ids, bits), CHUNKS).write.option("compression", "none").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def _segments(batches):
    names = ["shard", "ordinal", "key", "before", "id_start", "n", "crc"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            data, at = unpack(r["n_ids"], r["plane_bytes"], r["payload"], r["bits"]).tobytes(), 0
            for s in r["segments"]:
                rows.append((r["shard"], s["ordinal"], s["key"], s["before"], r["id_start"] + at // 4, s["n"], zlib.crc32(data[at : at + 4 * s["n"]])))
                at += 4 * s["n"]
        yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], names=names)


def _joined(batches):
    """Documents of several chunks: their parts' checksums put together."""
    for b in batches:
        crcs = []
        for parts in b.column("parts").to_pylist():
            crc = 0
            for p in sorted(parts, key=lambda p: p["before"]):
                crc = crc32_join(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        yield b.drop_columns(["parts"]).append_column("ids_crc32", pa.array(crcs, pa.int64()))


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: key, start (ids before it), n_tokens, ids_crc32, from the decoded ids."""
    chunks = read_chunks(spark, path)
    # a row for each shard, that is for each task that wrote
    shards = sorted(tuple(r) for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = {}, 0
    for shard, n in shards:
        bases[shard] = total
        total += n
    base = F.broadcast(spark.createDataFrame(list(bases.items()), "shard int, base long"))
    rows = chunks.mapInArrow(_segments, "shard int, ordinal long, key long, before long, id_start long, n long, crc long")
    part = F.struct("before", "n", "crc")
    docs = rows.groupBy("shard", "ordinal").agg(F.first("key").alias("key"), F.min("id_start").alias("at"), F.sum("n").alias("n_tokens"), F.collect_list(part).alias("parts"))
    docs = docs.join(base, "shard").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "parts")
    kind = "key long, start long, n_tokens long, ids_crc32 long"
    single = docs.where(F.size("parts") == 1).select("key", "start", "n_tokens", F.col("parts")[0]["crc"].alias("ids_crc32"))
    return single.unionByName(docs.where(F.size("parts") > 1).mapInArrow(_joined, kind))


def token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of each document as binary, put together again: key, ids."""
    kind = "shard int, ordinal long, key long, before long, ids binary"

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                data, at = unpack(r["n_ids"], r["plane_bytes"], r["payload"], r["bits"]).tobytes(), 0
                for s in r["segments"]:
                    rows.append((r["shard"], s["ordinal"], s["key"], s["before"], data[at : at + 4 * s["n"]]))
                    at += 4 * s["n"]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "ordinal", "key", "before", "ids"])

    rows = read_chunks(spark, path).mapInArrow(run, kind)
    parts = F.array_sort(F.collect_list(F.struct("before", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return rows.groupBy("shard", "ordinal").agg(F.first("key").alias("key"), joined.alias("ids")).select("key", "ids")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids by the 49k word vocabulary, then reads the files back."""
    path = common.scratch(spark, "token-ids")
    write_ids(common.table(spark, sf_dir, "documents"), path)
    return documents_of(spark, path).withColumnRenamed("key", "doc_id")
