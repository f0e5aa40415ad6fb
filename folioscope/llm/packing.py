"""Packing into fixed windows by best-fit decreasing (operator 5).

A document's ids, with a closing id, are cut into full windows, each a sequence
of its own, and a rest.  Rests are placed longest first, each into the open
sequence with the least room that still holds it; a segment tree over the
remaining capacity finds that room in log2(window) steps.

Plan: a map cuts documents into pieces, which are written to the shared folder.
Rests, as narrow rows, are then dealt evenly over groups of GROUP_RESTS or fewer,
each packed by one task, so padding doesn't depend on how the input is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
#: Rests of a group, which are packed together.
GROUP_RESTS = 20_000
#: Rests that a task holds at most.
PACK_ROWS = 500_000
#: Sequences of rests have this bit in their number, full windows don't.
RESTS = 1 << 60
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KIND = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


class TightestRoom:
    """Open sequences by remaining capacity, over a segment tree of counts."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()  # rooms 0 .. window
        self.count = [0] * (2 * self.size)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: tuple[int, int]) -> None:
        self.open[room].append(sequence)
        k = room + self.size
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, tuple[int, int]] | None:
        """Removes a sequence with the smallest room of at least least; the room and the sequence."""
        k = least + self.size
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k ^ 1]):  # up, until there is a right sibling with something in it
                k >>= 1
            if k <= 1:
                return None
            k ^= 1
            while k < self.size:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.size
        sequence = self.open[room].pop()
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, sequence


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, sequences numbered from 0; lengths are 1 to window."""
    rooms, out, n = TightestRoom(window), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if found := rooms.take(lengths[k]):
            room, (sequence, _) = found
        else:
            room, sequence, n = window, n, n + 1
        out[k] = (sequence, window - room)
        if room > lengths[k]:
            rooms.add(room - lengths[k], (sequence, 0))
    return out


def _cut(name: str, end: int, window: int):
    """Pieces of documents; full windows have their sequence, rests none yet."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        e, base, n = common.encoder(name), TaskContext.get().partitionId() << 36, 0
        for b in batches:
            keys = b.column("key").to_pylist()
            for first, flat, counts in e.encode(b.column("text")):
                rows = []
                for key, ids in zip(keys[first : first + len(counts)], np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    data, total = ids.tobytes(), len(ids)
                    for at in range(0, total, window):
                        piece = (key, at, min(window, total - at), zlib.crc32(data[4 * at : 4 * (at + window)]), total)
                        full = piece[2] == window
                        rows.append((*piece, base + n if full else None, 0))
                        n += full
                yield _batch(rows)

    return run


def _place(window: int, pack_rows: int):
    """Packs the rests that a task reads, pack_rows of them at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        base, n = RESTS | TaskContext.get().partitionId() << 36, 0
        rests: list[tuple] = []

        def flush(n: int) -> tuple[pa.RecordBatch, int]:
            places = best_fit([r[2] for r in rests], window)
            rows = [(*r, base + n + s, at) for r, (s, at) in zip(rests, places, strict=True)]
            rests.clear()
            return _batch(rows), n + 1 + max((s for s, _ in places), default=-1)

        for b in batches:
            rests += zip(*(b.column(c).to_pylist() for c in _KIND.names[:5]), strict=True)
            if len(rests) >= pack_rows:
                more, n = flush(n)
                yield more
        more, n = flush(n)
        yield more

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(_KIND))], schema=_KIND)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 0, window: int = WINDOW, key: str = "doc_id", text: str = "text", pack_rows: int = PACK_ROWS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of ids(text) + [end] lies in exactly one piece; offsets in a sequence
    are gapless from 0.  sequence_id is the task's number and a count in it, with
    the bit RESTS where rests are packed.  A
    null text is the empty one, whose only id is end; null or repeated keys pack as
    any other row does; an empty table gives no row; other columns aren't looked at.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = common.written(rows.mapInArrow(common.frugal(_cut(tokenizer, end, window)), PIECES), "pieces")
    rests = pieces.where("sequence_id is null")
    groups = max(1, -(-rests.count() // GROUP_RESTS))
    return pieces.where("sequence_id is not null").unionByName(rests.repartition(groups).mapInArrow(common.frugal(_place(window, pack_rows)), PIECES))


def stored(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequence_id, filled, stored: the length of each sequence and that as stored: padded to window, but for a power of two."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    return filled.withColumn("stored", F.when(F.col("filled").bitwiseAND(F.col("filled") - 1) == 0, F.col("filled")).otherwise(window))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
