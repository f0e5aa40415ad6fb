"""What the corpus operators share: shared scratch tables, tokenizers, tables."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINTS = "spark.checkpoint.dir"
#: Spark's setting for deleting the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The C library's number for its setting of the size from which a block is mapped on its own, and that size.
M_MMAP_THRESHOLD, MAPPED_BYTES = -3, 256 << 10


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share.

    That is what spark.checkpoint.dir names.  Only a local session, whose
    driver runs all tasks, may do without: it gets a temporary folder.
    """
    top = spark.conf.get(CHECKPOINTS, None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CHECKPOINTS} must name a folder that all executors share")
        top = _local_scratch()
    return f"{top.rstrip('/')}/folioscope/{name}-{uuid.uuid4().hex}"


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="folioscope-")


def written(df: DataFrame, name: str, codec: str = "zstd", tidy: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors don't lose it.

    tidy: the shuffle files of the write are deleted when it ends, whether or not
    the driver collects its garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    was = spark.conf.get(CLEANUP, None)
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    remove(df.sparkSession, df._scratch)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, through whichever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def tokenizer(path: str):
    """A tokenizers library file, loaded once by each process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def encoder(name: str):
    """A piece encoder for a file of public_tokenizers, kept by the Python worker from task to task."""
    from .pieces import PieceEncoder

    return PieceEncoder(tokenizer(public_tokenizers.path(name)))


@functools.cache
def _libc():
    """The C library, told to map large blocks on their own, so freeing one returns it; None if it has no such calls.

    Left to itself it maps fewer blocks the longer it runs: numpy's arrays then lie
    between small objects that stay, and their memory with them.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.malloc_trim.argtypes = [ctypes.c_size_t]
        libc.mallopt(M_MMAP_THRESHOLD, MAPPED_BYTES)
    except (OSError, AttributeError):
        return None
    return libc


def give_back() -> None:
    """Returns what this process has freed, but its allocators keep, to the system."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def frugal(run):
    """The function for mapInArrow, giving back freed memory before the first batch, after each and at the end.

    Spark keeps a Python worker for later tasks and steps; what it holds counts
    against their executor's memory as well.
    """

    def frugally(batches) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            for b in run(batches):
                yield b
                del b
                give_back()
        finally:
            give_back()

    return frugally


def tokenizer_digest(path: str) -> str:
    """Hex SHA-256 of a tokenizer's file: the version that cached counts belong to."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
