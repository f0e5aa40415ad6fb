"""Text encoders: an interface of Arrow batches, and one that needs no model."""

from __future__ import annotations

import zlib
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One unit row for each text."""


class HashedWords:
    """Bag of words, each hashed to a signed place; the same text has the same vector everywhere."""

    def __init__(self, dim: int = 256):
        self.dim, self.name = dim, f"hashed-words-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[(h >> 1) % self.dim] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def encoded(rows: DataFrame, key: str, encoder: Encoder, text: str = "text") -> DataFrame:
    """key, vector of each row's text, by batches."""

    def run(batches):
        for b in batches:
            v = encoder.encode(b.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * encoder.dim, pa.int32()), pa.array(v.ravel(), pa.float32()))
            yield pa.record_batch([b.column("key"), lists], names=["key", "vector"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<float>").withColumnRenamed("key", key)


def hashed(rows: DataFrame, key: str, dim: int = 256) -> DataFrame:
    return encoded(rows, key, HashedWords(dim))


def cached(rows: DataFrame, key: str, encoder: Encoder, path: str, text: str = "text") -> DataFrame:
    """key, vector, by way of a table (model, content digest, vector) at path; only texts that it lacks are encoded."""
    spark = rows.sparkSession
    kind = "model string, content string, vector array<float>"
    keyed = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content"))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    new = keyed.select("content", "text").dropDuplicates(["content"])
    if exists:
        new = new.join(spark.read.schema(kind).parquet(path).where(F.col("model") == encoder.name).select("content"), "content", "left_anti")
    encoded(new, "content", encoder).select(F.lit(encoder.name).alias("model"), "content", "vector").write.mode("append").parquet(path)
    known = spark.read.schema(kind).parquet(path).where(F.col("model") == encoder.name).dropDuplicates(["content"])
    return keyed.select("key", "content").join(known, "content").select(F.col("key").alias(key), "vector")
