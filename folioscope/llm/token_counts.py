"""Token counts through a digest cache (operator 1).

Counts are kept in a table (content digest, tokenizer digest, count).  A corpus
is joined with it on both digests; of what is not there, one row for each
distinct content is encoded, and the new counts are appended.

Plan: digests and lengths come from the JVM.  One row for each missing digest
is picked by a partial aggregate over (digest, key), so a content that a third
of the corpus shares is one row in a task's output.  The picked keys, a few
dozen bytes each, are the hash side of a semi join with the texts on the row's
key, which is the one time that texts are shuffled.  The last join has one row
for each digest on its right side and the narrow rows on its left; digests that
hold over a thousandth of all rows are at most a thousand, and are broadcast.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE = "digest binary, version binary, n_tokens long"
#: A digest with more than this share of all rows is joined by broadcast, so there are at most 1 / HOT_SHARE of those.
HOT_SHARE = 1e-3
MAX_TOKENS = 512


def _count(name: str):
    def run(batches):
        e = common.encoder(name)
        for b in batches:
            counts = [pa.array(n, pa.int64()) for _, _, n in e.encode(b.column("text"))]
            yield pa.record_batch([b.column("digest"), pa.concat_arrays(counts) if counts else pa.array([], pa.int64())], names=["digest", "n_tokens"])

    return run


def hot_join(left: DataFrame, right: DataFrame, counts: DataFrame, key: str, n_rows: int) -> DataFrame:
    """left joined (left outer) with right, which has one row for each key; counts has (key, n) of left.

    Keys with over n_rows * HOT_SHARE rows, at most 1 / HOT_SHARE by count, are
    joined by broadcast; what is left has no heavy key.
    """
    hot = counts.where(F.col("n") > max(1, int(n_rows * HOT_SHARE))).select(key)
    rows = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    keys = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    flagged = left.join(keys, key, "left")
    few = flagged.where("is_hot").drop("is_hot").join(rows, key, "left")
    return few.unionByName(flagged.where("is_hot is null").drop("is_hot").join(right, key, "left"))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", limit: int = MAX_TOKENS) -> DataFrame:
    """Per row of docs: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: a file of public_tokenizers for the tokenizers library; begin, end
    and added special tokens aren't added, nothing is truncated.  Contents are
    normalised before they are digested only by what can't change a count: a null
    text is the empty one.  cache_path: the cache's table in a shared folder; it is
    made if there is none, and only ever appended to.  Two jobs that append the
    same digest do no harm: equal rows are read once.
    Null keys, repeated keys and repeated rows each give their row; an empty table
    gives none; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    version = F.unhex(F.lit(common.tokenizer_digest(public_tokenizers.path(tokenizer))))
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = base.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    counts = common.written(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")), "digests")
    cached = _cached(spark, cache_path)
    if cached is not None:
        old = cached.where(F.col("version") == version).select("digest").distinct()
        missing = counts.join(old, "digest", "left_anti")
    else:
        missing = counts
    picked = missing.select(F.col("key").alias("picked_key"), F.col("digest").alias("picked"))
    texts = base.join(picked.hint("shuffle_hash"), F.col("key").eqNullSafe(F.col("picked_key")) & (F.col("digest") == F.col("picked")), "left_semi")
    fresh = texts.select("digest", "text").mapInArrow(_count(tokenizer), "digest binary, n_tokens long")
    # repeated rows have the same key and digest, and come here more than once
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).select("digest", version.alias("version"), "n_tokens")
    fresh.write.mode("append").parquet(cache_path)
    known = _cached(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    out = hot_join(narrow, known, counts, "digest", n_rows)
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _cached(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(CACHE).parquet(path)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the 50k byte-level vocabulary, over a cache that starts empty."""
    return count_tokens(common.table(spark, sf_dir, "documents"), common.scratch(spark, "token-counts"))
