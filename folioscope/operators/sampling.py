"""Stratified sampling that keeps a document's queries together."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.udf(DoubleType(), useArrow=True)
def _seeded(path):
    """The first number of Python's generator, seeded with a path."""
    return random.Random(path).random()


def stratified(rows: DataFrame, stratum: str, group: str, order: str, size: int, n_strata: int | None = None, seeded: bool = False) -> DataFrame:
    """size // strata rows of each stratum, by the MD5 of group, then order; all rows if there are no more than size.

    seeded: by a number drawn from a generator seeded with group, instead of the MD5.
    Rows of one group have one key, so they stay together.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(stratum).alias("s")).first()
    if total["n"] <= size:
        return rows
    each = size // max(n_strata or total["s"], 1)
    key = F.col(group).cast("string")
    w = W.partitionBy(stratum).orderBy(_seeded(key) if seeded else F.md5(key), order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")


def counts(rows: DataFrame, stratum: str) -> DataFrame:
    return rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
