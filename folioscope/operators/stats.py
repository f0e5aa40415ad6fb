"""Paired significance tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from folioscope.functions.text import format_p


@F.udf(DoubleType(), useArrow=True)
def _two_sided(z):
    return math.erfc(abs(z) / math.sqrt(2)) if z is not None else None


def wilcoxon(pairs: DataFrame, by: tuple[str, ...] = ("comparison",)) -> DataFrame:
    """Per group: n, n_plus, n_minus, statistic, z of pairs (a, b); zero differences are left out.

    Average ranks, normal approximation with the correction for ties.
    """
    d = pairs.select(*by, (F.col("a") - F.col("b")).alias("d"))
    groups = d.select(*by).distinct()
    d = d.where("d <> 0").withColumn("m", F.round(F.abs("d"), 12))
    # ranks from counts of equal sizes: a group's distinct sizes are few, its rows may not be
    sizes = d.groupBy(*by, "m").agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("plus"))
    w = W.partitionBy(*by).orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("r", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    rows = sizes.groupBy(*by).agg(F.sum("t").alias("n"), F.sum("plus").alias("n_plus"), F.sum(F.col("r") * F.col("plus")).alias("w_plus"), F.sum(F.col("r") * (F.col("t") - F.col("plus"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    rows = groups.join(rows, list(by), "left")
    zero = F.col("n").isNull() | (variance <= 0)
    return rows.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_plus", F.lit(0)).alias("n_plus"), (F.coalesce("n", F.lit(0)) - F.coalesce("n_plus", F.lit(0))).alias("n_minus"), F.coalesce(F.least("w_plus", "w_minus"), F.lit(0.0)).alias("statistic"), F.when(zero, 0.0).otherwise((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(variance)).alias("z"))


def with_p(tests: DataFrame) -> DataFrame:
    """Adds the two-sided p of z; without a difference it is 1."""
    return tests.withColumn("p", F.when(F.col("n") == 0, 1.0).otherwise(_two_sided("z")))


def benjamini_hochberg(tests: DataFrame, p: str = "p", family: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_adjusted within each family: p * n / rank, then the least from the largest p down.

    Of equal p the one ranked last has the least quotient, so they all have one
    adjusted p.  Windows are over a family's distinct p and their counts, and run from
    one end: a frame that is open at the far end is read again for every row.
    """
    counts = tests.groupBy(*(F.col(c).alias(f"_{k}") for k, c in enumerate(family)), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_t"))
    keys = [f"_{k}" for k in range(len(family))]
    up, down = (W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0) for order in (F.asc("_p"), F.desc("_p")))
    ranked = counts.withColumns({"_n": F.sum("_t").over(W.partitionBy(*keys)), "_r": F.sum("_t").over(up)})
    ranked = ranked.withColumn("_q", F.least(F.col("_p") * F.col("_n") / F.col("_r"), F.lit(1.0)))
    ranked = ranked.select(*keys, "_p", F.min("_q").over(down).alias("p_adjusted"))
    same = F.col(p).eqNullSafe(F.col("_p"))
    for k, c in enumerate(family):
        same &= F.col(c).eqNullSafe(F.col(f"_{k}"))
    return tests.join(ranked, same).select(*tests.columns, "p_adjusted")


def cohens_d(pairs: DataFrame, by: tuple[str, ...] = ("comparison",)) -> DataFrame:
    """Per group: mean_diff, d (mean over standard deviation; infinite or 0 without spread)."""
    rows = pairs.groupBy(*by).agg(F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"), F.avg("b").alias("base_mean"))
    flat = F.coalesce("sd", F.lit(0.0)) < 1e-15
    d = F.when(flat, F.when(F.col("mean_diff") == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide("mean_diff", "sd"))
    return rows.select(*by, "mean_diff", d.alias("d"), "base_mean")


def bootstrap(pairs: DataFrame, by: str = "comparison", rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """by, low, high: percentile bounds of the mean difference over seeded resamples.

    What is resampled is the table of distinct differences and their counts: a
    multinomial draw over it has the distribution of drawing rows with replacement,
    though not the draws of row_bootstrap.  Differences count to six places, so a
    group of any size has at most two million of them where scores are from 0 to 1.
    """
    counts = pairs.groupBy(by, F.round(F.col("a") - F.col("b"), 6).alias("d")).agg(F.count(F.lit(1)).alias("n"))

    @F.udf(ArrayType(DoubleType()), useArrow=True)
    def bounds(values):
        rows = sorted((float(v["d"]), int(v["n"])) for v in values)
        d, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        rng = np.random.RandomState(seed)
        return _bounds([rng.multinomial(n.sum(), n / n.sum()) @ d / n.sum() for _ in range(rounds)], confidence)

    rows = counts.groupBy(by).agg(bounds(F.collect_list(F.struct("d", "n"))).alias("ci"))
    return rows.select(by, F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))


def _bounds(means: list[float], confidence: float) -> list[float]:
    tail = (1 - confidence) / 2 * 100
    return [float(x) for x in np.percentile(means, [tail, 100 - tail])]


def resample(scores: np.ndarray, rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Bounds of the mean of scores, rows drawn with replacement by numpy's legacy generator."""
    rng = np.random.RandomState(seed)
    low, high = _bounds([rng.choice(scores, size=len(scores), replace=True).mean() for _ in range(rounds)], confidence)
    return low, high


def row_bootstrap(pairs: DataFrame, by: str = "comparison", order: str = "query_id", rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """As bootstrap, with the very draws of a generator over the rows in the order of order.

    That needs a comparison's differences, one number a query, in one task: it is for
    judged query sets, which people write.
    """

    def run(rows):
        d = rows.sort_values(order)
        low, high = resample((d["a"] - d["b"]).to_numpy(), rounds, confidence, seed)
        return d[[by]].head(1).assign(low=low, high=high)

    kind = dict(pairs.dtypes)[by]
    return pairs.select(by, order, "a", "b").groupBy(by).applyInPandas(run, f"{by} {kind}, low double, high double")


def effect_label(d):
    return F.when(F.abs(d) >= 1.0, "very large").when(F.abs(d) >= 0.8, "large").when(F.abs(d) >= 0.5, "medium").otherwise("small")


def significance(pairs: DataFrame, by: tuple[str, ...] = ("comparison",), intervals=bootstrap, alpha: float = 0.05) -> DataFrame:
    """One row for each comparison: z, p, adjusted p, d, interval, mean difference, percent over the base, labels and a LaTeX line."""
    rows = with_p(wilcoxon(pairs, by)).join(cohens_d(pairs, by), list(by)).join(intervals(pairs, by[0]), by[0])
    rows = benjamini_hochberg(rows)
    pct = F.col("mean_diff") / F.greatest("base_mean", F.lit(1e-9)) * 100
    interval = F.format_string("[%.3f, %.3f]", "low", "high")
    latex = F.concat(F.concat_ws(" & ", *(F.col(c).cast("string") for c in by), format_p(F.col("p_adjusted")), F.format_string("%.2f", "d"), interval), F.lit(r" \\"))
    return rows.select(*by, "n_plus", "n_minus", "z", "p", "p_adjusted", (F.col("p_adjusted") < alpha).alias("significant"), "d", "low", "high", "mean_diff", pct.alias("pct"), effect_label(F.col("d")).alias("effect"), format_p(F.col("p_adjusted")).alias("p_text"), latex.alias("latex"))
