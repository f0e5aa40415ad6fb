"""Ranking metrics over relevance rows (query_id, rank, rel), any extra group columns first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 5, 10)


def per_query(rel: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, r_at_k (is there a hit), p_at_k, rr for each query, in one aggregation."""
    hit = F.col("rel") > 0
    cols = []
    for k in ks:
        near = F.col("rank") <= k
        cols += [F.max(F.when(near & hit, 1.0).otherwise(0.0)).alias(f"r_at_{k}"), (F.sum(F.when(near, F.col("rel")).otherwise(0)) / k).alias(f"p_at_{k}")]
    rr = F.coalesce(1 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr")
    return rel.groupBy(*by, "query_id").agg(*cols, rr)


def average_precision(rel: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, ap: mean precision at the hits within k, 0 without one."""
    w = W.partitionBy(*by, "query_id").orderBy("rank")
    hits = rel.where((F.col("rank") <= k) & (F.col("rel") > 0)).withColumn("p", F.row_number().over(w) / F.col("rank"))
    found = hits.groupBy(*by, "query_id").agg(F.avg("p").alias("ap"))
    return rel.select(*by, "query_id").distinct().join(found, [*by, "query_id"], "left").select(*by, "query_id", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def ndcg(rel: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, ndcg: gains 2 ** rel - 1; the ideal order is that of what was retrieved."""
    w = W.partitionBy(*by, "query_id").orderBy(F.desc("rel"), "rank")
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    rows = rel.withColumn("best", F.row_number().over(w))
    part = lambda place: F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    rows = rows.groupBy(*by, "query_id").agg(part("rank").alias("dcg"), part("best").alias("ideal"))
    return rows.select(*by, "query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def all_metrics(rel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group: recall and precision at KS, mrr, map_10, ndcg_10, n_queries."""
    key = [*by, "query_id"]
    rows = per_query(rel, KS, by).join(average_precision(rel, 10, by), key).join(ndcg(rel, 10, by), key)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    cols = [mean(f"{m}_at_{k}", f"{m}_at_{k}") for k in KS for m in "rp"]
    return rows.groupBy(*by).agg(*cols, mean("rr", "mrr"), mean("ap", "map_10"), mean("ndcg", "ndcg_10"), F.count(F.lit(1)).alias("n_queries"))


def sliced(scores: DataFrame, slices: tuple[str, ...], value: str) -> DataFrame:
    """Overall and by each slice, in one pass: slice_kind, slice, value (mean), n."""
    kinds = scores.groupingSets([[], *[[s] for s in slices]], *slices).agg(F.round(F.avg(value), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    full = (1 << len(slices)) - 1
    kind = F.when(F.col("gid") == full, "overall")
    name = F.when(F.col("gid") == full, F.lit("all"))
    for k, s in enumerate(slices):
        mask = full & ~(1 << (len(slices) - 1 - k))
        kind, name = kind.when(F.col("gid") == mask, s), name.when(F.col("gid") == mask, F.col(s).cast("string"))
    return kinds.select(kind.alias("slice_kind"), name.alias("slice"), "mean_value", "n")


def merged_spans(spans: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Gaps and islands: keys, s, e of spans (s, e) put together where they meet or touch."""
    w = W.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


DEPTHS = (1, 2, 4, 8, 10, 16, 32, 64)


def char_scores(hits: DataFrame, gold: DataFrame, depths: tuple[int, ...] = DEPTHS, raw_precision: bool = False) -> DataFrame:
    """query_id, k, char_recall, char_precision of hits (query_id, k, doc_id, s, e) against gold (query_id, doc_id, s, e).

    Every query of gold has a row for each of depths; one that found nothing scores 0.
    raw_precision divides by the hits' lengths as they are, else by their merged length.
    """
    g = merged_spans(gold, ("query_id", "doc_id"))
    h = merged_spans(hits.select("query_id", "k", "doc_id", "s", "e"), ("query_id", "k", "doc_id"))
    asked = g.groupBy("query_id").agg(F.sum(F.col("e") - F.col("s")).alias("gold_chars")).withColumn("k", F.explode(F.array(*map(F.lit, depths))))
    size = (hits if raw_precision else h).groupBy("query_id", "k").agg(F.sum(F.col("e") - F.col("s")).alias("hit_chars"))
    both = h.join(g.withColumnsRenamed({"s": "gs", "e": "ge"}), ["query_id", "doc_id"])
    inside = F.greatest(F.lit(0), F.least("e", "ge") - F.greatest("s", "gs"))
    found = both.groupBy("query_id", "k").agg(F.sum(inside).alias("found"))
    rows = asked.join(size, ["query_id", "k"], "left").join(found, ["query_id", "k"], "left")
    f = F.coalesce("found", F.lit(0))
    return rows.select("query_id", "k", (f / F.greatest("gold_chars", F.lit(1))).alias("char_recall"), (f / F.greatest(F.coalesce("hit_chars", F.lit(0)), F.lit(1))).alias("char_precision"))


def equal_weight(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Mean over the groups' means, next to the mean over rows."""
    rows = scores.groupBy(group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return rows.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("query_weighted"), F.round(F.avg("m"), 6).alias("equal_weighted"), F.count(F.lit(1)).alias("n_groups"))


def hits_at(firsts: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """k, hr, mrr: hit rate and reciprocal rank cut at k, from first ranks (query_id, first_rank)."""
    best = queries.select("query_id").distinct().join(firsts.groupBy("query_id").agg(F.min("first_rank").alias("r")), "query_id", "left")
    rows = best.select("query_id", "r", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    near = F.col("r") <= F.col("k")
    return rows.groupBy("k").agg(F.round(F.avg(F.when(near, 1.0).otherwise(0.0)), 6).alias("hr"), F.round(F.avg(F.when(near, 1 / F.col("r")).otherwise(0.0)), 6).alias("mrr"), F.count(F.lit(1)).alias("n"))


def percent(new: Column, old: Column) -> Column:
    """Relative change in percent, infinite from nothing."""
    return F.when(old == 0, F.when(new == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(new - old, old) * 100)


def lift(means: DataFrame, ours: str) -> DataFrame:
    """metric, best_base, value, delta, pct of one method over the best other one: means has method, metric, value."""
    base = means.where(F.col("method") != ours).groupBy("metric").agg(F.max("value").alias("base"), F.max_by("method", F.struct("value", "method")).alias("best_base"))
    rows = means.where(F.col("method") == ours).join(base, "metric")
    return rows.select("metric", "best_base", "value", F.round(F.col("value") - F.col("base"), 6).alias("delta"), F.round(percent(F.col("value"), F.col("base")), 6).alias("pct"))


def ablation(means: DataFrame) -> DataFrame:
    """Effects of a 2 x 2 design: means has chunking, retrieval (both 0 or 1), value."""
    cell = lambda c, r: F.max(F.when((F.col("chunking") == c) & (F.col("retrieval") == r), F.col("value")))
    r6 = lambda x, n: F.round(x, 6).alias(n)
    return means.agg(r6(cell(1, 0) - cell(0, 0), "chunking_effect"), r6(cell(0, 1) - cell(0, 0), "retrieval_effect"), r6(cell(1, 1) - cell(0, 0), "total_effect"), r6(cell(1, 1) - cell(1, 0) - cell(0, 1) + cell(0, 0), "interaction"))
