"""The three evaluations from end to end: sections of statutes, spans of contracts, three ways to cut a body of law."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunk, encode, judge, metrics, quality, retrieve, sampling, sections, stats
from folioscope.sources import files, scratch, sinks

OURS = "Structural + Hybrid"
BASELINES = ("Recursive + Dense", "BM25 Only", "Naive Hybrid")


def numbered(chunks: DataFrame, name: str) -> DataFrame:
    """chunks with a chunk_id, which is fixed by writing them."""
    return scratch.written(chunks.withColumn("chunk_id", F.monotonically_increasing_id()), name)


def runs(recursive: DataFrame, structural: DataFrame, queries: DataFrame, encoder: encode.Encoder, k: int, ablation: bool = False, cache: str | None = None) -> dict[str, DataFrame]:
    """A run of k hits for each method, with the hits' chunks; queries have query_id, query.

    Each pool is encoded once, whatever the number of methods that use its vectors.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("query").alias("text"))
    cache = cache or scratch.path(spark, "vectors")
    vectors = lambda pool: scratch.written(encode.cached(pool, "chunk_id", encoder, cache), "vectors")
    q = scratch.written(encode.encoded(asked, "query_id", encoder), "queries")
    a, b = vectors(recursive), vectors(structural)
    found = {
        "Recursive + Dense": (retrieve.dense(a, q, k), recursive),
        "BM25 Only": (retrieve.bm25(recursive, asked, k), recursive),
        "Naive Hybrid": (retrieve.hybrid(a, q, recursive, asked, k), recursive),
        OURS: (retrieve.hybrid(b, q, structural, asked, k), structural),
    }
    if ablation:
        found |= {"Structural + Dense": (retrieve.dense(b, q, k), structural), "Structural + BM25": (retrieve.bm25(structural, asked, k), structural)}
    return {name: scratch.written(retrieve.looked_up(run, pool), "run") for name, (run, pool) in found.items()}


def _together(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("method"), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out


def _compared(scores: DataFrame, value: str, bases=BASELINES, ours: str = OURS) -> DataFrame:
    """comparison, query_id, a, b: scores (method, query_id, value) of ours beside each base's."""
    a = scores.where(F.col("method") == ours).select("query_id", F.col(value).alias("a"))
    b = scores.where(F.col("method").isin(*bases)).select(F.concat(F.lit("vs "), "method").alias("comparison"), "query_id", F.col(value).alias("b"))
    return b.join(a, "query_id").select("comparison", "query_id", "a", "b")


def section_experiment(docs: DataFrame, queries: DataFrame, encoder: encode.Encoder | None = None, chunk_size: int = 512, overlap: float = 0.15, k: int = 10, ablation: bool = False, chunk_quality: bool = False, compat: bool = False) -> dict:
    """Parse docs (doc_id, text), cut them two ways, search, judge by the sections that hits mention, measure, test.

    queries: as files.section_queries gives them.  compat: contents end with their
    first line and relevance is cumulative.  Gives small tables: metrics (by method),
    by_type, by_difficulty, significance, and quality if asked for.
    """
    encoder = encoder or encode.HashedWords()
    d = sections.parsed(docs, compat)
    refs = chunk.top_references(sections.edges(d.sections), d.sections)
    titled = d.sections.join(d.titles.withColumnRenamed("title", "doc_title"), "doc_id")
    struc = chunk.structural(titled, refs, F.col("doc_title"))
    recursive, structural = numbered(chunk.recursive(docs, chunk_size, overlap), "recursive"), numbered(chunk.structural_sized(struc, chunk_size, overlap), "structural")
    out: dict = {"quality": quality.report(docs, d.sections, d.edges, recursive, structural, encoder, compat)} if chunk_quality else {}
    queries = scratch.written(queries, "asked")
    expected = queries.select("query_id", F.explode("expected_sections").alias("section_no"))
    rel = {}
    for name, run in runs(recursive, structural, queries, encoder, k, ablation).items():
        said = run.select("query_id", "rank", F.explode(T.mentioned_sections(F.col("text"), compat)).alias("m")).select("query_id", "rank", F.lower("m").alias("m"))
        hit = said.join(expected.select("query_id", F.lower("section_no").alias("m")).distinct(), ["query_id", "m"], "left_semi").select("query_id", "rank").distinct().withColumn("rel", F.lit(1))
        full = judge.spine(queries, hit, k)
        rel[name] = judge.cumulative(full) if compat else full
    rel = scratch.written(_together(rel), "relevance")
    per = metrics.per_query(rel, by=("method",)).join(metrics.average_precision(rel, by=("method",)), ["method", "query_id"]).join(queries.select("query_id", "qtype", "difficulty"), "query_id")
    per = scratch.written(per, "scores")
    mean = lambda *cols: [F.avg(c).alias(n) for c, n in cols] + [F.count(F.lit(1)).alias("n")]
    each = (("r_at_1", "r_at_1"), ("r_at_5", "r_at_5"), ("r_at_10", "r_at_10"), ("rr", "mrr"), ("ap", "map_10"))
    return out | {
        "metrics": metrics.all_metrics(rel, ("method",)),
        "by_type": per.groupBy("method", "qtype").agg(*mean(*each)),
        "by_difficulty": per.groupBy("method", "difficulty").agg(*mean(("r_at_5", "r_at_5"))),
        "significance": stats.significance(_compared(per, "r_at_5"), intervals=stats.row_bootstrap),
    }


def span_experiment(spark: SparkSession, data_dir: str, n_queries: int = 776, encoder: encode.Encoder | None = None, size: int = 500, chunk_size: int = 512, overlap: float = 0.15, least: float = 0.5, depths: tuple[int, ...] = metrics.DEPTHS, compat: bool = False, cache: str | None = None) -> dict:
    """Queries with gold spans against a corpus of text files, from data_dir, as files.span_queries and text_corpus read it.

    A sample of n_queries, a document's queries together; only documents that these
    refer to; fixed and structural chunks; four methods, retrieved once at the largest
    of depths.  Gives metrics, char_metrics, by_subdataset, equal_weight, significance,
    and chunk_chars, as the two pools' chunks are of unlike length.
    """
    encoder = encoder or encode.HashedWords()
    queries = files.span_queries(spark, data_dir)
    first = F.coalesce(F.get(F.col("snippets"), F.lit(0))["file_path"], F.lit(""))
    queries = scratch.written(sampling.stratified(queries.withColumn("first_path", first), "subdataset", "first_path", "query_id", n_queries, seeded=compat).drop("first_path"), "asked")
    docs = scratch.written(files.text_corpus(spark, data_dir, files.referenced(queries)), "corpus")
    pools = chunk.pools(docs, size, chunk_size, overlap, strict=not compat)
    fixed, structural = (numbered(pools.where(F.col("method") == m).drop("method"), m) for m in ("fixed", "structural"))
    # paths are matched once, so that the rest joins on equality
    paths = docs.select(F.col("path").alias("doc_id"), "stem")
    spans = files.spans(queries)
    exact = spans.join(paths.select("doc_id", F.col("doc_id").alias("path")), "path").select("query_id", "doc_id", "g_start", "g_end", "answer", "path")
    by_stem = spans.join(exact.select("path").distinct(), "path", "left_anti").withColumn("stem", T.stem(F.col("path"))).join(paths, "stem").select("query_id", "doc_id", "g_start", "g_end", "answer", "path")
    gold = scratch.written(exact.unionByName(by_stem), "gold")
    k = max(depths)
    rel, chars = {}, {}
    for name, run in runs(fixed, structural, queries, encoder, k, cache=cache).items():
        overlapping = judge.span_relevance(run, gold.select("query_id", "doc_id", "g_start", "g_end"), least)
        answered = judge.answer_matches(run, gold.select("query_id", "answer", "doc_id"))
        both = overlapping.unionByName(answered).groupBy("query_id", "rank").agg(F.max("rel").alias("rel"))
        rel[name] = judge.spine(queries, both, k)
        hits = retrieve.at_depths(run, depths).select("query_id", "k", "doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))
        found = metrics.char_scores(hits, gold.select("query_id", "doc_id", F.col("g_start").alias("s"), F.col("g_end").alias("e")), depths, raw_precision=compat)
        spine = queries.select("query_id", F.explode(F.array(*map(F.lit, depths))).alias("k"))
        chars[name] = spine.join(found, ["query_id", "k"], "left").na.fill(0.0)
    kinds = queries.select("query_id", "subdataset")
    rel, chars = scratch.written(_together(rel).join(kinds, "query_id"), "relevance"), scratch.written(_together(chars).join(kinds, "query_id"), "chars")
    sub = chars.groupBy("method", "subdataset", "k").agg(F.avg("char_recall").alias("char_recall"), F.avg("char_precision").alias("char_precision"), F.count(F.lit(1)).alias("n"))
    per = scratch.written(metrics.per_query(rel, by=("method",)), "scores")
    tested = _compared(per, "r_at_5") if compat else _compared(chars.where("k = 8"), "char_recall")
    sizes = lambda df, n: df.agg(F.lit(n).alias("pool"), F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean_chars"))
    return {
        "metrics": metrics.all_metrics(rel.drop("subdataset"), ("method",)),
        "char_metrics": chars.groupBy("method", "k").agg(F.avg("char_recall").alias("char_recall"), F.avg("char_precision").alias("char_precision")),
        "by_subdataset": metrics.all_metrics(rel, ("method", "subdataset")),
        "char_by_subdataset": sub,
        "equal_weight": sub.groupBy("method", "k").agg(F.avg("char_recall").alias("char_recall_equal_weight")),
        "significance": stats.significance(tested, intervals=stats.row_bootstrap),
        "chunk_chars": sizes(fixed, "fixed").unionByName(sizes(structural, "structural")),
    }


def statute_experiment(spark: SparkSession, laws_dir: str, queries_csv: str, naive_nodes: str, naive_mapping: str, golden_nodes: str, encoder: encode.Encoder | None = None, ks: tuple[int, ...] = (1, 5, 10, 20), cache: str | None = None) -> dict:
    """Three ways to cut a body of law: given line chunks, sections, sections with breadcrumb and references; dense search alone.

    Gives hits: pool, slice (all, covered, xref, plain), k, hr, mrr, n; lift: how far
    augmentation is over plain sections at 5, by slice; counts.
    """
    encoder = encoder or encode.HashedWords()
    laws = scratch.written(files.law_sections(spark, laws_dir), "laws")
    queries = scratch.written(files.law_queries(spark, queries_csv, laws), "asked")
    naive, golden = files.nodes(spark, naive_nodes), files.nodes(spark, golden_nodes)
    augmented = numbered(chunk.statute_augmented(laws).select(F.col("section_id").alias("node_id"), "text"), "augmented")
    mapped = scratch.written(files.gold_map(spark, naive_mapping), "mapping")
    bridges = {"naive": naive.join(mapped, "node_id").select("chunk_id", "gold_id"), "sections": golden.select("chunk_id", F.col("node_id").alias("gold_id")), "augmented": augmented.select("chunk_id", F.col("node_id").alias("gold_id"))}
    expected = queries.select("query_id", F.explode("expected_ids").alias("gold_id"))
    slices = {"all": queries.select("query_id"), "covered": judge.answerable(expected, mapped), "xref": queries.where("has_xref").select("query_id"), "plain": queries.where("not has_xref").select("query_id")}
    q = scratch.written(encode.encoded(queries, "query_id", encoder, "query"), "queries")
    cache = cache or scratch.path(spark, "vectors")
    hits = None
    for pool, chunks in (("naive", naive), ("sections", golden), ("augmented", augmented)):
        run = retrieve.dense(encode.cached(chunks, "chunk_id", encoder, cache), q, max(ks))
        firsts = scratch.written(judge.novel_gold(run, bridges[pool], expected), "firsts")
        for name, asked in slices.items():  # the subsets are rows of one run
            if name == "covered" and pool != "naive":
                continue
            got = metrics.hits_at(firsts.join(asked, "query_id", "left_semi"), asked, ks).select(F.lit(pool).alias("pool"), F.lit(name).alias("slice"), "k", "hr", "mrr", "n")
            hits = got if hits is None else hits.unionByName(got)
    hits = scratch.written(hits, "hits")
    at5 = hits.where("k = 5 and slice in ('xref', 'plain')").groupBy("slice").pivot("pool", ["augmented", "sections"]).agg(F.first("hr"))
    counts = {name: df.count() for name, df in slices.items()} | {"naive_chunks": naive.count(), "sections": laws.count(), "augmented": augmented.count()}
    return {"hits": hits, "lift": at5.select("slice", (F.col("augmented") - F.col("sections")).alias("lift")), "counts": counts}


def saved(spark: SparkSession, results: dict, folder: str, name: str) -> str:
    """Writes an experiment's tables as one JSON file; its path."""
    value = {k: sinks.records(v) if isinstance(v, DataFrame) else v for k, v in results.items()}
    return sinks.write_json(spark, value, folder, name)
