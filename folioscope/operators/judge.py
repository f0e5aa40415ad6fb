"""Relevance judgements as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T


#: Items in one block, when items are too short to be joined on their words.
ITEM_BLOCK = 5000
#: Items up to which they go to the documents.
BROADCAST_ROWS = 500_000


def passages(items: DataFrame, docs: DataFrame, words: int = 5) -> DataFrame:
    """item_id, doc_id, g_start, g_end: where an item's text first occurs in a document, as it is.

    A text that occurs has its inner words whole in the document, so two neighbours
    of those are what both are joined on, by their hash, and only such pairs are searched.
    Items with too few inner words are held against each document a block at a time,
    within its row, so that only what is found becomes rows.

    Up to BROADCAST_ROWS items go to the documents, each of which is searched where
    it is read; beyond, documents with a pair of an item's words are shuffled.
    """
    items = items.select("item_id", F.col("text").alias("passage"), T.words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    # of a passage's inner pairs of words the longest, which is likely a rare one
    inner = F.transform(F.sequence(F.lit(2), F.lit(words)), lambda i: F.struct(F.element_at("w", i).alias("a"), F.element_at("w", i + 1).alias("b")))
    longest = F.element_at(F.sort_array(F.transform(inner, lambda x: F.struct((F.length(x["a"]) + F.length(x["b"])).alias("n"), x.alias("x")))), -1)["x"]
    long = items.where(F.col("n_words") >= words + 2).select("item_id", "passage", F.xxhash64(longest["a"], longest["b"]).alias("gram"))
    short = items.where((F.col("n_words") < words + 2) & (F.col("passage") != "")).select("item_id", "passage")
    docs = docs.where("text is not null").select("doc_id", "text")
    # a row for each distinct pair of words; the array is a column before that, so that rows which no item asks for are never copied,
    # and the rows are outer ones, or Spark would make the array once more to filter by its size
    grams = docs.withColumn("w", T.words(F.col("text"))).select("doc_id", "text", F.array_distinct(F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, b))).alias("grams"))
    if long.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = grams.select("doc_id", "text", F.explode_outer("grams").alias("gram")).join(F.broadcast(long), "gram").where(F.col("text").contains(F.col("passage")))
    else:
        pairs = grams.select("doc_id", F.explode_outer("grams").alias("gram")).join(long, "gram").select("doc_id", "item_id", "passage")
        met = docs.join(pairs, "doc_id")
    met = met.select("doc_id", "text", "item_id", "passage")
    if n := short.count():
        block = F.pmod(F.xxhash64("item_id"), F.lit(-(-n // ITEM_BLOCK)))
        blocks = short.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "passage")).alias("few"))
        found = docs.crossJoin(F.broadcast(blocks)).select("doc_id", "text", F.filter("few", lambda x: F.col("text").contains(x["passage"])).alias("few"))
        met = met.unionByName(found.select("doc_id", "text", F.inline("few")))
    at = (F.instr(F.col("text"), F.col("passage")) - 1).alias("g_start")
    return met.select("item_id", "doc_id", at, F.length("passage").alias("n")).where("g_start >= 0").select("item_id", "doc_id", "g_start", (F.col("g_start") + F.col("n")).alias("g_end"))


def span_relevance(run: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """query_id, rank, rel: does a hit (doc_id, char_start, char_end) cover least of a gold span of its document?

    An interval join with the document as its key, so that it is a hash join.
    """
    share = F.greatest(F.lit(0), F.least("char_end", "g_end") - F.greatest("char_start", "g_start")) / (F.col("g_end") - F.col("g_start"))
    hit = run.join(gold.where("g_end > g_start"), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id", "rank").agg(F.max(F.when(share >= least, 1).otherwise(0)).alias("rel"))


def spine(queries: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """Every query has ranks 1 to k; what isn't there is not relevant."""
    ranks = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return ranks.join(relevance, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))


def cumulative(relevance: DataFrame) -> DataFrame:
    """1 from the first hit on."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return relevance.select("query_id", "rank", F.max("rel").over(w).alias("rel"))


def first_mentions(run: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, section_no, first_rank: the first hit whose text mentions an expected section, null if none does.

    Numbers are extracted once for each hit and joined on equality.
    """
    said = run.select("query_id", "rank", F.explode(T.mentioned_sections(F.col("text"))).alias("section_no"))
    firsts = said.groupBy("query_id", F.upper("section_no").alias("section_no")).agg(F.min("rank").alias("first_rank"))
    return expected.select("query_id", F.upper("section_no").alias("section_no")).join(firsts, ["query_id", "section_no"], "left")


def answer_matches(hits: DataFrame, answers: DataFrame, least: int = 30, head: int = 100) -> DataFrame:
    """query_id, rank, rel: hits of other paths that hold the first head characters of an answer of over least."""
    a = answers.where(F.length("answer") > least).select("query_id", F.substring("answer", 1, head).alias("start"), F.col("doc_id").alias("gold_doc"))
    hit = hits.join(a, "query_id", "left")
    ok = F.col("text").contains(F.col("start")) & (F.col("doc_id") != F.col("gold_doc"))
    return hit.groupBy("query_id", "rank").agg(F.max(F.when(ok, 1).otherwise(0)).alias("rel"))


def novel_gold(run: DataFrame, bridge: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, gold_id, first_rank: a gold id counts where the list first has it."""
    hits = run.join(bridge, "chunk_id").join(expected, ["query_id", "gold_id"], "left_semi")
    return hits.groupBy("query_id", "gold_id").agg(F.min("rank").alias("first_rank"))


def answerable(expected: DataFrame, bridge: DataFrame) -> DataFrame:
    """Queries with a gold id that some chunk maps to."""
    return expected.join(bridge.select("gold_id").distinct(), "gold_id", "left_semi").select("query_id").distinct()


def by_reference(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, has_xref: does any expected id refer to another?"""
    sources = edges.select(F.col("src_id").alias("gold_id")).distinct().withColumn("x", F.lit(1))
    return expected.join(sources, "gold_id", "left").groupBy("query_id").agg((F.max(F.coalesce("x", F.lit(0))) == 1).alias("has_xref"))
