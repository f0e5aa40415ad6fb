"""Command lines: python -m folioscope sections | spans | quality | statutes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import api
from folioscope.operators import sections
from folioscope.operators.encode import HashedWords
from folioscope.plans import pipelines
from folioscope.sources import files, sinks


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a PDF file or a text file."""
    if path.lower().endswith(".pdf"):
        return sections.assembled(files.pages(spark, path), "path", "page_no", "text").withColumnRenamed("path", "doc_id")
    return files.whole(spark, path).select(F.col("path").alias("doc_id"), F.col("value").alias("text"))


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--output_dir", default="results")
        c.add_argument("--compat", action="store_true")
        c.add_argument("--encoder_dim", type=int, default=256)
        return c

    c = command("sections", "queries labelled with sections, over one statute")
    c.add_argument("--document", required=True)
    c.add_argument("--queries", required=True)
    c.add_argument("--chunk_size", type=int, default=512)
    c.add_argument("--ablation", action="store_true")
    c.add_argument("--chunk_quality", action="store_true")
    c = command("spans", "queries labelled with spans, over contracts")
    c.add_argument("--data_dir", required=True)
    c.add_argument("--n_queries", type=int, default=776)
    c.add_argument("--chunk_size", type=int, default=512)
    c.add_argument("--cache", default=None)
    c = command("quality", "how well two chunkers follow a document's structure")
    c.add_argument("--document", required=True, nargs="+")
    c.add_argument("--chunk_size", type=int, default=512)
    c.add_argument("--use_encoder", action="store_true")
    c = command("statutes", "three ways to cut a body of law")
    for name in ("laws", "queries", "naive_nodes", "naive_mapping", "golden_nodes"):
        c.add_argument(f"--{name}", required=True)
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    encoder = HashedWords(a.encoder_dim)
    for path in [a.data_dir] if a.command == "spans" else a.document if a.command == "quality" else []:
        if not files.exists(spark, path):
            print(f"{path} is not there", file=sys.stderr)
            return 1
    if a.command == "sections":
        results = pipelines.section_experiment(documents(spark, a.document), files.section_queries(spark, a.queries), encoder, a.chunk_size, ablation=a.ablation, chunk_quality=a.chunk_quality, compat=a.compat)
        rows = sinks.records(results["metrics"])
        print(sinks.table(rows, ["method", "r_at_1", "r_at_5", "r_at_10", "mrr", "ndcg_10", "map_10"], "Retrieval"))
        print("\n".join(filter(None, (sinks.improvements(rows, pipelines.OURS, "r_at_5"), sinks.ablation(rows)))))
        print(sinks.latex(rows, "method", ["r_at_1", "r_at_5", "r_at_10", "mrr"]))
    elif a.command == "spans":
        results = pipelines.span_experiment(spark, a.data_dir, a.n_queries, encoder, chunk_size=a.chunk_size, compat=a.compat, cache=a.cache)
        print(sinks.table(sinks.records(results["metrics"]), ["method", "r_at_1", "r_at_5", "r_at_10", "mrr"], "Retrieval"))
        print(sinks.table(sinks.records(results["char_metrics"].orderBy("method", "k")), ["method", "k", "char_recall", "char_precision"], "Characters"))
        print(sinks.table(sinks.records(results["chunk_chars"]), ["pool", "n", "mean_chars"], "Chunks"))
    elif a.command == "quality":
        results = {}
        for path in a.document:
            docs = documents(spark, path)
            parsed = api.DocumentParser(a.compat).parse(docs)
            results[path] = api.ChunkQuality(docs, parsed, api.RecursiveChunker(a.chunk_size, 0.15).chunk(docs), api.StructureChunker(a.chunk_size).chunk(parsed), encoder if a.use_encoder else None, a.compat).run_full_analysis()
            api.ChunkQuality.print_table(results[path])
    else:
        results = pipelines.statute_experiment(spark, a.laws, a.queries, a.naive_nodes, a.naive_mapping, a.golden_nodes, encoder)
        print(sinks.table(sinks.records(results["hits"].orderBy("pool", "slice", "k")), ["pool", "slice", "k", "hr", "mrr", "n"], "Hits"))
    if "significance" in results:
        print(sinks.table(sinks.records(results["significance"]), ["comparison", "p_text", "d", "low", "high", "mean_diff", "pct", "effect"], "Significance"))
    print("written to", pipelines.saved(spark, results, a.output_dir, a.command))
    return 0


if __name__ == "__main__":
    sys.exit(main())
