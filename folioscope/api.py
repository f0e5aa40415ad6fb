"""The operators as objects that keep their settings, for those who'd rather not pass tables around."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunk, metrics, quality, retrieve, sections, stats
from folioscope.operators.encode import Encoder, HashedWords, encoded
from folioscope.sources import files, scratch, sinks


@dataclass
class DocumentParser:
    """compat: a section's content ends with its first line."""

    compat: bool = False

    def parse(self, docs: DataFrame) -> sections.Documents:
        """Documents (doc_id, text)."""
        return sections.parsed(docs, self.compat)

    def parse_pdf(self, spark: SparkSession, path: str) -> sections.Documents:
        """PDF files; doc_id is their path."""
        pages = files.pages(spark, path)
        return self.parse(sections.assembled(pages, "path", "page_no", "text").withColumnRenamed("path", "doc_id"))


@dataclass
class RecursiveChunker:
    chunk_size: int = 512
    overlap: float = 0.1
    separators: tuple[str, ...] | None = None

    def chunk(self, docs: DataFrame) -> DataFrame:
        return chunk.recursive(docs, self.chunk_size, self.overlap, self.separators or chunk.SEPARATORS)


@dataclass
class StructureChunker:
    chunk_size: int = 512
    overlap: float = 0.15
    add_breadcrumbs: bool = True
    resolve_cross_refs: bool = True
    max_cross_refs: int = 3
    cross_ref_summary_length: int = 200

    def chunk(self, documents: sections.Documents) -> DataFrame:
        s = documents.sections
        refs = chunk.top_references(sections.edges(s), s, self.max_cross_refs, self.cross_ref_summary_length) if self.resolve_cross_refs else None
        titled = s.join(documents.titles.withColumnRenamed("title", "doc_title"), "doc_id")
        return chunk.structural_sized(chunk.structural(titled, refs, F.col("doc_title"), self.add_breadcrumbs), self.chunk_size, self.overlap)

    @staticmethod
    def estimate_tokens(text: str) -> int:
        return len(text) // 4

    @staticmethod
    def breadcrumb_stats(chunks: DataFrame) -> DataFrame:
        return chunk.breadcrumb_stats(chunks)


@dataclass
class _Retriever:
    """chunks: chunk_id, text."""

    chunks: DataFrame
    encoder: Encoder = field(default_factory=HashedWords)

    def __post_init__(self):
        """Retrievers with an index make it here."""

    def _queries(self, queries: str | DataFrame) -> DataFrame:
        return self.chunks.sparkSession.createDataFrame([(0, queries)], "query_id long, text string") if isinstance(queries, str) else queries

    def retrieve(self, queries: str | DataFrame, k: int = 10) -> DataFrame:
        """query_id, rank, chunk_id, score, text for a text, or a table of query_id and text."""
        return retrieve.looked_up(self._run(self._queries(queries), k), self.chunks.select("chunk_id", "text"))


class DenseRetriever(_Retriever):
    """Encodes the chunks once."""

    def __post_init__(self):
        self.vectors = scratch.written(encoded(self.chunks, "chunk_id", self.encoder), "vectors")

    def _run(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieve.dense(self.vectors, encoded(queries, "query_id", self.encoder), k)


class SparseRetriever(_Retriever):
    def _run(self, queries: DataFrame, k: int) -> DataFrame:
        return retrieve.bm25(self.chunks, queries, k)


@dataclass
class HybridRetriever(DenseRetriever):
    """Without an encoder, lexical search alone."""

    encoder: Encoder | None = field(default_factory=HashedWords)
    rrf_k: int = 60

    def __post_init__(self):
        self.vectors = None
        if self.encoder is not None:
            super().__post_init__()

    def _run(self, queries: DataFrame, k: int) -> DataFrame:
        asked = None if self.vectors is None else encoded(queries, "query_id", self.encoder)
        return retrieve.hybrid(self.vectors, asked, self.chunks, queries, k, self.rrf_k)


class RetrievalMetrics:
    """Over relevance rows (query_id, rank, rel)."""

    @staticmethod
    def _mean(rows: DataFrame, column: str) -> float:
        return rows.agg(F.avg(column)).first()[0] or 0.0

    def recall_at_k(self, rel: DataFrame, k: int) -> float:
        return self._mean(metrics.per_query(rel, (k,)), f"r_at_{k}")

    def precision_at_k(self, rel: DataFrame, k: int) -> float:
        return self._mean(metrics.per_query(rel, (k,)), f"p_at_{k}")

    def mrr(self, rel: DataFrame) -> float:
        return self._mean(metrics.per_query(rel), "rr")

    def map_at_k(self, rel: DataFrame, k: int = 10) -> float:
        return self._mean(metrics.average_precision(rel, k), "ap")

    def ndcg(self, rel: DataFrame, k: int = 10) -> float:
        return self._mean(metrics.ndcg(rel, k), "ndcg")

    def compute_all(self, rel: DataFrame) -> dict:
        return sinks.records(metrics.all_metrics(rel))[0]

    def per_query_scores(self, rel: DataFrame, k: int = 5) -> DataFrame:
        """query_id, recall, rr, ap."""
        return metrics.per_query(rel, (k,)).join(metrics.average_precision(rel, k), "query_id").select("query_id", F.col(f"r_at_{k}").alias("recall"), "rr", "ap")

    def format_table_row(self, name: str, values: dict[str, float], best: dict[str, float] | None = None) -> str:
        """A LaTeX line; values over those of best are bold."""
        cells = [f"\\textbf{{{v:.3f}}}" if best and v > best.get(m, float("inf")) else f"{v:.3f}" for m, v in values.items()]
        return " & ".join([name, *cells]) + r" \\"


class StatisticalTests:
    """Over paired scores (comparison, query_id, a, b)."""

    wilcoxon_test = staticmethod(lambda pairs: stats.with_p(stats.wilcoxon(pairs)))
    benjamini_hochberg = staticmethod(stats.benjamini_hochberg)
    bootstrap_ci = staticmethod(stats.row_bootstrap)
    effect_size_cohens_d = staticmethod(stats.cohens_d)

    @staticmethod
    def run_full_significance_table(pairs: DataFrame, seed: int = 42) -> DataFrame:
        return stats.significance(pairs, intervals=lambda p, by: stats.row_bootstrap(p, by, seed=seed))

    full_comparison_block = run_full_significance_table


@dataclass
class ChunkQuality:
    docs: DataFrame
    documents: sections.Documents
    recursive_chunks: DataFrame
    structural_chunks: DataFrame
    encoder: Encoder | None = None
    compat: bool = False

    def boundary_precision(self, chunks: DataFrame) -> float:
        return quality.boundaries(chunks, self.docs, self.documents.sections, compat=self.compat).first()["share"]

    def cross_ref_preservation_rate(self, chunks: DataFrame) -> DataFrame:
        return quality.reference_preservation(self.documents.edges, chunks, self.documents.sections)

    def chunk_count_efficiency(self) -> DataFrame:
        return quality.efficiency(quality.covered(self.recursive_chunks), quality.covered(self.structural_chunks), self.documents.sections)

    def intra_chunk_coherence(self, chunks: DataFrame, sample_size: int = 200) -> float:
        if self.encoder is None:
            return float("nan")
        found = quality.coherence(chunks, self.encoder, sample_size).first()["coherence"]
        return float("nan") if found is None else found

    def run_full_analysis(self) -> dict:
        return quality.report(self.docs, self.documents.sections, self.documents.edges, self.recursive_chunks, self.structural_chunks, self.encoder, self.compat)

    @staticmethod
    def print_table(report: dict) -> None:
        rows = [{"measure": "boundary precision, %"} | report["boundary_precision"], {"measure": "references preserved, %"} | {m: v["rate_pct"] for m, v in report["cross_ref_preservation"].items()}]
        rows += [{"measure": "chunks"} | {m: report["chunk_count_efficiency"][m]["chunk_count"] for m in ("recursive", "structural")}, {"measure": "coherence"} | report["intra_chunk_coherence"]]
        print(sinks.table(rows, ["measure", "recursive", "structural"], "Chunk quality"))


format_p_value = T.format_p
