"""How well chunks follow a document's structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources import scratch

from .encode import Encoder, encoded


def boundary_precision(chunks: DataFrame, sections: DataFrame, near: int = 80) -> DataFrame:
    """doc_id, n, aligned: chunks that begin within near characters of a section's start.

    Starts fall into cells of near characters, and a chunk looks in its own cell
    and both next to it, so it meets few sections however many a document has.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    starts = sections.select("doc_id", F.col("char_start").alias("pos"), cell("char_start").alias("cell"))
    rows = chunks.select("doc_id", "chunk_id", "char_start", F.explode(F.array(cell("char_start") - 1, cell("char_start"), cell("char_start") + 1)).alias("cell"))
    met = rows.join(starts, ["doc_id", "cell"]).where(F.abs(F.col("pos") - F.col("char_start")) <= near).select("chunk_id").distinct()
    return chunks.join(met.withColumn("hit", F.lit(1)), "chunk_id", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("aligned"))


def boundary_precision_by_text(chunks: DataFrame, docs: DataFrame, sections: DataFrame, near: int = 80) -> DataFrame:
    """doc_id, n, aligned, as above, of chunks whose place isn't known: it is where their first near characters first occur.

    A breadcrumb in brackets at a chunk's head is passed over; blank chunks and those
    that don't occur are left out.
    """
    head = F.when(F.col("text").rlike(r"^\[[^\]]*\]"), F.regexp_replace("text", r"(?U)^\[[^\]]*\]\s*", "")).otherwise(F.col("text"))
    rows = _numbered(chunks).select("doc_id", "chunk_id", T.strip(F.substring(head, 1, near)).alias("head")).where("head <> ''")
    met = rows.join(docs.select("doc_id", F.col("text").alias("_whole")), "doc_id").select("doc_id", "chunk_id", (F.instr("_whole", F.col("head")) - 1).alias("char_start")).where("char_start >= 0")
    return boundary_precision(met, sections, near)


HEADER = r"(?im)^\[.*Section\s+\d+|^Section\s+\d+|^\[GDPR.*Article\s+\d+|^Article\s+\d+"


def by_title(chunks: DataFrame) -> DataFrame:
    """n, aligned: chunks whose text, stripped, opens with a section's or article's heading."""
    opens = F.regexp_extract(F.split(T.strip(F.col("text")), "\n")[0], HEADER, 0) != ""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(opens.cast("int")), F.lit(0)).alias("aligned"))


def boundaries(chunks: DataFrame, docs: DataFrame, sections: DataFrame, near: int = 80, compat: bool = False) -> DataFrame:
    """share: of chunks, those that begin at a section.

    By place where every section has one, else by title.  Chunks with a char_start
    are measured by it, others by their text; compat takes chunks with a section_no
    as aligned, unmeasured.
    """
    share = lambda df: df.agg(F.coalesce(F.try_divide(F.sum("aligned"), F.sum("n")), F.lit(0.0)).alias("share"))
    if compat and "section_no" in chunks.columns:
        return chunks.agg(F.coalesce(F.avg(F.col("section_no").isNotNull().cast("double")), F.lit(0.0)).alias("share"))
    placed = sections.agg(F.bool_and(F.col("char_start").isNotNull()).alias("all")).first()["all"]
    if not placed:
        return share(by_title(chunks))
    return share(boundary_precision(_numbered(chunks), sections, near) if "char_start" in chunks.columns else boundary_precision_by_text(chunks, docs, sections, near))


def covered(chunks: DataFrame) -> DataFrame:
    """doc_id, section_no: a chunk's section, by its number or its breadcrumb."""
    number = F.coalesce(F.col("section_no").cast("string") if "section_no" in chunks.columns else F.lit(None).cast("string"), F.nullif(F.regexp_extract("breadcrumb", r"(?i)Section\s+(\d+[A-Z]?)", 1), F.lit("")) if "breadcrumb" in chunks.columns else F.lit(None).cast("string"))
    return chunks.select("doc_id", number.alias("section_no"))


def report(docs: DataFrame, sections: DataFrame, edges: DataFrame, first: DataFrame, second: DataFrame, encoder: Encoder | None = None, compat: bool = False) -> dict:
    """All four measures of two methods' chunks, in percent with one place (coherence: three), as one small dict."""
    out: dict = {"boundary_precision": {}, "cross_ref_preservation": {}, "intra_chunk_coherence": {}}
    for name, chunks in (("recursive", first), ("structural", second)):
        out["boundary_precision"][name] = round(boundaries(chunks, docs, sections, compat=compat).first()["share"] * 100, 1)
        kept = reference_preservation(edges, chunks, sections).first() if "section_no" in chunks.columns else {"n_edges": edges.select("doc_id", "src_no", "dst_no").distinct().count(), "kept": 0}
        out["cross_ref_preservation"][name] = {"rate_pct": round(kept["kept"] / max(kept["n_edges"], 1) * 100, 1), "preserved": kept["kept"], "total": kept["n_edges"]}
        found = coherence(_numbered(chunks), encoder).first()["coherence"] if encoder is not None else None
        out["intra_chunk_coherence"][name] = "N/A" if found is None else round(found, 3)
    e = efficiency(covered(first), covered(second), sections).first()
    one = lambda n: {"chunk_count": e[f"{n}_chunks"], "sections_covered": e[f"{n}_covered"], "coverage_pct": round(e[f"{n}_covered"] / max(e["total"], 1) * 100, 1), "chunks_per_coverage_pct": round(e[f"{n}_per_pct"] or 0.0, 1)}
    ratio = (e["first_per_pct"] or 0.0) / e["second_per_pct"] if e["second_per_pct"] else 1.0
    out["chunk_count_efficiency"] = {"recursive": one("first"), "structural": one("second"), "total_sections": e["total"], "efficiency_ratio": round(ratio, 2), "chunk_reduction_pct": round(e["reduction_pct"] or 0.0, 1)}
    return out


def _numbered(chunks: DataFrame) -> DataFrame:
    return chunks if "chunk_id" in chunks.columns else chunks.withColumn("chunk_id", F.xxhash64(*chunks.columns[:3], "text"))


def titled(chunks: DataFrame, header: str = r"^\s*(?:\[[^\]]*\]\s*)?(?:Section|Article)\s+\d+") -> DataFrame:
    """n, titled: chunks that begin with a heading."""
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("text").rlike(header).cast("int")).alias("titled"))


def reference_preservation(edges: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """n_edges, kept: references (doc_id, src_no, dst_no) whose source's chunk names the target by number or title."""
    pairs = scratch.written(edges.select("doc_id", "src_no", "dst_no").distinct(), "pairs")  # read twice
    # titles come to the pairs first, so that a chunk's text is shuffled once at most
    rows = pairs.join(sections.select("doc_id", F.col("section_no").cast("string").alias("dst_no"), "title"), ["doc_id", "dst_no"])
    rows = rows.join(chunks.select("doc_id", F.col("section_no").cast("string").alias("src_no"), "text"), ["doc_id", "src_no"])
    by_title = (F.col("title") != "") & F.lower("text").contains(F.lower("title"))
    # numbers are extracted once and compared, so no pattern depends on the row
    said = F.transform(T.mentioned_sections(F.col("text")), F.lower)
    by_number = F.array_contains(said, F.lower("dst_no"))
    kept = rows.where(by_title | by_number).select("doc_id", "src_no", "dst_no").distinct()
    return pairs.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))


def efficiency(first: DataFrame, second: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks for each percent of sections covered, of two methods: chunks have doc_id, section_no (null: none)."""
    total = sections.agg(F.count(F.lit(1)).alias("total"))

    def one(chunks: DataFrame, name: str) -> DataFrame:
        return chunks.agg(F.count(F.lit(1)).alias(f"{name}_chunks"), F.count_distinct(F.when(F.col("section_no").isNotNull(), F.struct("doc_id", "section_no"))).alias(f"{name}_covered"))

    rows = one(first, "first").crossJoin(one(second, "second")).crossJoin(total)
    for name in ("first", "second"):
        share = F.col(f"{name}_covered") / F.col("total") * 100
        rows = rows.withColumn(f"{name}_per_pct", F.when(share == 0, float("inf")).otherwise(F.round(F.try_divide(F.col(f"{name}_chunks"), share), 6)))
    return rows.withColumn("reduction_pct", F.round((1 - F.try_divide("second_chunks", "first_chunks")) * 100, 6))


def coherence(chunks: DataFrame, encoder: Encoder, sample: int = 200, least: int = 100) -> DataFrame:
    """n, coherence: mean cosine of the two halves of the first sample chunks, those of under least characters passed over.

    Null without such a chunk.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = chunks.orderBy("chunk_id").limit(sample).where(F.length("text") >= least)
    sides = F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))
    halves = rows.select("chunk_id", F.posexplode(sides).alias("side", "text")).select(F.struct("chunk_id", "side").alias("k"), "text")
    halves = halves.select(F.to_json("k").alias("k"), "k.chunk_id", "k.side", "text")
    vectors = halves.select("k", "chunk_id", "side").join(encoded(halves, "k", encoder), "k")
    x, y = (vectors.where(F.col("side") == n).select("chunk_id", F.col("vector").alias(v)) for n, v in ((0, "x"), (1, "y")))
    cosine = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, v: t + v)
    return x.join(y, "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.avg(cosine).alias("coherence"))
