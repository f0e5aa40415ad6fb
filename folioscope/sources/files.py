"""Sources: query files, law files, text corpora, chunk nodes and page files, as tables.

Paths are looked at through Hadoop's file systems, so any store that Spark reads
will do.  Files that hold one JSON value are read whole, one row a file.
"""

from __future__ import annotations

import ast
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from folioscope.functions import text as T

SPAN_QUERY = "struct<id: string, query: string, question: string, snippets: array<struct<file_path: string, span: array<int>, answer: string>>>"
SECTION_QUERIES = "struct<queries: array<struct<id: string, query: string, expected_sections: array<string>, type: string, difficulty: string>>>"
LAWS = "array<struct<law_name: string, section_num: string, section_content: string, reference: array<struct<law_name: string, section_num: string>>>>"
NODES = "array<struct<id_: string, text: string>>"
#: Where span queries may lie, in order.
QUERY_FILES = ("tests.json", "queries.json", "data/tests.json")
BENCHMARKS, CORPUS = "data/benchmarks", "data/corpus"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, top: str, suffix: str) -> list[str]:
    """Files under top whose names end with suffix, sorted."""
    fs, p = _fs(spark, top)
    if not fs.exists(p):
        return []
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        if (name := it.next().getPath().toString()).endswith(suffix):
            out.append(name)
    return sorted(out)


def _path(column: Column) -> Column:
    """A file's path as written, without a URI's escapes; file:///x is file:/x."""
    plain = F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, value: files as one text each, bytes that aren't UTF-8 replaced by U+FFFD."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(_path(F.col("_metadata.file_path")).alias("path"), F.make_valid_utf8(F.col("value")).alias("value"))


# ---- page files


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page_no, text of PDF files; needs pdfplumber or PyMuPDF on the executors."""

    @F.udf(ArrayType(StringType()), useArrow=True)
    def texts(data):
        import io

        try:
            import pdfplumber
        except ImportError:
            try:
                import fitz
            except ImportError:
                raise ImportError("PDF files need pdfplumber or PyMuPDF") from None
            with fitz.open(stream=bytes(data), filetype="pdf") as doc:
                return [page.get_text() for page in doc]
        with pdfplumber.open(io.BytesIO(bytes(data))) as doc:
            return [page.extract_text() or "" for page in doc.pages]

    files = spark.read.format("binaryFile").load(path)
    return files.select(_path(F.col("path")).alias("path"), F.posexplode(texts("content")).alias("page_no", "text"))


# ---- queries


def section_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id (place in the file), id, query, expected_sections, qtype, difficulty (medium, where there is none)."""
    rows = whole(spark, path).select(F.posexplode(F.from_json("value", SECTION_QUERIES)["queries"]).alias("p", "q"))
    q = F.col("q")
    return rows.select(F.col("p").cast("long").alias("query_id"), q["id"].alias("id"), q["query"].alias("query"), q["expected_sections"].alias("expected_sections"), q["type"].alias("qtype"), F.coalesce(q["difficulty"], F.lit("medium")).alias("difficulty"))


def _span_rows(files: DataFrame, prefix: Column, named: Column | None = None) -> DataFrame:
    """Queries of files (path, value): {"tests": [...]} or a plain list."""
    tests = F.coalesce(F.from_json("value", f"struct<tests: array<{SPAN_QUERY}>>")["tests"], F.from_json("value", f"array<{SPAN_QUERY}>"))
    return _normal(files.select("path", F.posexplode(tests).alias("p", "q")), prefix, named)


def _normal(rows: DataFrame, prefix: Column, named: Column | None = None) -> DataFrame:
    q = F.col("q")
    text = F.coalesce(q["query"], q["question"], F.lit(""))
    snippets = F.coalesce(q["snippets"], F.from_json(F.lit("[]"), "array<struct<file_path: string, span: array<int>, answer: string>>"))
    first = F.coalesce(F.get(snippets, F.lit(0))["file_path"], F.lit(""))
    return rows.select("path", "p", F.coalesce(q["id"], F.concat(prefix, F.col("p").cast("string"))).alias("id"), text.alias("query"), snippets.alias("snippets"), (T.subdataset(first, text) if named is None else named).alias("subdataset"))


def span_queries(spark: SparkSession, data_dir: str) -> DataFrame:
    """query_id, id, query, snippets, subdataset, from the first of the layouts that is there.

    Those are a file of QUERY_FILES; a file for each dataset in BENCHMARKS, which names
    the dataset; the first file of JSON lines below data_dir.  query_id numbers the
    queries by file and place.
    """
    top = data_dir.rstrip("/")
    rows = None
    if found := next((f"{top}/{n}" for n in QUERY_FILES if exists(spark, f"{top}/{n}")), None):
        rows = _span_rows(whole(spark, found), F.lit("q_"))
    elif files := [f for f in listed(spark, f"{top}/{BENCHMARKS}", ".json") if f.rsplit("/", 2)[1] == "benchmarks"]:
        name = F.replace(F.lower(T.stem(F.col("path"))), F.lit("_"), F.lit(""))
        rows = _span_rows(whole(spark, files), F.concat(name, F.lit("_")), name)
    elif files := listed(spark, top, ".jsonl"):
        lines = F.filter(F.split("value", "\n"), lambda x: F.btrim(x) != "")
        each = whole(spark, files[0]).select("path", F.posexplode(lines).alias("p", "line"))
        rows = _normal(each.select("path", "p", F.from_json("line", SPAN_QUERY).alias("q")), F.lit(""))
    if rows is None:
        raise FileNotFoundError(f"no query file in {data_dir}")
    # a file's queries are one row of text, so their number is what people write
    ordered = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("path", "p", "id", "query", "snippets", "subdataset"))).alias("all"))
    return ordered.select(F.posexplode("all").alias("query_id", "q")).select(F.col("query_id").cast("long").alias("query_id"), "q.id", "q.query", "q.snippets", "q.subdataset")


def spans(queries: DataFrame) -> DataFrame:
    """query_id, path, g_start, g_end, answer of span queries; those without a path or two ends are left out."""
    rows = queries.select("query_id", F.explode("snippets").alias("s"))
    rows = rows.where((F.coalesce(F.col("s.file_path"), F.lit("")) != "") & (F.size("s.span") == 2))
    return rows.select("query_id", F.col("s.file_path").alias("path"), F.col("s.span")[0].alias("g_start"), F.col("s.span")[1].alias("g_end"), F.coalesce("s.answer", F.lit("")).alias("answer"))


def referenced(queries: DataFrame) -> DataFrame:
    """name: the paths that queries refer to, and these paths' last parts."""
    paths = queries.select(F.explode("snippets.file_path").alias("name")).where("name <> ''")
    return paths.unionByName(paths.select(F.element_at(F.split("name", "/"), -1).alias("name"))).distinct()


# ---- corpora


@F.udf(StringType(), useArrow=True)
def _nfc(text):
    return None if text is None else unicodedata.normalize("NFC", text)


def text_corpus(spark: SparkSession, data_dir: str, names: DataFrame | None = None) -> DataFrame:
    """path (below the corpus' top), stem, text of all *.txt; of those only whose path or stem, composed, is among names (name)."""
    top = f"{data_dir.rstrip('/')}/{CORPUS}"
    top = top if exists(spark, top) else data_dir.rstrip("/")
    fs, p = _fs(spark, top)
    root = fs.makeQualified(p).toString()
    rows = spark.read.text(top, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    path = F.substring(_path(F.col("_metadata.file_path")), F.lit(len(root) + 2), F.lit(1 << 20))
    rows = rows.select(path.alias("path"), F.make_valid_utf8(F.col("value")).alias("text")).withColumn("stem", T.stem(F.col("path")))
    if names is not None:
        keys = rows.select("path", F.explode(F.array(_nfc("path"), _nfc("stem"))).alias("name")).join(names, "name", "left_semi").select("path").distinct()
        rows = rows.join(keys, "path", "left_semi")
    return rows.select("path", "stem", "text")


def law_sections(spark: SparkSession, folder: str) -> DataFrame:
    """section_id, law_name, section_num, text, cross_refs of law files; of one id the last by file and place counts.

    Rows without a law, a number or content are left out.
    """
    rows = whole(spark, listed(spark, folder, ".json")).select("path", F.posexplode(F.from_json("value", LAWS)).alias("p", "s")).select("path", "p", "s.*")
    rows = rows.where((F.coalesce("law_name", F.lit("")) != "") & (F.coalesce("section_num", F.lit("")) != "") & F.coalesce(F.col("section_content").rlike(r"(?U)\S"), F.lit(False)))
    named = F.filter(F.coalesce("reference", F.array()), lambda r: (F.coalesce(r["law_name"], F.lit("")) != "") & (F.coalesce(r["section_num"], F.lit("")) != ""))
    refs = F.transform(named, lambda r: F.concat_ws("-", r["law_name"], r["section_num"]))
    rows = rows.select(F.concat_ws("-", "law_name", "section_num").alias("section_id"), F.struct("path", "p").alias("at"), F.struct("law_name", "section_num", F.col("section_content").alias("text"), refs.alias("cross_refs")).alias("v"))
    return rows.groupBy("section_id").agg(F.max_by("v", "at").alias("v")).select("section_id", "v.*")


_LAWS_OF_ROW = ArrayType(StructType([StructField("law", StringType()), StructField("sections", StringType())]))


@F.udf(_LAWS_OF_ROW, useArrow=True)
def _literal(value):
    """A Python literal's laws; None if it is none."""
    try:
        return [(None if x.get("law") is None else str(x["law"]), None if x.get("sections") is None else str(x["sections"])) for x in ast.literal_eval(value)]
    except Exception:  # noqa: BLE001  whatever is wrong with a row, it is left out
        return None


def law_queries(spark: SparkSession, path: str, laws: DataFrame) -> DataFrame:
    """query_id (the file's row), id, query, expected_ids, has_xref of a CSV file with question and relevant_laws.

    Rows whose laws are no Python literal, or name no section, are left out.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).coalesce(1)
    rows = rows.withColumn("query_id", F.monotonically_increasing_id()).select("query_id", F.col("question").alias("query"), _literal("relevant_laws").alias("laws"))
    ok = F.filter("laws", lambda x: (F.coalesce(x["law"], F.lit("")) != "") & (F.coalesce(x["sections"], F.lit("")) != ""))
    rows = rows.select("query_id", "query", F.transform(ok, lambda x: F.concat_ws("-", x["law"], x["sections"])).alias("expected_ids")).where(F.size("expected_ids") > 0)
    linked = laws.where(F.size("cross_refs") > 0).select(F.col("section_id").alias("gold_id"))
    flagged = rows.select("query_id", F.explode("expected_ids").alias("gold_id")).join(linked, "gold_id", "left_semi").select("query_id").distinct().withColumn("x", F.lit(True))
    return rows.join(flagged, "query_id", "left").select("query_id", F.concat(F.lit("ccl_"), "query_id").alias("id"), "query", "expected_ids", F.coalesce("x", F.lit(False)).alias("has_xref"))


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id (place in the file), node_id, text of a chunk file."""
    rows = whole(spark, path).select(F.posexplode(F.from_json("value", NODES)).alias("p", "n"))
    return rows.select(F.col("p").cast("long").alias("chunk_id"), F.col("n.id_").alias("node_id"), F.col("n.text").alias("text"))


def gold_map(spark: SparkSession, path: str) -> DataFrame:
    """node_id, gold_id of a file that maps chunks to lists."""
    rows = whole(spark, path).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("node_id", "g"))
    return rows.select("node_id", F.explode("g").alias("gold_id"))
