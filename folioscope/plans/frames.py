"""What the queries read: corpus, chunks, sections, gold spans and runs over the given tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators import chunk, judge, retrieve, sections
from folioscope.sources import scratch

#: Chunk ids are doc_id * this + chunk_index.
WIDE = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null")


def fixed_chunks(spark, sf_dir) -> DataFrame:
    return chunk.fixed(docs(spark, sf_dir)).withColumn("chunk_id", F.col("doc_id") * WIDE + F.col("chunk_index"))


def gold(spark, sf_dir) -> DataFrame:
    """item_id, doc_id, g_start, g_end of the benchmark's passages in the documents; written, as more than one step reads it."""
    return scratch.written(judge.passages(table(spark, sf_dir, "benchmark"), docs(spark, sf_dir)), "gold")


def asked(spark, sf_dir, g: DataFrame | None = None) -> DataFrame:
    """query_id, text of the items that occur in some document."""
    g = gold(spark, sf_dir) if g is None else g
    return table(spark, sf_dir, "benchmark").join(g.select("item_id").distinct(), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "text")


def lexical_run(spark, sf_dir, k: int = 10, g: DataFrame | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, doc_id, char_start, char_end, text; written, as more than one step reads it."""
    chunks = fixed_chunks(spark, sf_dir)
    return scratch.written(retrieve.looked_up(retrieve.bm25(chunks, asked(spark, sf_dir, g), k), chunks.select("chunk_id", "doc_id", "char_start", "char_end", "text")), "hits")


def gold_spans(spark, sf_dir, g: DataFrame | None = None) -> DataFrame:
    return (gold(spark, sf_dir) if g is None else g).withColumnRenamed("item_id", "query_id")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


#: Every so many-th vector is a query.
EVERY = 20


def dense_run(spark, sf_dir, k: int = 10) -> DataFrame:
    """Every twentieth vector against all others, with whether the labels agree; written, as more than one step reads it.

    Vectors are dealt over all cores, as a file of them may be small for the work that it makes.
    """
    v = vectors(spark, sf_dir)
    q = v.where(F.col("chunk_id") % EVERY == 0)
    run = retrieve.dense(v.select("chunk_id", "vector").repartition(2 * spark.sparkContext.defaultParallelism), q.select(F.col("chunk_id").alias("query_id"), "vector"), k, exclude_self=True)
    run = run.join(v.select("chunk_id", F.col("label").alias("hit_label")), "chunk_id").join(q.select(F.col("chunk_id").alias("query_id"), "label"), "query_id")
    return scratch.written(run.withColumn("rel", (F.col("hit_label") == F.col("label")).cast("int")), "run")


def lines(spark, sf_dir) -> DataFrame:
    """Sections made of lines, each with a reference to the line 7 * i mod n + 1."""
    s = sections.numbered_lines(docs(spark, sf_dir))
    ref = F.concat(F.lit(" under section "), ((F.col("section_no") * 7) % F.col("last_no") + 1).cast("string"))
    return s.withColumn("content", F.concat("content", ref)).drop("last_no")


def parents(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    s = lines(spark, sf_dir) if s is None else s
    return sections.with_parent(s, sections.chapters_of_lines(s))


def statutes(spark, sf_dir) -> DataFrame:
    """doc_id, text: a statute of each document's lines, whose words are cut down to plain letters.

    Line i is section i, every fifth opens a chapter, and each refers to line 7 * i mod n + 1.
    """
    chapter = lambda no: F.when((no - 1) % 5 == 0, F.concat(F.lit("CHAPTER "), F.element_at(F.array(*map(F.lit, NUMERALS)), (F.floor((no - 1) / 5) % len(NUMERALS) + 1).cast("int")), F.lit("\nOf Matters\n"))).otherwise("")
    return _drawn(spark, sf_dir, lambda no, plain: F.concat(chapter(no), no.cast("string"), F.lit(". Heading of a line—"), plain))


def regulations(spark, sf_dir) -> DataFrame:
    """doc_id, text: the same lines as articles."""
    return _drawn(spark, sf_dir, lambda no, plain: F.concat(F.lit("Article "), no.cast("string"), F.lit("\nHeading of a line\n"), plain))


def agreements(spark, sf_dir) -> DataFrame:
    """doc_id, text: the same lines under a contract's headings; documents with an id divisible by 5 have none."""
    return _drawn(spark, sf_dir, lambda no, plain: F.concat(F.when(F.col("doc_id") % 5 != 0, F.concat(no.cast("string"), F.lit(".1 Heading of a line\n"))).otherwise(""), plain), "Between the parties\n")


NUMERALS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def _drawn(spark, sf_dir, line, before: str = "Preamble\n") -> DataFrame:
    """What line makes of the numbers and plain texts of lines(); a document's are put together in its row, so nothing is shuffled."""
    d = docs(spark, sf_dir).where(F.col("text").rlike(sections.NOT_BLANK))
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    d = d.select("doc_id", F.filter(numbered, lambda s: s["line"].rlike(sections.NOT_BLANK)).alias("rows"))
    n = F.element_at("rows", -1)["no"]
    content = lambda s: F.concat(s["line"], F.lit(" under section "), ((s["no"] * 7) % n + 1).cast("string"))
    # what is kept is extracted: to replace the rest, by a class of all other characters, takes several times as long
    kept = lambda x: F.array_join(F.regexp_extract_all(x, F.lit("[a-z0-9 ]+"), F.lit(0)), "")
    plain = lambda s: F.regexp_replace(F.concat(F.lit("x "), kept(content(s))), " {2,}", " ")
    return d.select("doc_id", F.concat(F.lit(before), F.array_join(F.transform("rows", lambda s: line(s["no"], plain(s))), "\n")).alias("text"))


def edges(spark, sf_dir) -> DataFrame:
    return sections.edges(lines(spark, sf_dir))


def structural(spark, sf_dir, s: DataFrame | None = None) -> DataFrame:
    """Of lines(), or of those that are given; these are written, as more than one step reads them."""
    s = scratch.written(lines(spark, sf_dir), "lines") if s is None else s
    # chapters are found for the places of sections alone, so that contents are shuffled once
    placed = parents(spark, sf_dir, s.select("doc_id", "section_no", "title", "char_start")).select("doc_id", F.col("section_no").cast("string").alias("section_no"), "chapter_no", "chapter_title")
    s = s.withColumn("section_no", F.col("section_no").cast("string"))
    return chunk.structural(s.join(placed, ["doc_id", "section_no"]), chunk.top_references(sections.edges(s), s), "Corpus").drop("cross_references")


DOCS = "d as (select doc_id, text, lang from documents where text is not null)"
CHUNKS = f"""{DOCS}, c as (select doc_id, cast(doc_id * {WIDE} + i as bigint) as chunk_id, cast(i as int) as chunk_index, cast(i * 500 as int) as char_start, substring(text, i * 500 + 1, 500) as text
 from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 500.0) as bigint))) as i from d where length(text) > 0))"""
GOLD = "g as (select b.item_id, documents.doc_id, cast(instr(documents.text, b.text) - 1 as int) as g_start, cast(instr(documents.text, b.text) - 1 + length(b.text) as int) as g_end from benchmark b join documents on contains(documents.text, b.text))"
ASKED = "q as (select item_id as query_id, text from benchmark where item_id in (select item_id from g))"
TERMS = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"


def bm25_sql(k: int, variant: str = "lucene") -> str:
    terms = TERMS if variant == "lucene" else "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))" if variant == "lucene" else "case when ln(n - df + 0.5) - ln(df + 0.5) < 0 then (select avg(ln(n - df + 0.5) - ln(df + 0.5)) * 0.25 from df, st) else ln(n - df + 0.5) - ln(df + 0.5) end"
    factor = "" if variant == "lucene" else " * 2.5"
    return f"""{CHUNKS}, {GOLD}, {ASKED},
ct as (select chunk_id, {terms} as ts from c), dl as (select chunk_id, len(ts) as dl from ct),
po as (select term, chunk_id, count(*) as tf from (select chunk_id, unnest(ts) as term from ct) group by all),
df as (select term, count(*) as df from po group by term), st as (select count(*) as n, avg(dl) as avgdl from dl),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({terms}) as term from q) group by all),
sc as (select query_id, po.chunk_id, round(sum(qtf * {idf} * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)){factor}), 12) as s
  from po join qt using (term) join df using (term) join dl on dl.chunk_id = po.chunk_id, st group by query_id, po.chunk_id),
run as (select * from (select query_id, cast(row_number() over (partition by query_id order by s desc, chunk_id) as int) as rank, chunk_id, round(s, 6) as score from sc) where rank <= {k})"""


def dense_sql(k: int = 10) -> str:
    return f"""e as (select vec_id, cast(embedding as double[]) as v, label from embeddings),
ds as (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_inner_product(a.v, b.v), 12) as s, cast(a.label = b.label as int) as rel, a.label from e a join e b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id),
drun as (select * from (select query_id, cast(row_number() over (partition by query_id order by s desc, chunk_id) as int) as rank, chunk_id, round(s, 6) as score, rel, label from ds) where rank <= {k})"""


_WS = r"[ \t\n\r\f\v]"
LINES = rf"""{DOCS}, l0 as (select doc_id, text, i, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as char_start
  from (select doc_id, text, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, text, string_split(text, chr(10)) as ls from d))),
l1 as (select doc_id, i, char_start, line, max(i) over (partition by doc_id) as n from l0 where regexp_matches(line, '[^ \t\n\r\f\v]')),
s as (select doc_id, cast(i as int) as section_no, array_to_string(list_filter(regexp_split_to_array(line, '{_WS}+'), lambda x: x <> '')[1:5], ' ') as title,
  line || ' under section ' || cast((i * 7) % n + 1 as varchar) as content, cast(char_start as int) as char_start from l1),
ch as (select doc_id, cast((section_no - 1) // 5 + 1 as int) as chapter_no, title as chapter_title, char_start as pos from s where (section_no - 1) % 5 = 0),
p as (select s.*, ch.chapter_no, ch.chapter_title from s asof left join ch on s.doc_id = ch.doc_id and s.char_start > ch.pos)"""
EDGES = """x0 as (select doc_id, section_no, regexp_extract_all(content, '(?i)under\\s+section\\s+(\\d+[A-Z]?)', 1) || regexp_extract_all(content, '(?i)section\\s+(\\d+[A-Z]?)', 1) || regexp_extract_all(content, '(?i)rule\\s+(\\d+)', 1) as r from s),
x1 as (select doc_id, section_no, ref, min(k) as k from (select doc_id, section_no, unnest(r) as ref, unnest(range(len(r))) as k from x0) group by all),
ed as (select x1.doc_id, cast(x1.section_no as varchar) as src_no, ref as dst_no, cast(row_number() over (partition by x1.doc_id, x1.section_no order by k) - 1 as int) as ord0 from x1),
ed2 as (select ed.doc_id, src_no, dst_no, ord0 as ord from ed join s on s.doc_id = ed.doc_id and cast(s.section_no as varchar) = dst_no where src_no <> dst_no)"""

_PLAIN = "regexp_replace('x ' || regexp_replace(content, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')"
#: The lines of statutes(), regulations() and agreements().
DRAWN = f"dr as (select doc_id, section_no, {_PLAIN} as plain, (section_no - 1) // 5 as c from s)"
