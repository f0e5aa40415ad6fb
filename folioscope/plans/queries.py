"""Queries over the given tables, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunk, encode, judge, metrics, quality, retrieve, sampling, sections, stats
from folioscope.sources import scratch

from . import frames as f
from .registry import query

# ---- chunks


@query(f"with {f.CHUNKS} select doc_id, chunk_index, char_start, cast(char_start + length(text) as int) as char_end, text from c")
def fixed_chunks(spark, sf_dir) -> DataFrame:
    return chunk.fixed(f.docs(spark, sf_dir))


@query(f"with {f.DOCS} select * from (select doc_id, cast(i as int) as chunk_index, cast(i * 425 as int) as char_start, trim(substring(text, i * 425 + 1, 500), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 425.0) as bigint))) as i from d where length(text) > 0)) where text <> ''")
def char_overlap_chunks(spark, sf_dir) -> DataFrame:
    return chunk.overlapping(f.docs(spark, sf_dir), 500, 75)


@query(f"with {f.CHUNKS} select doc_id, count(*) as n_chunks, cast(sum(length(text)) as bigint) as chars, cast(sum(length(text) // 4) as bigint) as tokens from c group by doc_id")
def chunk_token_stats(spark, sf_dir) -> DataFrame:
    rows = chunk.with_metadata(chunk.fixed(f.docs(spark, sf_dir)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("char_count").alias("chars"), F.sum("approx_tokens").alias("tokens"))


@query()
def recursive_chunks(spark, sf_dir) -> DataFrame:
    return chunk.recursive(f.docs(spark, sf_dir), 512, 0.1)


@query(f"with {f.DOCS} select doc_id, cast(0 as int) as chunk_index, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as text from d where length(text) <= 2048 and regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')")
def recursive_chunks_whole(spark, sf_dir) -> DataFrame:
    """Documents within the limit are one chunk."""
    return chunk.recursive(f.docs(spark, sf_dir).where(F.length("text") <= 2048), 512, 0.1).select("doc_id", "chunk_index", "text")


@query(f"with {f.DOCS}, sp as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\f\\r\\v]+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^[\\s\\v\\x{{85}}\\x{{a0}}\\p{{Z}}]+|[\\s\\v\\x{{85}}\\x{{a0}}\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') as ss from d) select doc_id, cast(unnest(range(len(ss))) as int) as i, unnest(ss) as sentence from sp")
def sentence_split(spark, sf_dir) -> DataFrame:
    return f.docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


# ---- structure


@query(f"with {f.LINES} select doc_id, section_no, title, char_start, cast(length(content) as int) as n from s")
def sections_from_lines(spark, sf_dir) -> DataFrame:
    return f.lines(spark, sf_dir).select("doc_id", "section_no", "title", "char_start", F.length("content").alias("n"))


@query(f"with {f.LINES} select doc_id, section_no, chapter_no, chapter_title from p")
def section_parent_asof(spark, sf_dir) -> DataFrame:
    return f.parents(spark, sf_dir).select("doc_id", "section_no", "chapter_no", "chapter_title")


@query(f"with {f.LINES}, {f.EDGES} select doc_id, src_no, dst_no from ed2")
def xref_edges(spark, sf_dir) -> DataFrame:
    return f.edges(spark, sf_dir).select("doc_id", "src_no", "dst_no")


_TOP = """tr as (select ed2.doc_id, src_no, array_to_string(list('  → §' || dst_no || ': ' || t.title || ': ' || substring(t.content, 1, 200) || '...' order by ord)[1:3], chr(10)) as refs
  from ed2 join s t on t.doc_id = ed2.doc_id and cast(t.section_no as varchar) = dst_no group by ed2.doc_id, src_no)"""
_STRUCT = f"""{f.LINES}, {f.EDGES}, {_TOP},
bc as (select p.*, tr.refs, 'Corpus' || case when coalesce(chapter_title, '') <> '' then ' > Chapter ' || chapter_no || ': ' || substring(chapter_title, 1, 50) else '' end || ' > Section ' || section_no as breadcrumb
  from p left join tr on tr.doc_id = p.doc_id and tr.src_no = cast(p.section_no as varchar)),
st as (select doc_id, cast(section_no as varchar) as section_no, breadcrumb, refs is not null as has_cross_refs, char_start, cast(char_start + length(content) as int) as char_end,
  '[' || breadcrumb || ']' || chr(10) || 'Section ' || section_no || '. ' || title || chr(10) || chr(10) || content || case when refs is not null then chr(10) || chr(10) || '[CROSS-REFERENCES:]' || chr(10) || refs else '' end as text from bc)"""


@query(f"with {f.LINES}, {f.EDGES}, {_TOP} select doc_id, src_no, refs from tr")
def xref_augment_top3(spark, sf_dir) -> DataFrame:
    s = f.lines(spark, sf_dir).withColumn("section_no", F.col("section_no").cast("string"))
    return chunk.top_references(sections.edges(s), s).select("doc_id", "src_no", F.array_join("refs", "\n").alias("refs"))


@query(f"with {_STRUCT} select * from st")
def structural_chunks(spark, sf_dir) -> DataFrame:
    return f.structural(spark, sf_dir)


@query(f"with {_STRUCT} select count(*) as n, round(avg(x), 6) as mean_pct, round(median(x), 6) as median_pct, round(quantile_cont(x, 0.9), 6) as p90_pct from (select (length(breadcrumb) // 4) / greatest(length(text) // 4, 1) * 100.0 as x from st where breadcrumb <> '')")
def breadcrumb_stats(spark, sf_dir) -> DataFrame:
    return chunk.breadcrumb_stats(f.structural(spark, sf_dir))


@query(f"""with {f.LINES}, st as (select doc_id || '-' || section_no as section_id, section_no, doc_id, content as text, max(section_no) over (partition by doc_id) as n from s),
re as (select section_id, unnest(range(3)) as p, unnest([doc_id || '-' || ((7 * section_no) % n + 1), section_id, doc_id || '-0']) as ref from st where section_no % 2 = 0
  union all select section_id, unnest(range(3)), unnest([doc_id || '-' || ((5 * section_no) % n + 1), doc_id || '-' || ((3 * section_no) % n + 1), doc_id || '-' || section_no]) from st where section_no % 2 = 1),
rf as (select re.section_id, string_agg('→ มาตรา ' || t.section_no || ': ' || substring(t.text, 1, 200) || '…', chr(10) order by p) as refs from re join st t on t.section_id = ref where ref <> re.section_id group by re.section_id)
select st.section_id, '[Act > มาตรา ' || section_no || ']' || chr(10) || text || case when refs is null then '' else chr(10) || '[ข้อความอ้างอิง:]' || chr(10) || refs end as text from st left join rf using (section_id)""")
def statute_augment(spark, sf_dir) -> DataFrame:
    """Lines as sections, with references that resolve, that don't, and to themselves among the first three."""
    s = f.lines(spark, sf_dir).withColumn("n", F.max("section_no").over(W.partitionBy("doc_id")))
    to = lambda k: F.concat_ws("-", "doc_id", (k * F.col("section_no")) % F.col("n") + 1)
    own = F.concat_ws("-", "doc_id", "section_no")
    refs = F.when(F.col("section_no") % 2 == 0, F.array(to(7), own, F.concat_ws("-", "doc_id", F.lit("0")), to(11))).otherwise(F.array(to(5), to(3), own, to(11)))
    return chunk.statute_augmented(s.select(own.alias("section_id"), F.lit("Act").alias("law_name"), F.col("section_no").cast("string").alias("section_num"), F.col("content").alias("text"), refs.alias("cross_refs")))


@query("select conv_id, string_agg(text, chr(10) order by turn, text) as text from conversations where text is not null group by conv_id")
def page_assembly(spark, sf_dir) -> DataFrame:
    return sections.assembled(f.table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "turn", "text")


_TITLED = "select page_id, url, case page_id % 3 when 0 then html when 1 then 'x' || chr(10) || 'THE LAND' || chr(10) || ' RULES, OF ACT ' || page_id else 'PENAL CODE ' || page_id end as t from pages"


@query(f"select page_id, coalesce(nullif(regexp_replace(regexp_extract(t, '(?m)^THE\\s+([A-Z][A-Z\\s,]+(?:ACT|CODE|RULES))', 1), '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_extract(t, '(?m)^([A-Z][A-Z\\s,]+(?:ACT|CODE|RULES))', 1), ''), 'Legal Document') as title, regexp_extract(url, '([^/]+?)(?:\\.[^./]*)?$', 1) as stem from ({_TITLED})")
def titles_and_stems(spark, sf_dir) -> DataFrame:
    """Pages, a third of them under the title of an act, a third under that of a code."""
    p, n = f.table(spark, sf_dir, "pages"), F.col("page_id")
    text = F.when(n % 3 == 0, F.col("html")).when(n % 3 == 1, F.concat(F.lit("x\nTHE LAND\n RULES, OF ACT "), n.cast("string"))).otherwise(F.concat(F.lit("PENAL CODE "), n.cast("string")))
    return p.select("page_id", sections.document_title(text).alias("title"), T.stem(F.col("url")).alias("stem"))


@query(f"with {f.LINES}, {f.DRAWN} select doc_id, cast(section_no as varchar) as section_no, 'Heading of a line' as title, substring(trim(plain), 1, 5000) as content, {list(f.NUMERALS)}[c % 10 + 1] as chapter_no, 'Of Matters' as chapter_title from dr")
def statute_sections(spark, sf_dir) -> DataFrame:
    """Sections and their chapters, parsed out of the statutes."""
    return sections.parsed(f.statutes(spark, sf_dir)).sections.select("doc_id", "section_no", "title", "content", "chapter_no", "chapter_title")


@query(f"with {f.LINES}, {f.DRAWN} select distinct doc_id, {list(f.NUMERALS)}[c % 10 + 1] as chapter_no, 'Of Matters' as title from dr where (section_no - 1) % 5 = 0")
def statute_chapters(spark, sf_dir) -> DataFrame:
    return sections.parsed(f.statutes(spark, sf_dir)).chapters


@query(f"with {f.LINES}, {f.DRAWN} select doc_id, cast(section_no as varchar) as section_no, 'Heading of a line' as title, substring(trim(plain), 1, 5000) as content from dr")
def regulation_articles(spark, sf_dir) -> DataFrame:
    """Documents without a statute's sections, by articles."""
    return sections.parsed(f.regulations(spark, sf_dir)).sections.select("doc_id", "section_no", "title", "content")


@query(f"with {f.LINES}, {f.DRAWN} select doc_id, '5' as section_no, 'Section 5. Heading of a line' || chr(10) || substring(trim(plain), 1, 5000) as text from dr where section_no = 5")
def section_lookup(spark, sf_dir) -> DataFrame:
    """The text of section 5 of each statute."""
    return sections.parsed(f.statutes(spark, sf_dir)).section_content("5")


@query(f"with {f.LINES} select doc_id, cast(section_no % 7 as varchar) as section_no, arg_max(title, char_start) as title, min(char_start) as ord from s group by doc_id, section_no % 7")
def repeated_sections(spark, sf_dir) -> DataFrame:
    """Lines numbered modulo 7: of one number the last counts, at the first one's place."""
    s = f.lines(spark, sf_dir).withColumn("section_no", (F.col("section_no") % 7).cast("string"))
    return sections.last_wins(s).select("doc_id", "section_no", "title", "ord")


_CONTRACT = f"""{f.LINES}, {f.DRAWN}, hl as (select *, section_no || '.1 Heading of a line' as head from dr where doc_id % 5 <> 0),
bo as (select *, head || chr(10) || trim(plain) as body, min(section_no) over (partition by doc_id) as f, max(section_no) over (partition by doc_id) as l from hl),
re as (select *, list_distinct(regexp_extract_all(body, '(?i)section\\s+([\\d.]+)', 1)) as rs from bo),
fu as (select *, '[Contract > ' || head || ']' || chr(10) || body || case when len(rs) > 0 then chr(10) || '[References: Sections ' || array_to_string(rs, ', ') || ']' else '' end as text from re)"""


_HALVES = "[Contract > ' || head || ']' || chr(10) || regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"with {_CONTRACT} select doc_id, head as title, text from fu where length(text) // 4 <= 768 union all select doc_id, '', 'Between the parties' from hl group by doc_id union all select doc_id, head, '{_HALVES.format('substring(chr(10) || body, 1, (length(body) + 1) // 2)')} from fu where length(text) // 4 > 768 union all select doc_id, head, '{_HALVES.format('substring(chr(10) || body, (length(body) + 1) // 2 + 1)')} || case when len(rs) > 0 then chr(10) || '[References: Sections ' || array_to_string(rs, ', ') || ']' else '' end from fu where length(text) // 4 > 768")
def contract_chunks(spark, sf_dir) -> DataFrame:
    """The contracts' preambles and sections, long ones in halves."""
    return chunk.contracts(f.agreements(spark, sf_dir).where("doc_id % 5 <> 0")).select("doc_id", "title", "text")


@query()
def contract_pool(spark, sf_dir) -> DataFrame:
    """Both chunk pools of the contracts, as files of a folder for each language."""
    lang = f.table(spark, sf_dir, "documents").select("doc_id", "lang")
    files = f.agreements(spark, sf_dir).join(lang, "doc_id").select(F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return chunk.pools(scratch.written(files, "files"))


@query()
def structural_sized_chunks(spark, sf_dir) -> DataFrame:
    """Structural chunks of 64 tokens, long sections in parts."""
    return chunk.structural_sized(f.structural(spark, sf_dir), 64).select("doc_id", "section_no", "part", "text")


@query(f"with {f.LINES} select doc_id, section_no, substring(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 5000) as content from s")
def content_normalised(spark, sf_dir) -> DataFrame:
    return f.lines(spark, sf_dir).select("doc_id", "section_no", T.normalised(F.col("content")).alias("content"))


# ---- gold, samples


@query(f"with {f.GOLD} select * from g")
def gold_spans(spark, sf_dir) -> DataFrame:
    return f.gold(spark, sf_dir)


_SUB = "case when p like '%contractnli%' then 'contractnli' when p like '%cuad%' then 'cuad' when p like '%maud%' then 'maud' when p like '%privacyqa%' then 'privacyqa' when t like '%non-disclosure%' or t like '%nda%' then 'contractnli' when t like '%privacy%' or t like '%data practice%' then 'privacyqa' when t like '%merger%' or t like '%acquisition%' or t like '%m&a%' then 'maud' else 'cuad' end"


@query(f"select doc_id, {_SUB} as subdataset from (select doc_id, replace(case doc_id % 7 when 1 then 'Privacy_QA/x' when 2 then 'contract_nli/y' else lower(source) end, '_', '') as p0, lower(p0) as p, lower(text) as t from documents where text is not null)")
def subdataset_infer(spark, sf_dir) -> DataFrame:
    path = F.when(F.col("doc_id") % 7 == 1, "Privacy_QA/x").when(F.col("doc_id") % 7 == 2, "contract_nli/y").otherwise(F.col("source"))
    return f.docs(spark, sf_dir).select("doc_id", T.subdataset(path, F.col("text")).alias("subdataset"))


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5(source), doc_id) as r from documents) where r <= 80 // (select count(distinct lang) from documents)")
def stratified_sample(spark, sf_dir) -> DataFrame:
    return sampling.stratified(f.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 80).select("doc_id", "lang")


@query("select lang, count(*) as n from documents group by lang")
def subdataset_counts(spark, sf_dir) -> DataFrame:
    return sampling.counts(f.table(spark, sf_dir, "documents"), "lang")


@query(f"with {f.GOLD} select doc_id, source from documents where doc_id in (select doc_id from g)")
def referenced_docs_semi(spark, sf_dir) -> DataFrame:
    return f.table(spark, sf_dir, "documents").select("doc_id", "source").join(f.gold(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")


@query("select md5(text) as content_key, min(doc_id) as doc_id, count(*) as n from documents where text is not null and md5(text) not in (select md5(text) from documents where doc_id % 2 = 0 and text is not null) group by md5(text)")
def embedding_cache_anti(spark, sf_dir) -> DataFrame:
    """What a cache that holds the texts of even ids still lacks."""
    d = f.docs(spark, sf_dir).select("doc_id", F.md5("text").alias("content_key"))
    return d.join(d.where("doc_id % 2 = 0").select("content_key"), "content_key", "left_anti").groupBy("content_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("select count(*) as n, count(distinct text) as n_contents, count(distinct text) as n_cached, 0::bigint as n_fresh from documents where text is not null")
def embedding_cache(spark, sf_dir) -> DataFrame:
    """Documents encoded through a cache that holds the even ones' texts, then once more, when nothing is left to encode."""
    encoder, path = encode.HashedWords(64), scratch.path(spark, "vectors")
    d = f.docs(spark, sf_dir).select("doc_id", "text")
    encode.cached(d.where("doc_id % 2 = 0"), "doc_id", encoder, path)
    encode.cached(d, "doc_id", encoder, path)
    cached = spark.read.parquet(path).count()
    rows = encode.cached(d, "doc_id", encoder, path)
    fresh = spark.read.parquet(path).count() - cached
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    contents = spark.read.parquet(path).agg(F.count_distinct("content").alias("n_contents"), F.count(F.lit(1)).alias("n_cached"))
    return n.crossJoin(contents).withColumn("n_fresh", F.lit(fresh).cast("long"))


# ---- retrieval


@query(f"with {f.CHUNKS}, po as (select distinct chunk_id, unnest({f.TERMS}) as term from c) select term, count(*) as df from po group by term")
def bm25_df(spark, sf_dir) -> DataFrame:
    c = f.fixed_chunks(spark, sf_dir)
    return retrieve.document_frequency(retrieve.postings(c, T.terms(F.col("text"))))


@query(f"with {f.bm25_sql(10)} select * from run")
def bm25_topk(spark, sf_dir) -> DataFrame:
    return retrieve.bm25(f.fixed_chunks(spark, sf_dir), f.asked(spark, sf_dir), 10)


@query(f"with {f.bm25_sql(10, 'okapi')} select * from run")
def bm25_okapi_topk(spark, sf_dir) -> DataFrame:
    return retrieve.bm25(f.fixed_chunks(spark, sf_dir), f.asked(spark, sf_dir), 10, "okapi")


@query(f"with {f.dense_sql()} select query_id, rank, chunk_id, score from drun")
def dense_topk(spark, sf_dir) -> DataFrame:
    return f.dense_run(spark, sf_dir).select("query_id", "rank", "chunk_id", "score")


# as vectors have no text, every second hit, in an order of their own, stands in for the lexical side
_SPARSE = "d20 as (select * from drun where rank <= 20), srun as (select query_id, chunk_id, cast(row_number() over (partition by query_id order by (chunk_id * 7919 + query_id * 104729) % 10007, chunk_id) as int) as rank from drun where rank % 2 = 0)"
_RRF = f"""{f.dense_sql(40)}, {_SPARSE},
fu as (select query_id, chunk_id, min(d) as d, min(s) as s from (select query_id, chunk_id, rank as d, null as s from d20 union all select query_id, chunk_id, null, rank from srun) group by all),
fr as (select *, round(coalesce(1.0::double / (60 + d), 0) + coalesce(1.0::double / (60 + s), 0), 9) as score from fu),
frun as (select * from (select query_id, cast(row_number() over (partition by query_id order by score desc, d nulls last, s nulls last, chunk_id) as int) as rank, chunk_id, score from fr) where rank <= 10)"""


def _fused(run):
    """Of a run to depth 40."""
    run = run.select("query_id", "rank", "chunk_id")
    mixed = run.where("rank % 2 = 0").select("query_id", "chunk_id", (-((F.col("chunk_id") * 7919 + F.col("query_id") * 104729) % 10007)).cast("double").alias("score"))
    return retrieve.fuse(run.where("rank <= 20"), retrieve.top(mixed, 20), 10)


@query(f"with {_RRF} select * from frun")
def rrf_fusion(spark, sf_dir) -> DataFrame:
    return _fused(f.dense_run(spark, sf_dir, 40))


@query()
def hybrid_topk(spark, sf_dir) -> DataFrame:
    """Lexical and hashed-vector search over fixed chunks, fused."""
    c, q = f.fixed_chunks(spark, sf_dir), f.asked(spark, sf_dir)
    return retrieve.hybrid(encode.hashed(c, "chunk_id"), encode.hashed(q, "query_id"), c, q, 10)


@query(f"with {f.dense_sql(64)} select query_id, k, count(*) as n, cast(sum(rel) as bigint) as hits from drun, (select unnest([1, 2, 4, 8, 10, 16, 32, 64]) as k) where rank <= k group by all")
def retrieve_once_slice(spark, sf_dir) -> DataFrame:
    return retrieve.at_depths(f.dense_run(spark, sf_dir, 64)).groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").alias("hits"))


# ---- relevance


@query(f"with {f.LINES}, {f.EDGES} select doc_id as query_id, dst_no as section_no, first_rank from (select doc_id, dst_no from ed2 group by all) left join (select doc_id, regexp_extract(content, 'under section (\\d+)$', 1) as dst_no, min(section_no) as first_rank from s group by all) using (doc_id, dst_no)")
def section_mention_first_rank(spark, sf_dir) -> DataFrame:
    """A document's lines as a run, the sections that it refers to as expected."""
    s = f.lines(spark, sf_dir)
    run = s.select(F.col("doc_id").alias("query_id"), F.col("section_no").alias("rank"), F.regexp_extract("content", r"(under section \d+)$", 1).alias("text"))
    expected = sections.edges(s).select(F.col("doc_id").alias("query_id"), F.col("dst_no").alias("section_no")).distinct()
    return judge.first_mentions(run, expected)


@query(f"with {f.dense_sql()} select query_id, rank, max(rel) over (partition by query_id order by rank) as rel from drun")
def cumulative_relevance(spark, sf_dir) -> DataFrame:
    return judge.cumulative(f.dense_run(spark, sf_dir))


_SPANS = f"""with {f.bm25_sql(10)},
rr as (select run.*, c.doc_id, c.char_start, c.char_start + length(c.text) as char_end from run join c using (chunk_id)),
rel as (select rr.query_id, rank, max(case when greatest(0, least(char_end, g_end) - greatest(char_start, g_start)) / cast(g_end - g_start as double) >= 0.5 then 1 else 0 end) as rel
  from rr left join g on g.item_id = rr.query_id and g.doc_id = rr.doc_id group by rr.query_id, rank)"""


def _span_relevance(spark, sf_dir, g=None):
    g = f.gold(spark, sf_dir) if g is None else g
    return judge.span_relevance(f.lexical_run(spark, sf_dir, g=g), f.gold_spans(spark, sf_dir, g))


@query(f"{_SPANS} select * from rel")
def span_overlap_relevance(spark, sf_dir) -> DataFrame:
    return _span_relevance(spark, sf_dir)


@query(f"{_SPANS} select q.query_id, cast(k as int) as rank, coalesce(rel.rel, 0) as rel from q cross join (select unnest(range(1, 11)) as k) left join rel on rel.query_id = q.query_id and rel.rank = k")
def rank_spine(spark, sf_dir) -> DataFrame:
    g = f.gold(spark, sf_dir)
    return judge.spine(f.asked(spark, sf_dir, g), _span_relevance(spark, sf_dir, g), 10)


@query(f"""with {f.bm25_sql(10)}, rr as (select run.*, c.doc_id, c.text from run join c using (chunk_id)),
a as (select g.item_id as query_id, g.doc_id as gold_doc, substring(b.text, 1, 100) as start from g join benchmark b using (item_id) where length(b.text) > 30)
select rr.query_id, rank, max(case when contains(rr.text, start) and rr.doc_id <> gold_doc then 1 else 0 end) as rel from rr left join a using (query_id) group by rr.query_id, rank""")
def answer_text_fallback(spark, sf_dir) -> DataFrame:
    g = f.gold(spark, sf_dir)
    hits = f.lexical_run(spark, sf_dir, g=g)
    answers = g.join(f.table(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), F.col("text").alias("answer"), "doc_id")
    return judge.answer_matches(hits, answers)


_BRIDGE = "br as (select vec_id as chunk_id, label * 100 + vec_id % 7 as gold_id from embeddings), ex as (select distinct a.query_id, a.label * 100 + n as gold_id from drun a, (select unnest(range(0, 4)) as n))"


def _bridge(spark, sf_dir):
    """Chunks map to one of seven gold ids of their label; queries expect the first four of theirs."""
    bridge = f.vectors(spark, sf_dir).select("chunk_id", (F.col("label") * 100 + F.col("chunk_id") % 7).alias("gold_id"))
    run = f.dense_run(spark, sf_dir, 20)
    expected = run.select("query_id", "label").distinct().select("query_id", F.explode(F.sequence(F.col("label").cast("long") * 100, F.col("label").cast("long") * 100 + 3)).alias("gold_id"))
    return run, bridge, expected


_FIRST = f"{f.dense_sql(20)}, {_BRIDGE}, fi as (select drun.query_id, br.gold_id, min(rank) as first_rank from drun join br using (chunk_id) join ex on ex.query_id = drun.query_id and ex.gold_id = br.gold_id group by all)"


@query(f"with {_FIRST} select * from fi")
def gold_id_novelty(spark, sf_dir) -> DataFrame:
    return judge.novel_gold(*_bridge(spark, sf_dir))


@query(f"with {f.dense_sql(1)}, {_BRIDGE.split(', ex as')[0]} select query_id from drun where label * 100 + query_id % 11 in (select gold_id from br)")
def answerable_subset(spark, sf_dir) -> DataFrame:
    """Queries that expect one of eleven gold ids of their label, of which chunks map to seven."""
    _, bridge, _ = _bridge(spark, sf_dir)
    expected = f.vectors(spark, sf_dir).where(F.col("chunk_id") % f.EVERY == 0).select(F.col("chunk_id").alias("query_id"), (F.col("label") * 100 + F.col("chunk_id") % 11).alias("gold_id"))
    return judge.answerable(expected, bridge)


@query(f"with {_FIRST} select query_id, bool_or(gold_id % 100 = 2 and gold_id % 200 < 100) as has_xref from ex group by query_id")
def xref_plain_partition(spark, sf_dir) -> DataFrame:
    _, bridge, expected = _bridge(spark, sf_dir)
    sources = bridge.select(F.col("gold_id").alias("src_id")).unionByName(expected.select(F.col("gold_id").alias("src_id"))).where("src_id % 100 = 2 and src_id % 200 < 100")
    return judge.by_reference(expected, sources)


@query(f"with {_FIRST} select k, round(avg(case when r <= k then 1.0 else 0.0 end), 6) as hr, round(avg(case when r <= k then 1.0 / r else 0.0 end), 6) as mrr, count(*) as n from (select e.query_id, min(first_rank) as r from (select distinct query_id from ex) e left join fi using (query_id) group by e.query_id), (select unnest([1, 5, 10, 20]) as k) group by k")
def hr_mrr_k_spine(spark, sf_dir) -> DataFrame:
    run, bridge, expected = _bridge(spark, sf_dir)
    return metrics.hits_at(judge.novel_gold(run, bridge, expected), expected)


# ---- metrics

_PQ = f"""{f.dense_sql()},
pq as (select query_id, label, max(case when rank <= 1 then rel else 0 end) * 1.0::double as r_at_1, sum(case when rank <= 1 then rel else 0 end) / 1.0::double as p_at_1, max(case when rank <= 5 then rel else 0 end) * 1.0::double as r_at_5, sum(case when rank <= 5 then rel else 0 end) / 5.0::double as p_at_5,
  max(rel) * 1.0::double as r_at_10, sum(rel) / 10.0::double as p_at_10, coalesce(1.0::double / min(case when rel = 1 then rank end), 0) as rr from drun group by query_id, label)"""
_AP = f"""{_PQ}, ap as (select pq.query_id, coalesce(avg(p), 0) as ap from pq left join (select query_id, row_number() over (partition by query_id order by rank) / rank::double as p from drun where rel > 0) h using (query_id) group by pq.query_id),
nd as (select query_id, case when sum(case when b <= 10 then (pow(2, rel) - 1) / log2(b + 1) else 0 end) > 0 then sum((pow(2, rel) - 1) / log2(rank + 1)) / sum(case when b <= 10 then (pow(2, rel) - 1) / log2(b + 1) else 0 end) else 0 end as ndcg
  from (select *, row_number() over (partition by query_id order by rel desc, rank) as b from drun) group by query_id)"""


@query(f"with {_PQ} select round(avg(r_at_1), 6) as r1, round(avg(r_at_5), 6) as r5, round(avg(r_at_10), 6) as r10, round(avg(p_at_1), 6) as p1, round(avg(p_at_5), 6) as p5, round(avg(p_at_10), 6) as p10 from pq")
def recall_precision_at_k(spark, sf_dir) -> DataFrame:
    p = metrics.per_query(f.dense_run(spark, sf_dir))
    return p.agg(*(F.round(F.avg(f"{m}_at_{k}"), 6).alias(f"{m}{k}") for m in "rp" for k in (1, 5, 10)))


@query(f"with {_PQ} select round(avg(rr), 6) as mrr from pq")
def mrr(spark, sf_dir) -> DataFrame:
    return metrics.per_query(f.dense_run(spark, sf_dir)).agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"with {_AP} select query_id, round(ap, 6) as ap from ap")
def map_at_k(spark, sf_dir) -> DataFrame:
    return metrics.average_precision(f.dense_run(spark, sf_dir)).select("query_id", F.round("ap", 6).alias("ap"))


@query(f"with {_AP} select query_id, round(ndcg, 6) as ndcg from nd")
def ndcg_at_k(spark, sf_dir) -> DataFrame:
    return metrics.ndcg(f.dense_run(spark, sf_dir)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"with {_PQ} select query_id, r_at_1, p_at_1, r_at_5, p_at_5, r_at_10, p_at_10, round(rr, 6) as rr from pq")
def per_query_scores(spark, sf_dir) -> DataFrame:
    return metrics.per_query(f.dense_run(spark, sf_dir)).withColumn("rr", F.round("rr", 6))


@query(f"with {_AP} select round(avg(r_at_1), 6) as r_at_1, round(avg(p_at_1), 6) as p_at_1, round(avg(r_at_5), 6) as r_at_5, round(avg(p_at_5), 6) as p_at_5, round(avg(r_at_10), 6) as r_at_10, round(avg(p_at_10), 6) as p_at_10, round(avg(rr), 6) as mrr, round(avg(ap), 6) as map_10, round(avg(ndcg), 6) as ndcg_10, count(*) as n_queries from pq join ap using (query_id) join nd using (query_id)")
def compute_all_metrics(spark, sf_dir) -> DataFrame:
    return metrics.all_metrics(f.dense_run(spark, sf_dir))


@query(f"with {_PQ}, sl as (select *, cast(label as varchar) as qtype, case when query_id % 3 = 0 then 'easy' else 'hard' end as difficulty from pq) select 'overall' as slice_kind, 'all' as slice, round(avg(r_at_5), 6) as mean_value, count(*) as n from sl union all select 'qtype', qtype, round(avg(r_at_5), 6), count(*) from sl group by qtype union all select 'difficulty', difficulty, round(avg(r_at_5), 6), count(*) from sl group by difficulty")
def metrics_grouping_sets(spark, sf_dir) -> DataFrame:
    p = metrics.per_query(f.dense_run(spark, sf_dir), by=("label",))
    p = p.withColumns({"qtype": F.col("label").cast("string"), "difficulty": F.when(F.col("query_id") % 3 == 0, "easy").otherwise("hard")})
    return metrics.sliced(p, ("qtype", "difficulty"), "r_at_5")


_ISLANDS = """{name} as (select {keys}, min(s) as s, max(e) as e from (select *, sum(case when s <= b then 0 else 1 end) over (partition by {keys} order by s, e rows unbounded preceding) as n from (select *, max(e) over (partition by {keys} order by s, e rows between unbounded preceding and 1 preceding) as b from {src})) group by {keys}, n)"""


@query(f"with {f.bm25_sql(10)}, h as (select query_id, c.doc_id, c.char_start as s, cast(c.char_start + length(c.text) as int) as e from run join c using (chunk_id)), {_ISLANDS.format(name='m', keys='query_id, doc_id', src='h')} select * from m")
def merged_spans(spark, sf_dir) -> DataFrame:
    h = f.lexical_run(spark, sf_dir).select("query_id", "doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    return metrics.merged_spans(h, ("query_id", "doc_id"))


_CHARS = f"""{f.bm25_sql(10)}, h as (select query_id, cast(k as int) as k, c.doc_id, c.char_start as s, c.char_start + length(c.text) as e from run join c using (chunk_id), (select unnest([1, 2, 4, 8, 10]) as k) where rank <= k),
gg as (select item_id as query_id, doc_id, g_start as s, g_end as e from g), {_ISLANDS.format(name='m', keys='query_id, k, doc_id', src='h')}, {_ISLANDS.format(name='gm', keys='query_id, doc_id', src='gg')},
cs as (select query_id, k, coalesce(fnd, 0) / greatest(gold_chars, 1)::double as char_recall, coalesce(fnd, 0) / greatest(coalesce(hit_chars, 0), 1)::double as char_precision
  from (select query_id, cast(unnest([1, 2, 4, 8, 10]) as int) as k, gold_chars from (select query_id, sum(e - s) as gold_chars from gm group by all)) left join (select query_id, k, sum(e - s) as hit_chars from m group by all) using (query_id, k)
  left join (select m.query_id, m.k, sum(greatest(0, least(m.e, gm.e) - greatest(m.s, gm.s))) as fnd from m join gm on m.query_id = gm.query_id and m.doc_id = gm.doc_id group by all) using (query_id, k))"""


def _chars(spark, sf_dir):
    gold = f.gold(spark, sf_dir)
    h = retrieve.at_depths(f.lexical_run(spark, sf_dir, g=gold), (1, 2, 4, 8, 10)).select("query_id", "k", "doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e"))
    g = f.gold_spans(spark, sf_dir, gold).select("query_id", "doc_id", F.col("g_start").alias("s"), F.col("g_end").alias("e"))
    return metrics.char_scores(h, g, (1, 2, 4, 8, 10))


@query(f"with {_CHARS} select query_id, k, round(char_recall, 6) as char_recall, round(char_precision, 6) as char_precision from cs")
def char_recall_precision(spark, sf_dir) -> DataFrame:
    return _chars(spark, sf_dir).select("query_id", "k", F.round("char_recall", 6).alias("char_recall"), F.round("char_precision", 6).alias("char_precision"))


@query(f"with {_CHARS} select round(sum(s) / sum(n), 6) as query_weighted, round(avg(m), 6) as equal_weighted, count(*) as n_groups from (select query_id % 4 as grp, sum(char_recall) as s, count(*) as n, avg(char_recall) as m from cs where k = 8 group by all)")
def equal_weight_recall(spark, sf_dir) -> DataFrame:
    return metrics.equal_weight(_chars(spark, sf_dir).where("k = 8").withColumn("grp", F.col("query_id") % 4), "grp", "char_recall")


_MEANS = f"""{_RRF}, me as (select 'dense' as method, 'p_at_10' as metric, round(avg(x), 6) as value from (select query_id, sum(rel) / 10.0::double as x from drun where rank <= 10 group by all)
 union all select 'fused', 'p_at_10', round(avg(x), 6) from (select frun.query_id, sum(ds.rel) / 10.0::double as x from frun join ds on ds.query_id = frun.query_id and ds.chunk_id = frun.chunk_id group by all))"""


def _means(spark, sf_dir):
    v, run = f.vectors(spark, sf_dir), f.dense_run(spark, sf_dir, 40)
    fused = _fused(run).join(v.select("chunk_id", F.col("label").alias("a")), "chunk_id").join(v.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("b")), "query_id")
    both = run.where("rank <= 10").select(F.lit("dense").alias("method"), "query_id", "rank", "rel").unionByName(fused.select(F.lit("fused").alias("method"), "query_id", "rank", (F.col("a") == F.col("b")).cast("int").alias("rel")))
    return metrics.per_query(both, by=("method",)).groupBy("method").agg(F.round(F.avg("p_at_10"), 6).alias("value")).withColumn("metric", F.lit("p_at_10"))


@query(f"with {_MEANS} select f.metric, 'dense' as best_base, f.value, round(f.value - d.value, 6) as delta, round(case when d.value = 0 then case when f.value = 0 then 0.0 else 'inf'::double end else (f.value - d.value) / d.value * 100 end, 6) as pct from me f, me d where f.method = 'fused' and d.method = 'dense'")
def method_lift(spark, sf_dir) -> DataFrame:
    return metrics.lift(_means(spark, sf_dir), "fused")


@query(f"with {f.dense_sql(20)}, ab as (select chunk_id % 2 as chunking, rank % 2 as retrieval, avg(rel) as value from drun group by all), cc as (select max(case when chunking = 0 and retrieval = 0 then value end) as a, max(case when chunking = 1 and retrieval = 0 then value end) as b, max(case when chunking = 0 and retrieval = 1 then value end) as c, max(case when chunking = 1 and retrieval = 1 then value end) as d from ab) select round(b - a, 6) as chunking_effect, round(c - a, 6) as retrieval_effect, round(d - a, 6) as total_effect, round(d - b - c + a, 6) as interaction from cc")
def ablation_2x2(spark, sf_dir) -> DataFrame:
    cells = f.dense_run(spark, sf_dir, 20).groupBy((F.col("chunk_id") % 2).alias("chunking"), (F.col("rank") % 2).alias("retrieval")).agg(F.avg("rel").alias("value"))
    return metrics.ablation(cells)


# ---- chunk quality


@query(f"with {f.CHUNKS}, ln as (select doc_id, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos, line from (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from d))), al as (select distinct chunk_id from c join ln on ln.doc_id = c.doc_id and abs(pos - char_start) <= 80 where regexp_matches(line, '[^ \\t\\n\\r\\f\\v]')) select doc_id, count(*) as n, count(al.chunk_id) as aligned from c left join al using (chunk_id) group by doc_id")
def boundary_precision(spark, sf_dir) -> DataFrame:
    return quality.boundary_precision(f.fixed_chunks(spark, sf_dir), sections.lines_as_sections(f.docs(spark, sf_dir)))


@query(f"with {_STRUCT} select count(*) as n, cast(sum(cast(regexp_matches(text, '^\\s*(?:\\[[^\\]]*\\]\\s*)?(?:Section|Article)\\s+\\d+') as int)) as bigint) as titled from st")
def boundary_by_title(spark, sf_dir) -> DataFrame:
    return quality.titled(f.structural(spark, sf_dir))


@query(f"with {_STRUCT}, ke as (select distinct ed2.doc_id, src_no, dst_no from ed2 join st on st.doc_id = ed2.doc_id and st.section_no = src_no join s t on t.doc_id = ed2.doc_id and cast(t.section_no as varchar) = dst_no where (t.title <> '' and contains(lower(st.text), lower(t.title))) or list_contains(regexp_extract_all(lower(st.text), '\\b(?:section|article)\\s+(\\w+)', 1) || regexp_extract_all(lower(st.text), '§\\s*(\\w+)', 1), lower(dst_no))) select (select count(*) from (select distinct doc_id, src_no, dst_no from ed2)) as n_edges, (select count(*) from ke) as kept")
def xref_preservation(spark, sf_dir) -> DataFrame:
    s = scratch.written(f.lines(spark, sf_dir), "lines")
    return quality.reference_preservation(sections.edges(s), f.structural(spark, sf_dir, s), s)


@query(f"with {f.CHUNKS}, hd as (select c.doc_id, chunk_id, regexp_replace(substring(c.text, 1, 80), '^\\s+|\\s+$', '', 'g') as h, d.text as w from c join d on d.doc_id = c.doc_id where not starts_with(c.text, '[')), pl as (select doc_id, chunk_id, instr(w, h) - 1 as p from hd where h <> ''), ln as (select doc_id, coalesce(sum(length(line) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos, line from (select doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from d))), al as (select distinct chunk_id from pl join ln on ln.doc_id = pl.doc_id and abs(pos - p) <= 80 where regexp_matches(line, '[^ \\t\\n\\r\\f\\v]')) select doc_id, count(*) as n, count(al.chunk_id) as aligned from pl left join al using (chunk_id) group by doc_id")
def boundary_by_text(spark, sf_dir) -> DataFrame:
    """As boundary_precision, of chunks that are looked for by their first characters."""
    c = f.fixed_chunks(spark, sf_dir).where(~F.col("text").startswith("[")).select("doc_id", "chunk_id", "text")
    return quality.boundary_precision_by_text(c, f.docs(spark, sf_dir), sections.lines_as_sections(f.docs(spark, sf_dir)))


@query()
def chunk_coherence(spark, sf_dir) -> DataFrame:
    """Cosine of the halves of the first 200 chunks, by hashed words."""
    return quality.coherence(f.fixed_chunks(spark, sf_dir), encode.HashedWords(64))


@query(f"with {f.LINES}, ck as (select doc_id, case when i = 0 then 1 end as section_no from (select doc_id, unnest(range(0, cast(ceil(length(text) / 500.0) as bigint))) as i from d where length(text) > 0)), t as (select (select count(*) from ck) as first_chunks, (select count(*) from (select distinct doc_id, section_no from ck where section_no is not null)) as first_covered, (select count(*) from s) as second_chunks, (select count(*) from s) as second_covered, (select count(*) from s) as total) select *, round(first_chunks / (first_covered / total::double * 100), 6) as first_per_pct, round(second_chunks / (second_covered / total::double * 100), 6) as second_per_pct, round((1 - second_chunks / first_chunks::double) * 100, 6) as reduction_pct from t")
def chunk_efficiency(spark, sf_dir) -> DataFrame:
    c = f.fixed_chunks(spark, sf_dir).select("doc_id", F.when(F.col("chunk_index") == 0, 1).alias("section_no"))
    s = f.lines(spark, sf_dir)
    return quality.efficiency(c, s.select("doc_id", "section_no"), s)


# ---- statistics: hits within 5 of the dense run against those of the run cut to odd and to early chunks

_PAIRS = f"""{f.dense_sql()}, pa as (select 'odd' as comparison, query_id, max(case when rank <= 5 then rel else 0 end)::double as a, max(case when rank <= 5 and chunk_id % 2 = 1 then rel else 0 end)::double as b from drun group by query_id
 union all select 'early', query_id, avg(rel)::double, avg(case when rank <= 3 then rel else 0 end)::double from drun group by query_id
 union all select 'same', query_id, max(rel)::double, max(rel)::double from drun group by query_id)"""
_WIL = f"""{_PAIRS}, dd as (select comparison, a - b as d, round(abs(a - b), 12) as m from pa where a <> b),
rk as (select *, rank() over (partition by comparison order by m) + (count(*) over (partition by comparison, m) - 1) / 2.0::double as r, count(*) over (partition by comparison, m) as t from dd),
wi as (select comparison, count(*) as n, sum(cast(d > 0 as int)) as n_plus, sum(case when d > 0 then r else 0 end) as wp, sum(case when d < 0 then r else 0 end) as wm, sum(t::double * t - 1) as ties from rk group by comparison),
wz as (select p.comparison, coalesce(n, 0) as n, coalesce(n_plus, 0) as n_plus, coalesce(n, 0) - coalesce(n_plus, 0) as n_minus, coalesce(least(wp, wm), 0) as statistic, coalesce((wp - n * (n + 1) / 4.0::double) / nullif(sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0), 0) as z from (select distinct comparison from pa) p left join wi using (comparison))"""


def _pairs(spark, sf_dir):
    run = f.dense_run(spark, sf_dir)
    hit = lambda cond: F.max(F.when(cond, F.col("rel")).otherwise(0)).cast("double")
    near = F.col("rank") <= 5
    odd = run.groupBy("query_id").agg(hit(near).alias("a"), hit(near & (F.col("chunk_id") % 2 == 1)).alias("b")).withColumn("comparison", F.lit("odd"))
    early = run.groupBy("query_id").agg(F.avg("rel").alias("a"), F.avg(F.when(F.col("rank") <= 3, F.col("rel")).otherwise(0)).alias("b")).withColumn("comparison", F.lit("early"))
    same = run.groupBy("query_id").agg(hit(F.lit(True)).alias("a"), hit(F.lit(True)).alias("b")).withColumn("comparison", F.lit("same"))
    return odd.unionByName(early).unionByName(same)


@query(f"with {_WIL} select comparison, cast(n as bigint) as n, cast(n_plus as bigint) as n_plus, cast(n_minus as bigint) as n_minus, round(statistic, 6) as statistic, round(z, 6) as z from wz")
def wilcoxon_z(spark, sf_dir) -> DataFrame:
    return stats.wilcoxon(_pairs(spark, sf_dir)).withColumns({"statistic": F.round("statistic", 6), "z": F.round("z", 6)})


_P = "pv as (select vec_id as test_id, vec_id % 4 as family, round(((vec_id * 7919) % 1009) / 1010.0::double + 0.0001, 9) as p from embeddings)"


@query(f"with {_P}, rn as (select *, count(*) over (partition by family) as n, row_number() over (partition by family order by p, test_id) as r from pv) select test_id, family, p, round(min(least(p * n / r, 1.0)) over (partition by family order by r desc), 9) as p_adjusted from rn")
def bh_adjust(spark, sf_dir) -> DataFrame:
    p = F.round(((F.col("vec_id") * 7919) % 1009) / 1010.0 + 0.0001, 9)
    rows = f.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("test_id"), (F.col("vec_id") % 4).alias("family"), p.alias("p"))
    return stats.benjamini_hochberg(rows, family=("family",)).withColumn("p_adjusted", F.round("p_adjusted", 9))


@query(f"with {_PAIRS} select comparison, round(avg(a - b), 6) as mean_diff, round(case when coalesce(stddev_samp(a - b), 0) < 1e-15 then case when avg(a - b) = 0 then 0.0 else 'inf'::double end else avg(a - b) / stddev_samp(a - b) end, 6) as d from pa group by comparison")
def cohens_d(spark, sf_dir) -> DataFrame:
    return stats.cohens_d(_pairs(spark, sf_dir)).select("comparison", F.round("mean_diff", 6).alias("mean_diff"), F.round("d", 6).alias("d"))


@query()
def bootstrap_ci(spark, sf_dir) -> DataFrame:
    return stats.bootstrap(_pairs(spark, sf_dir))


@query()
def significance_table(spark, sf_dir) -> DataFrame:
    return stats.significance(_pairs(spark, sf_dir))


@query("select vec_id, case when p < 0.0001 then '≤0.0001' when p < 0.001 then printf('%.4f', p) else printf('%.3f', p) end as p_text from (select vec_id, pow(10, -(vec_id % 6)) * (1 + vec_id % 8) / 9.7 as p from embeddings)")
def p_format(spark, sf_dir) -> DataFrame:
    p = F.pow(F.lit(10.0), -(F.col("vec_id") % 6)) * (1 + F.col("vec_id") % 8) / 9.7
    return f.table(spark, sf_dir, "embeddings").select("vec_id", T.format_p(p).alias("p_text"))


# ---- the whole way


@query(f"{_SPANS}, pq as (select sp.query_id, max(case when k <= 1 then coalesce(rel.rel, 0) else 0 end) * 1.0::double as r1, max(case when k <= 5 then coalesce(rel.rel, 0) else 0 end) * 1.0::double as r5, max(coalesce(rel.rel, 0)) * 1.0::double as r10, coalesce(1.0::double / min(case when rel.rel = 1 then k end), 0) as rr from (select query_id, k from q, (select unnest(range(1, 11)) as k)) sp left join rel on rel.query_id = sp.query_id and rel.rank = k group by sp.query_id) select round(avg(r1), 6) as r_at_1, round(avg(r5), 6) as r_at_5, round(avg(r10), 6) as r_at_10, round(avg(rr), 6) as mrr, count(*) as n_queries from pq")
def span_benchmark(spark, sf_dir) -> DataFrame:
    """Gold passages, fixed chunks, BM25, overlap judgement, recall and reciprocal rank: the flagship."""
    g = f.gold(spark, sf_dir)
    rel = judge.spine(f.asked(spark, sf_dir, g), _span_relevance(spark, sf_dir, g), 10)
    p = metrics.per_query(rel)
    return p.agg(*(F.round(F.avg(f"r_at_{k}"), 6).alias(f"r_at_{k}") for k in (1, 5, 10)), F.round(F.avg("rr"), 6).alias("mrr"), F.count(F.lit(1)).alias("n_queries"))
