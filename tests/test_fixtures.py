"""Hand-made cases, against values worked out by hand or plain versions from the definitions."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import chunk, encode, judge, metrics, quality, retrieve, sections, stats
from folioscope.sources import scratch

STATUTE = """Some cover page
THE SMALL CLAIMS ACT, 1999
CHAPTER I
PRELIMINARY
1. Short title—This Act may be called so.
It runs over
two lines.
2. Definitions .— In this Act, subject to the provisions of section 3, words matter.
CHAPTER II
Of Claims
3. Claims—See section 1, under section 2, Section 12A and Order IV; rule 1.
12A. Late claims—Notwithstanding anything contained in section 3 they lapse.
CHAPTER II
Of Later Claims
2. Definitions again—The last one counts."""


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_statute(spark):
    d = sections.parsed(frame(spark, STATUTE))
    rows = {r["section_no"]: r for r in d.sections.collect()}
    assert set(rows) == {"1", "2", "3", "12A"}
    assert rows["1"]["content"] == "This Act may be called so. It runs over two lines."
    assert (rows["2"]["title"], rows["2"]["content"]) == ("Definitions again", "The last one counts.")
    assert rows["2"]["ord"] == STATUTE.index("2. Definitions .") and rows["2"]["char_start"] == STATUTE.index("2. Definitions again")
    assert (rows["1"]["chapter_no"], rows["1"]["chapter_title"]) == ("I", "PRELIMINARY")
    assert (rows["12A"]["chapter_no"], rows["12A"]["chapter_title"]) == ("II", "Of Later Claims"), "of a number's titles the last counts"
    assert {(r["chapter_no"], r["title"]) for r in d.chapters.collect()} == {("I", "PRELIMINARY"), ("II", "Of Later Claims")}
    assert d.titles.first()["title"] == "SMALL CLAIMS ACT"
    edges = {(r["src_no"], r["dst_no"]) for r in d.edges.collect()}
    assert edges == {("3", "1"), ("3", "2"), ("3", "12A"), ("12A", "3")}
    assert [r["section_no"] for r in d.cross_references("12A").collect()] == ["3"]
    assert d.section_content("3", False).first()["text"].startswith("See section 1")
    first = {r["section_no"]: r["content"] for r in sections.parsed(frame(spark, STATUTE), compat=True).sections.collect()}
    assert first["1"] == "This Act may be called so.", "content ends with its first line"


def test_regulation_and_plain_text(spark):
    text = "Recitals\nArticle 1\nSubject matter\nIt lays down\nrules.\nArticle 2\nScope of it\nIt applies.\nCHAPTER II\nPrinciples"
    d = sections.parsed(frame(spark, text, "nothing here", None, ""))
    assert {(r["doc_id"], r["section_no"], r["title"], r["content"]) for r in d.sections.collect()} == {(0, "1", "Subject matter", "It lays down rules."), (0, "2", "Scope of it", "It applies.")}
    assert {r["doc_id"]: r["title"] for r in d.titles.collect()}[1] == "Legal Document"


def test_reference_order(spark):
    text = "section 9 and rule 4, under section 8, Referred to in Section 7, notwithstanding anything contained in section 6; subject to section 5, order iv, SECTION 12a"
    got = frame(spark, text).select(T.references(F.col("text")).alias("a"), T.references(F.col("text"), T.PARSED_REFERENCES).alias("b")).first()
    assert got["a"] == ["5", "6", "8", "7", "9", "12a", "iv", "4"]
    assert got["b"] == ["9", "8", "7", "6", "5", "12a", "iv", "4"]


def test_mentions(spark):
    texts = ["§7", " §7", "a§7", "é§7", "Section 77", "see Article 7."]
    strict = [r[0] for r in frame(spark, *texts).orderBy("doc_id").select(T.mentioned_sections(F.col("text"))).collect()]
    assert strict == [["7"], ["7"], [], [], ["77"], ["7"]]
    compat = [r[0] for r in frame(spark, *texts).orderBy("doc_id").select(T.mentioned_sections(F.col("text"), compat=True)).collect()]
    assert compat == [[], [], ["7"], ["7"], ["77"], ["7"]]


@pytest.mark.parametrize(("path", "text", "want"), [("a/Privacy_QA/x", "", "privacyqa"), ("contract_nli/a", "merger", "contractnli"), ("x", "the agenda", "contractnli"), ("x", "a Non-Disclosure", "contractnli"), ("x", "data practice", "privacyqa"), ("x", "M&A deal", "maud"), ("x", "confidential", "cuad"), ("x", "privacy nda", "contractnli")])
def test_subdataset(spark, path, text, want):
    assert spark.range(1).select(T.subdataset(F.lit(path), F.lit(text))).first()[0] == want


def test_same_file(spark):
    pairs = [("a/x.txt", "a/x.txt", True), ("a/x.txt", "b/x.txt", True), ("root/a/x.txt", "a/x.txt", True), ("a/x.txt", "a/y.txt", False), ("", "a/y.txt", True)]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string, w boolean").select(T.same_file(F.col("a"), F.col("b")) == F.col("w")).collect()] == [True] * 5


# ---- chunkers


def plain_merge(pieces, separator, size, overlap):
    out, now, length = [], [], 0
    for p in pieces:
        n = len(p) + len(separator)
        if length + n > size and now:
            out.append(separator.join(now))
            tail = out[-1][len(out[-1]) - min(overlap, len(out[-1])) :]
            now, length = ([tail], len(tail)) if tail else ([], 0)
        now.append(p)
        length += n
    return out + ([separator.join(now)] if now else [])


def test_pieces_are_joined_as_one_by_one():
    rng = random.Random(1)
    for _ in range(400):
        pieces = ["x" * rng.randrange(1, 40) + str(k) for k in range(rng.randrange(0, 40))]
        size, overlap, sep = rng.choice((10, 50, 120)), rng.choice((0, 5, 20, 49)), rng.choice(("\n\n", " ", ". "))
        assert chunk.join_pieces(pieces, sep, size, overlap) == plain_merge(pieces, sep, size, overlap)


def plain_windows(sizes, limit, carry):
    out, now, total = [], [], 0
    for k, n in enumerate(sizes):
        if total + n > limit and now:
            out.append((now[0], now[-1] + 1))
            kept, held = [], 0
            for u in now[::-1]:
                if held + sizes[u] > carry:
                    break
                kept, held = [u, *kept], held + sizes[u]
            now, total = kept, held
        now.append(k)
        total += n
    return out + ([(now[0], now[-1] + 1)] if now else [])


def test_windows_are_those_of_one_unit_after_another():
    rng = random.Random(2)
    for _ in range(500):
        sizes = [rng.randrange(0, 30) for _ in range(rng.randrange(0, 30))]
        limit, carry = rng.choice((10, 40, 100)), rng.choice((0, 3, 9, 39))
        assert chunk.windows(sizes, limit, carry) == plain_windows(sizes, limit, carry)


def test_split_cases(spark):
    texts = ["", " \n\xa0", "ab " * 10, "word " * 1000, "x" * 5000, "one\n" * 900, "a. b. " * 500, "\xa0tight\xa0", "p\n\n" * 900, None]
    got: dict = {}
    for r in chunk.recursive(frame(spark, *texts), 128, 0.1).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert 0 not in got and 1 not in got and 9 not in got and got[2] == [texts[2].strip()] and got[7] == ["tight"]
    assert got[4] == [texts[4][k : k + 512] for k in range(0, 5000, 512 - 51)]
    for k, sep in ((3, " "), (5, "\n"), (6, ". "), (8, "\n\n")):
        assert got[k] == plain_merge([x.strip() for x in texts[k].split(sep) if x.strip()], sep, 512, 51)
    deep = [r["text"] for r in chunk.recursive(frame(spark, "a" * 300 + "\n\n" + "b c " * 500), 64, 0.1, compat=False).collect()]
    assert all(len(x) <= 256 + 25 for x in deep)


def test_long_sections(spark):
    text = "[crumb]\nSection 1. T\n\n" + "First sentence here. " * 40 + "\n\nshort\n\n" + "Other one! (Yes) " * 60
    rows = spark.createDataFrame([(1, "short text"), (2, text)], "doc_id long, text string")
    got = [r["text"] for r in chunk.structural_sized(rows, 32, 0.25).where("doc_id = 2").orderBy("part").collect()]
    units = []
    for p in (x.strip() for x in text.split("\n\n") if x.strip()):
        units += [p] if len(p) // 4 <= 48 else [s.strip() for s in re.split(T.SENTENCE_END, p) if s.strip()]
    assert got == ["\n\n".join(units[a:b]) for a, b in plain_windows([len(u) // 4 for u in units], 32, 8)]
    assert chunk.structural_sized(rows, 32).where("doc_id = 1").count() == 1


def test_contract(spark):
    body = "The buyer pays as Section 2 and section 1.1 and Section 2 say. "
    text = "PREAMBLE text\n1. Payment terms of it\n" + body + "\n1.1 Delivery of goods\nSoon.\n2. Long section here\n" + "words of a clause " * 300
    rows = chunk.contracts(frame(spark, text, "flat text " * 400)).orderBy("doc_id", "char_start").collect()
    one = [r for r in rows if r["doc_id"] == 0]
    assert (one[0]["char_start"], one[0]["text"]) == (0, "PREAMBLE text")
    assert one[1]["text"] == "[Contract > 1. Payment terms of it]\n1. Payment terms of it\n" + body.strip() + "\n[References: Sections 2, 1.1]"
    assert one[1]["char_start"] == text.index("\n1. Payment") and one[1]["char_end"] == text.index("\n1.1 Del")
    halves = one[3:]
    assert len(halves) == 2 and halves[0]["char_end"] == halves[1]["char_start"] and halves[1]["char_end"] == len(text)
    flat = [r for r in rows if r["doc_id"] == 1]
    assert all(not r["has_structure"] and r["char_end"] - r["char_start"] == len(r["text"]) for r in flat)
    old = chunk.contracts(frame(spark, text), strict=False).orderBy("char_start").collect()
    assert old[0]["text"].startswith("[Contract > 1. Pay"), "the preamble is left out"
    whole = [r for r in old if "Long section" in r["title"]]
    assert (text.index("\n2. Long"), len(text)) in {(r["char_start"], r["char_end"]) for r in whole}, "the first half claims the whole section"


def test_pools(spark):
    files = spark.createDataFrame([("a/x.txt", "y" * 1200), ("top.txt", "z"), ("a/blank.txt", " \n"), ("b/c.txt", "1. Some heading\ntext")], "path string, text string")
    rows = chunk.pools(files).collect()
    assert {r["doc_id"] for r in rows} == {"a/x.txt", "b/c.txt"}
    assert [(r["char_start"], r["char_end"]) for r in sorted((r for r in rows if r["method"] == "fixed" and r["doc_id"] == "a/x.txt"), key=lambda r: r["char_start"])] == [(0, 500), (500, 1000), (1000, 1200)]


def test_statute_references_are_cut_before_they_are_checked(spark):
    rows = [("L-1", "L", "1", "one", ["L-9", "L-1", "L-2", "L-3"]), ("L-2", "L", "2", "two", []), ("L-3", "L", "3", "x" * 300, ["L-2"]), ("L-4", "L", "4", " ", [])]
    got = {r["section_id"]: r["text"] for r in chunk.statute_augmented(spark.createDataFrame(rows, "section_id string, law_name string, section_num string, text string, cross_refs array<string>")).collect()}
    assert got == {"L-1": "[L > มาตรา 1]\none\n[ข้อความอ้างอิง:]\n→ มาตรา 2: two…", "L-2": "[L > มาตรา 2]\ntwo", "L-3": "[L > มาตรา 3]\n" + "x" * 300 + "\n[ข้อความอ้างอิง:]\n→ มาตรา 2: two…"}


def test_sentences(spark):
    text = "Rs. 500 are due. (See it.) Then? Yes!  No. lower stays"
    assert frame(spark, text).select(T.sentences(F.col("text"))).first()[0] == [s.strip() for s in re.split(T.SENTENCE_END, text) if s.strip()]


# ---- retrieval, judgement, metrics


def test_bm25_both_ways_and_padding(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(rng.randrange(1, 20))) for _ in range(60)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "ab cd ab"), (2, "kl"), (3, "zz")], "query_id long, text string")
    n, avg = len(texts), sum(len(t.split()) for t in texts) / len(texts)

    def score(q, t):
        words = t.split()
        out = 0.0
        for term in q.split():
            df, tf = sum(term in x.split() for x in texts), words.count(term)
            out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        return out

    want = {(q, r + 1, k) for q, t in ((1, "ab cd ab"), (2, "kl")) for r, k in enumerate(sorted((k for k in range(n) if score(t, texts[k]) > 0), key=lambda k: (-round(score(t, texts[k]), 12), k))[:10])}
    for limit in (retrieve.BROADCAST_ROWS, 0):
        monkeypatch.setattr(retrieve, "BROADCAST_ROWS", limit)
        got = {(r["query_id"], r["rank"], r["chunk_id"]) for r in retrieve.bm25(chunks, queries).collect()}
        assert got == want
    full = retrieve.bm25(chunks, queries, pad=True).collect()
    assert sorted(r["rank"] for r in full if r["query_id"] == 3) == list(range(1, 11)) and {r["chunk_id"] for r in full if r["query_id"] == 3} == set(range(10))


def test_only_asked_terms_are_shuffled(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "a b")], "chunk_id long, text string")
    seen = []
    written = retrieve.scratch.written
    monkeypatch.setattr(retrieve.scratch, "written", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), written(df, name))[1])
    retrieve.bm25(chunks, spark.createDataFrame([(1, "aa bb")], "query_id long, text string"))
    plan = seen[-1]
    assert re.search(r"BroadcastHashJoin \[term#\d+\], \[term#\d+\], LeftSemi", plan)


def test_dense_both_ways(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(500, 8)).astype(np.float32)
    v = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)], "chunk_id long, vector array<float>").repartition(3)
    q = v.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    s = x.astype(np.float64) @ x.astype(np.float64).T
    want = {(i, r + 1, int(j)) for i in range(0, 500, 10) for r, j in enumerate([j for j in np.lexsort((np.arange(500), -s[i])) if j != i][:7])}
    for limit in (retrieve.BROADCAST_ROWS, 0):
        monkeypatch.setattr(retrieve, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(retrieve, "QUERY_BLOCK", 16)
        monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 64)
        assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in retrieve.dense(v, q, 7, True).collect()} == want


def test_hybrid_without_vectors_and_ties(spark):
    d = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id long, rank int, chunk_id long")
    s = spark.createDataFrame([(1, 1, 11), (1, 2, 10), (1, 3, 12)], "query_id long, rank int, chunk_id long")
    assert [r["chunk_id"] for r in retrieve.fuse(d, s).orderBy("rank").collect()] == [10, 11, 12], "of a tie the dense rank decides"
    chunks = spark.createDataFrame([(1, "aa bb"), (2, "cc")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "cc")], "query_id long, text string")
    assert [r["chunk_id"] for r in retrieve.hybrid(None, None, chunks, queries).collect()] == [2]


def test_missing_hits_stay(spark):
    run = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "query_id long, rank int, chunk_id long")
    rows = retrieve.looked_up(run, spark.createDataFrame([(5, "t")], "chunk_id long, text string")).orderBy("rank").collect()
    assert [r["text"] for r in rows] == ["t", ""]


def test_ranking_metrics(spark):
    rows = [(1, k, int(k in (1, 8))) for k in range(1, 11)] + [(2, k, int(k == 10)) for k in range(1, 11)] + [(3, k, 0) for k in range(1, 11)]
    rel = spark.createDataFrame(rows, "query_id long, rank int, rel int")
    ap = {r["query_id"]: r["ap"] for r in metrics.average_precision(rel).collect()}
    assert ap == pytest.approx({1: (1 + 2 / 8) / 2, 2: 0.1, 3: 0.0})
    cumulative = {r["query_id"]: r["ap"] for r in metrics.average_precision(judge.cumulative(rel)).collect()}
    assert cumulative == pytest.approx({1: 1.0, 2: 0.1, 3: 0.0})
    per = {r["query_id"]: r for r in metrics.per_query(rel).collect()}
    assert [per[q]["rr"] for q in (1, 2, 3)] == pytest.approx([1.0, 0.1, 0.0]) and per[1]["p_at_10"] == 0.2 and per[2]["r_at_5"] == 0.0
    nd = {r["query_id"]: r["ndcg"] for r in metrics.ndcg(rel).collect()}
    assert nd[1] == pytest.approx((1 + 1 / math.log2(9)) / (1 + 1 / math.log2(3))) and nd[3] == 0.0


def test_character_scores(spark):
    gold = spark.createDataFrame([(1, "a", 0, 10), (1, "a", 5, 20), (1, "b", 0, 10), (2, "a", 0, 5)], "query_id long, doc_id string, s int, e int")
    hits = spark.createDataFrame([(1, 1, "a", 10, 30), (1, 2, "a", 10, 30), (1, 2, "a", 10, 30)], "query_id long, k int, doc_id string, s int, e int")
    got = {(r["query_id"], r["k"]): (r["char_recall"], r["char_precision"]) for r in metrics.char_scores(hits, gold, (1, 2)).collect()}
    assert got == {(1, 1): (10 / 30, 10 / 20), (1, 2): (10 / 30, 10 / 20), (2, 1): (0.0, 0.0), (2, 2): (0.0, 0.0)}, "a query without hits scores 0"
    raw = {(r["query_id"], r["k"]): r["char_precision"] for r in metrics.char_scores(hits, gold, (1, 2), raw_precision=True).collect()}
    assert raw[1, 2] == 10 / 40


def test_merged_spans(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 2, 3), (1, 10, 12), (1, 10, 12), (1, 20, 20)], "q long, s int, e int")
    assert sorted(tuple(r) for r in metrics.merged_spans(spans, ("q",)).collect()) == [(1, 0, 8), (1, 10, 12), (1, 20, 20)]


def test_short_and_long_passages(spark, monkeypatch):
    texts = ["one two three four five six seven eight nine", "a\ttwo  three", None, "", "ne two three four five six seven eigh"]
    items = ["two", "ne two three four five six seven eigh", "three four five six seven eight nine ten", "", "two three", "o  t", "nine"]
    docs = frame(spark, *texts)
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(k, d, t.index(x), t.index(x) + len(x)) for k, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t}
    for block in (5000, 2):
        monkeypatch.setattr(judge, "ITEM_BLOCK", block)
        assert {tuple(r) for r in judge.passages(rows, docs).collect()} == want


def test_novelty(spark):
    run = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id long, rank int, chunk_id long")
    bridge = spark.createDataFrame([(10, "g"), (11, "g"), (12, "h")], "chunk_id long, gold_id string")
    expected = spark.createDataFrame([(1, "g"), (1, "h")], "query_id long, gold_id string")
    assert sorted(tuple(r) for r in judge.novel_gold(run, bridge, expected).collect()) == [(1, "g", 1), (1, "h", 3)]


# ---- statistics, quality, cache


def pairs_of(spark):
    rng = np.random.default_rng(0)
    rows = [("mixed", k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.random(80) > 0.3, rng.random(80) > 0.6, strict=True))]
    rows += [("same", k, 1.0, 1.0) for k in range(20)] + [("better", k, 1.0, 0.0) for k in range(20)]
    return spark.createDataFrame(rows, "comparison string, query_id long, a double, b double")


def test_significance_block(spark):
    pairs = pairs_of(spark)
    rows = {r["comparison"]: r for r in stats.significance(pairs, intervals=stats.row_bootstrap).collect()}
    d = np.array([r["a"] - r["b"] for r in pairs.where("comparison = 'mixed'").orderBy("query_id").collect()])
    plus, minus = (d > 0).sum(), (d < 0).sum()
    assert rows["mixed"]["z"] == pytest.approx((plus - minus) / math.sqrt(plus + minus))
    p = {"mixed": math.erfc(abs(plus - minus) / math.sqrt(plus + minus) / math.sqrt(2)), "same": 1.0, "better": math.erfc(math.sqrt(20) / math.sqrt(2))}
    order = sorted(p, key=p.get)
    adjusted, least = {}, 1.0
    for rank in (3, 2, 1):
        adjusted[order[rank - 1]] = least = min(least, p[order[rank - 1]] * 3 / rank)
    assert {k: r["p_adjusted"] for k, r in rows.items()} == pytest.approx(adjusted)
    np.random.seed(42)
    means = [np.mean(np.random.choice(d, size=len(d), replace=True)) for _ in range(1000)]
    assert (rows["mixed"]["low"], rows["mixed"]["high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-12)
    assert rows["mixed"]["d"] == pytest.approx(d.mean() / d.std(ddof=1)) and rows["better"]["d"] == math.inf and rows["same"]["d"] == 0
    by_counts = {r["comparison"]: r for r in stats.bootstrap(pairs).collect()}
    assert by_counts["mixed"]["low"] == pytest.approx(rows["mixed"]["low"], abs=0.03) and by_counts["same"]["low"] == 0 == by_counts["same"]["high"]
    assert rows["mixed"]["latex"].endswith("\\\\") and " & " in rows["mixed"]["latex"]


@pytest.mark.parametrize(("p", "want"), [(0.00009, "≤0.0001"), (0.0001, "0.0001"), (0.0009, "0.0009"), (0.001, "0.001"), (0.25, "0.250")])
def test_p_format(spark, p, want):
    assert spark.range(1).select(T.format_p(F.lit(p))).first()[0] == want


def test_quality_report(spark):
    docs = frame(spark, STATUTE)
    d = sections.parsed(docs)
    rec = chunk.recursive(docs, 30, 0.15)
    struc = chunk.structural(d.sections, chunk.top_references(sections.edges(d.sections), d.sections), "Small Claims Act")
    out = quality.report(docs, d.sections, d.edges, rec, struc, encode.HashedWords(32))
    assert out["boundary_precision"]["structural"] == 100.0 and 0 <= out["boundary_precision"]["recursive"] <= 100
    assert out["cross_ref_preservation"]["structural"] == {"rate_pct": 100.0, "preserved": 4, "total": 4}
    assert out["cross_ref_preservation"]["recursive"]["preserved"] == 0
    assert out["chunk_count_efficiency"]["structural"]["coverage_pct"] == 100.0 and out["chunk_count_efficiency"]["total_sections"] == 4
    assert quality.boundaries(struc, docs, d.sections, compat=True).first()["share"] == 1.0
    titled = d.sections.withColumn("char_start", F.lit(None).cast("int"))
    assert quality.boundaries(struc, docs, titled).first()["share"] == 1.0, "by title: a breadcrumb that names a section"


def test_vector_cache(spark):
    path, e = scratch.path(spark, "test-vectors"), encode.HashedWords(16)
    a = frame(spark, "x y", "x y", None, "")
    first = {r["doc_id"]: r["vector"] for r in encode.cached(a, "doc_id", e, path).collect()}
    assert len(first) == 4 and spark.read.parquet(path).count() == 2
    again = {r["doc_id"]: r["vector"] for r in encode.cached(a, "doc_id", e, path).collect()}
    assert again == first and spark.read.parquet(path).count() == 2
