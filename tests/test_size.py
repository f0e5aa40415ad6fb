"""What must not grow faster than the input: rows that are shuffled, and rows that one task or one batch holds."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from folioscope.operators import chunk, judge, quality, retrieve, sections, stats
from folioscope.plans import frames as f
from folioscope.sources import scratch


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_hints(spark):
    """Nothing is broadcast but what a query asks to."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def some_text(rng, n, words="ab cd ef gh ij kl mn op qr st"):
    return " ".join(rng.choice(words.split()) for _ in range(n))


def test_chunks_are_scored_where_they_are_read(spark, no_hints, monkeypatch):
    rng = random.Random(1)
    chunks = spark.createDataFrame([(k, some_text(rng, 30)) for k in range(2000)], "chunk_id long, text string").coalesce(2)
    queries = spark.createDataFrame([(k, some_text(rng, 4)) for k in range(10)], "query_id long, text string")
    for variant in ("lucene", "okapi"):
        seen, written = [], retrieve.scratch.written
        with monkeypatch.context() as m:
            m.setattr(retrieve.scratch, "written", lambda df, name, seen=seen, written=written: (seen.append(plan(df)), written(df, name))[1])
            m.setattr(retrieve, "top", lambda scored, k: scored)
            scored = retrieve.bm25(chunks, queries, 5, variant)
        assert not re.search(r"Exchange hashpartitioning\([^)]*chunk_id", "".join(seen)), "terms of chunks are counted before they are shuffled"
        assert "Exchange" not in plan(scored) and scored.count() <= 10 * 5 * 2, "a task gives the best of each query"


@pytest.mark.parametrize("variant", ["lucene", "okapi"])
def test_scores_in_a_table_and_in_a_list(spark, monkeypatch, variant):
    rng = random.Random(2)
    chunks = spark.createDataFrame([(k, some_text(rng, rng.randrange(0, 20)) if k else None) for k in range(300)], "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(f"q{k}", some_text(rng, 5) + " zz") for k in range(20)], "query_id string, text string")
    rows = lambda: sorted(tuple(r) for r in retrieve.bm25(chunks, queries, 7, variant).collect())
    want = rows()
    assert len(want) == 20 * 7
    monkeypatch.setattr(retrieve, "TABLE", 0)
    monkeypatch.setattr(retrieve, "CELLS", 50)
    assert rows() == want


def test_documents_are_searched_where_they_are_read(spark, no_hints, monkeypatch):
    rng = random.Random(3)
    texts = [some_text(rng, 40, "one two three four five six seven eight nine ten eleven") for _ in range(300)]
    items = [t[5:70] for t in texts[:30]] + [some_text(rng, 9, "one two three four") for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(k, d, t.index(x), t.index(x) + len(x)) for k, x in enumerate(items) for d, t in enumerate(texts) if x in t}
    found = judge.passages(rows, docs)
    assert "Exchange hashpartitioning" not in plan(found)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    monkeypatch.setattr(judge, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in judge.passages(rows, docs).collect()} == want


def test_only_chunks_that_are_hit_are_shuffled(spark, no_hints):
    run = spark.createDataFrame([(1, 1, 5), (1, 2, 600)], "query_id long, rank int, chunk_id long")
    chunks = spark.range(500).selectExpr("id as chunk_id", "cast(id as string) as text")
    rows = retrieve.looked_up(run, chunks)
    assert re.search(r"BroadcastHashJoin \[chunk_id#\d+L\], \[chunk_id#\d+L\], LeftSemi", plan(rows))
    assert sorted((r["rank"], r["text"]) for r in rows.collect()) == [(1, "5"), (2, "")]


def test_a_task_gives_the_best_of_its_vectors(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    x[200:] = x[3]  # copies: ties go to the smaller ids
    v = spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)], "chunk_id long, vector array<float>").coalesce(1)
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 16)
    s = np.round(x.astype(np.float64) @ x.astype(np.float64).T, 12)
    want = {(i, r + 1, int(j)) for i in range(0, 600, 20) for r, j in enumerate([j for j in np.lexsort((np.arange(600), -s[i])) if j != i][:7])}
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in retrieve.dense(v, q, 7, True).collect()} == want
    monkeypatch.setattr(retrieve, "top", lambda scored, k: scored)
    scored = retrieve.dense(v, q, 7, True)
    assert scored.count() == 30 * 7 and "Join" not in plan(scored), "no pairs of blocks, and not the best of each block"


def test_adjusted_p(spark):
    rng = random.Random(4)
    rows = [(k, k % 2, rng.choice([None, 0.0, 0.001, 0.01, 0.02, 0.3, 0.9, 1.0]) if k % 3 else rng.random()) for k in range(400)]
    tests = spark.createDataFrame(rows, "test_id long, family int, p double")
    got = stats.benjamini_hochberg(tests, family=("family",))
    want = {}
    for part in (0, 1):
        mine = sorted((r for r in rows if r[1] == part), key=lambda r: (-1 if r[2] is None else r[2], r[0]))
        least = 1.0
        for rank in range(len(mine), 0, -1):
            test, _, p = mine[rank - 1]
            want[test] = least = min(least, 1.0 if p is None else p * len(mine) / rank)
    assert {r["test_id"]: r["p_adjusted"] for r in got.collect()} == want
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString(), "such a frame is read again for every row"


def one_pass(df) -> bool:
    """Nothing is shuffled, and the rows are read and given to Python once."""
    p = plan(df)
    return "Exchange" not in p and p.count("MapInArrow") == 1 and "EvalPython" not in p and p.count("Scan") == 1


def test_documents_are_parsed_in_one_pass(spark, sf_dir):
    d = sections.parsed(f.statutes(spark, sf_dir))
    assert all(map(one_pass, (d.sections, d.chapters, d.section_content("5"))))


def test_contracts_are_cut_in_one_pass(spark, sf_dir):
    assert one_pass(chunk.contracts(f.agreements(spark, sf_dir)))


def test_headings_are_those_of_the_patterns():
    rng = random.Random(0)
    parts = ["1. ", "12A. ", "Abcd", "Heading of", "—", ".—", " ", "\n", "\n\n", "CHAPTER II\n", "\nArticle 1\n", "\nArticle 22b\n", "Title words\n", "3.\n", "\n4. Bcde—", "\t"]
    whole = [re.compile(p.replace("END", r"\Z"), re.DOTALL) for p in (sections.SECTION, sections.ARTICLE)]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        want = next((x for p in whole if (x := [(m[1], m[2].strip(), m[3], m.start()) for m in p.finditer(text)])), [])
        assert [x[1:] for x in sections.grammar(text) if x[0] == "section"] == want


def test_a_python_batch_is_a_few_documents(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "concat('1. Title of it—', repeat('words ', 200)) as text").coalesce(1)
    rows = sections.by_document(docs, lambda text: [(len(text),)], "n int")
    assert rows.selectExpr("sum(n)").first()[0] == sum(len("1. Title of it—") + 1200 for _ in range(1000))
    assert sections.DOCS_AT_ONCE <= 1000


def test_a_chunk_is_shuffled_once(spark, sf_dir, no_hints):
    s = scratch.written(f.lines(spark, sf_dir), "lines")
    assert "Exchange" not in plan(f.lines(spark, sf_dir)), "lines are counted in their document's row"
    got = quality.reference_preservation(sections.edges(s), f.structural(spark, sf_dir, s), s)
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    kept = plan(got)
    assert kept.count("Exchange hashpartitioning(doc_id") <= 12 and tree.count("Window") == 1
