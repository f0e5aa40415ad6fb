"""Sources, sinks and the experiments from end to end, over small files."""

from __future__ import annotations

import json
import random

import pytest

from folioscope import __main__ as cli
from folioscope import api
from folioscope.operators import sampling
from folioscope.plans import pipelines
from folioscope.sources import files, sinks
from test_fixtures import STATUTE


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


QUERIES = [{"query": "about nda", "snippets": [{"file_path": "a/x.txt", "span": [0, 5], "answer": "hello"}]}, {"id": 7, "question": "who?", "snippets": [{"file_path": "Privacy_QA/p.txt", "span": [1]}]}, {"id": "z"}]


@pytest.mark.parametrize(("name", "value", "ids"), [("tests.json", {"tests": QUERIES}, ["q_0", "7", "z"]), ("queries.json", QUERIES, ["q_0", "7", "z"]), ("data/tests.json", QUERIES, ["q_0", "7", "z"]), ("data/benchmarks/Privacy_QA.json", {"tests": QUERIES}, ["privacyqa_0", "7", "z"]), ("deep/q.jsonl", "\n\n".join(json.dumps(q) for q in QUERIES), ["0", "7", "z"])])
def test_span_query_layouts(spark, tmp_path, name, value, ids):
    put(tmp_path, name, value)
    rows = files.span_queries(spark, str(tmp_path)).orderBy("query_id").collect()
    assert [r["id"] for r in rows] == ids and [r["query"] for r in rows] == ["about nda", "who?", ""]
    assert [r["subdataset"] for r in rows] == (["privacyqa"] * 3 if "benchmarks" in name else ["contractnli", "privacyqa", "cuad"])
    spans = files.spans(files.span_queries(spark, str(tmp_path))).collect()
    assert [(r["path"], r["g_start"], r["g_end"]) for r in spans] == [("a/x.txt", 0, 5)]


def test_layouts_by_precedence(spark, tmp_path):
    put(tmp_path, "data/benchmarks/cuad.json", [{"query": "second"}])
    put(tmp_path, "queries.json", [{"query": "first"}])
    assert files.span_queries(spark, str(tmp_path)).first()["query"] == "first"
    with pytest.raises(FileNotFoundError):
        files.span_queries(spark, str(tmp_path / "data" / "none"))


def test_text_corpus(spark, tmp_path):
    put(tmp_path, "data/corpus/a/x y+1%.txt", "one\ntwo")
    put(tmp_path, "data/corpus/b/MOËT.txt", "three")
    (tmp_path / "data/corpus/b/bad.txt").write_bytes(b"a\xffb")
    got = {r["path"]: (r["stem"], r["text"]) for r in files.text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a/x y+1%.txt": ("x y+1%", "one\ntwo"), "b/MOËT.txt": ("MOËT", "three"), "b/bad.txt": ("bad", "a�b")}
    names = spark.createDataFrame([("b/MOËT.txt",), ("bad",)], "name string")
    assert {r["path"] for r in files.text_corpus(spark, str(tmp_path), names).collect()} == {"b/MOËT.txt", "b/bad.txt"}


def test_section_queries(spark, tmp_path):
    path = put(tmp_path, "q.json", {"queries": [{"id": "a", "query": "x", "expected_sections": ["1", "12A"], "type": "factual"}, {"id": "b", "query": "y", "expected_sections": [], "type": "clause_analysis", "difficulty": "hard"}]})
    rows = files.section_queries(spark, path).orderBy("query_id").collect()
    assert [(r["query_id"], r["id"], r["expected_sections"], r["difficulty"]) for r in rows] == [(0, "a", ["1", "12A"], "medium"), (1, "b", [], "hard")]


@pytest.fixture
def statutes(tmp_path):
    laws = [{"law_name": "L", "section_num": str(k), "section_content": f"words of section {k} alpha{k} beta{k}", "reference": [{"law_name": "L", "section_num": "1"}] if k == 3 else None} for k in range(1, 9)]
    put(tmp_path, "laws/a.json", [*laws, {"law_name": "L", "section_num": "", "section_content": "x"}, {"law_name": "L", "section_num": "9", "section_content": "  "}])
    put(tmp_path, "laws/b.json", [{"law_name": "L", "section_num": "8", "section_content": "the later alpha8", "reference": [{"law_name": "L"}]}])
    rows = [("about alpha3 beta3", "[{'law': 'L', 'sections': '3'}]"), ('say "x" alpha1', "[{'law': 'L', 'sections': 1}]"), ("broken", "not a literal ["), ("none", "[{'law': 'L'}]"), ("alpha5 beta5", "[{'law': 'L', 'sections': '5'}]")]
    cell = lambda x: '"' + x.replace('"', '""') + '"'
    put(tmp_path, "q.csv", "question,relevant_laws\n" + "\n".join(f"{cell(a)},{cell(b)}" for a, b in rows))
    put(tmp_path, "naive.json", [{"id_": f"n{k}", "text": f"alpha{k} line"} for k in range(1, 5)])
    put(tmp_path, "map.json", {f"n{k}": [f"L-{k}"] for k in range(1, 5)})
    put(tmp_path, "golden.json", [{"id_": f"L-{k}", "text": f"words of section {k} alpha{k} beta{k}"} for k in range(1, 9)])
    return tmp_path


def test_law_files(spark, statutes):
    laws = files.law_sections(spark, str(statutes / "laws"))
    got = {r["section_id"]: r for r in laws.collect()}
    assert set(got) == {f"L-{k}" for k in range(1, 9)} and got["L-8"]["text"] == "the later alpha8" and got["L-8"]["cross_refs"] == []
    assert got["L-3"]["cross_refs"] == ["L-1"]
    rows = files.law_queries(spark, str(statutes / "q.csv"), laws).orderBy("query_id").collect()
    assert [(r["id"], r["query"], r["expected_ids"], r["has_xref"]) for r in rows] == [("ccl_0", "about alpha3 beta3", ["L-3"], True), ("ccl_1", 'say "x" alpha1', ["L-1"], False), ("ccl_4", "alpha5 beta5", ["L-5"], False)]
    assert [r["node_id"] for r in files.nodes(spark, str(statutes / "naive.json")).orderBy("chunk_id").collect()] == ["n1", "n2", "n3", "n4"]
    assert {(r["node_id"], r["gold_id"]) for r in files.gold_map(spark, str(statutes / "map.json")).collect()} == {(f"n{k}", f"L-{k}") for k in range(1, 5)}


def test_statute_experiment(spark, statutes, capsys):
    at = lambda n: str(statutes / n)
    out = pipelines.statute_experiment(spark, at("laws"), at("q.csv"), at("naive.json"), at("map.json"), at("golden.json"))
    hits = {(r["pool"], r["slice"], r["k"]): r for r in out["hits"].collect()}
    assert hits["sections", "all", 1]["hr"] == 1.0 and hits["sections", "all", 1]["n"] == 3
    assert hits["naive", "all", 5]["hr"] == pytest.approx(2 / 3, abs=1e-6) and hits["naive", "covered", 5]["hr"] == 1.0, "one section is in no line chunk"
    assert hits["augmented", "xref", 5]["n"] == 1 and hits["augmented", "plain", 20]["n"] == 2
    assert {r["slice"] for r in out["lift"].collect()} == {"xref", "plain"}
    assert cli.main(["statutes", "--laws", at("laws"), "--queries", at("q.csv"), "--naive_nodes", at("naive.json"), "--naive_mapping", at("map.json"), "--golden_nodes", at("golden.json"), "--output_dir", at("out")]) == 0
    (written,) = (statutes / "out").glob("statutes_*.json")
    assert json.loads(written.read_text())["counts"]["all"] == 3 and "Hits" in capsys.readouterr().out


def test_section_experiment(spark, tmp_path, capsys):
    doc = put(tmp_path, "act.txt", STATUTE)
    queries = put(tmp_path, "q.json", {"queries": [{"id": "a", "query": "short title called", "expected_sections": ["1"], "type": "factual"}, {"id": "b", "query": "late claims lapse", "expected_sections": ["12A"], "type": "cross_reference", "difficulty": "hard"}, {"id": "c", "query": "zebra", "expected_sections": ["77"], "type": "factual"}]})
    assert cli.main(["sections", "--document", doc, "--queries", queries, "--chunk_size", "30", "--ablation", "--chunk_quality", "--output_dir", str(tmp_path)]) == 0
    (written,) = tmp_path.glob("sections_*.json")
    out = json.loads(written.read_text())
    by = {r["method"]: r for r in out["metrics"]}
    assert set(by) == {"Recursive + Dense", "BM25 Only", "Naive Hybrid", "Structural + Hybrid", "Structural + Dense", "Structural + BM25"}
    assert by["Structural + BM25"]["r_at_1"] == pytest.approx(2 / 3, abs=1e-6) and all(r["n_queries"] == 3 for r in out["metrics"])
    assert {r["qtype"] for r in out["by_type"]} == {"factual", "cross_reference"} and {r["difficulty"] for r in out["by_difficulty"]} == {"medium", "hard"}
    assert {r["comparison"] for r in out["significance"]} == {f"vs {b}" for b in pipelines.BASELINES}
    assert out["quality"]["boundary_precision"]["structural"] == 100.0
    said = capsys.readouterr().out
    assert "r_at_5: chunking" in said and "\\\\" in said
    assert cli.main(["quality", "--document", str(tmp_path / "none.txt")]) == 1
    assert cli.main(["quality", "--document", doc, "--output_dir", str(tmp_path), "--use_encoder"]) == 0


def contract(rng, n):
    return "Opening words\n" + "\n".join(f"{k}. Heading number of it\n" + " ".join(f"w{rng.randrange(500)}" for _ in range(60)) for k in range(1, n))


def test_span_experiment(spark, tmp_path):
    rng = random.Random(1)
    texts = {f"{s}/{n}.txt": contract(rng, 12) for s in ("cuad", "maud") for n in "abc"}
    for path, text in texts.items():
        put(tmp_path, f"data/corpus/{path}", text)
    put(tmp_path, "data/corpus/cuad/unused.txt", contract(rng, 5))
    for s in ("cuad", "maud"):
        tests = []
        for n in "abc":
            at = texts[f"{s}/{n}.txt"].index("3. Heading") + 30
            tests.append({"query": texts[f"{s}/{n}.txt"][at : at + 120], "snippets": [{"file_path": f"{s}/{n}.txt", "span": [at, at + 120], "answer": texts[f"{s}/{n}.txt"][at : at + 120]}]})
        put(tmp_path, f"data/benchmarks/{s}.json", {"tests": tests})
    out = pipelines.span_experiment(spark, str(tmp_path), 4, depths=(1, 2, 8))
    by = {r["method"]: r for r in out["metrics"].collect()}
    assert set(by) == {*pipelines.BASELINES, pipelines.OURS} and all(r["n_queries"] == 4 for r in by.values()), "two queries of each dataset"
    chars = {(r["method"], r["k"]): r["char_recall"] for r in out["char_metrics"].collect()}
    assert chars["BM25 Only", 8] > 0.9 and all(chars[m, 1] <= chars[m, 2] <= chars[m, 8] for m in by)
    assert {r["subdataset"] for r in out["by_subdataset"].collect()} == {"cuad", "maud"}
    assert out["equal_weight"].count() == 12 and {r["pool"] for r in out["chunk_chars"].collect()} == {"fixed", "structural"}
    assert out["significance"].count() == 3
    old = pipelines.span_experiment(spark, str(tmp_path), 4, depths=(1, 8), compat=True)
    assert old["metrics"].count() == 4


def test_sample_by_seeded_generator(spark):
    rows = [(k, "ab"[k % 2], f"doc{k % 5}") for k in range(40)]
    got = sorted(r["k"] for r in sampling.stratified(spark.createDataFrame(rows, "k long, s string, path string"), "s", "path", "k", 10, seeded=True).collect())
    want = []
    for s in "ab":
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (random.Random(r[2]).random(), r[0]))
        want += [r[0] for r in own[:5]]
    assert got == sorted(want)


def test_pages_need_a_library(spark, tmp_path):
    put(tmp_path, "x.pdf", "%PDF-1.4")
    with pytest.raises(Exception, match="pdfplumber or PyMuPDF"):
        files.pages(spark, str(tmp_path / "x.pdf")).collect()


def test_sinks(spark, tmp_path):
    path = sinks.write_json(spark, {"a": float("inf"), "b": [1.5, float("nan")], "ü": "§"}, str(tmp_path), "x", "now")
    assert path.endswith("/x_now.json") and json.loads((tmp_path / "x_now.json").read_text()) == {"a": None, "b": [1.5, None], "ü": "§"}
    rows = [{"method": "Naive Hybrid", "r": 0.5}, {"method": "Structural + Hybrid", "r": 0.75}]
    assert sinks.table(rows, ["method", "r"]).splitlines()[-1].split() == ["Structural", "+", "Hybrid", "0.750"]
    assert sinks.latex(rows, "method", ["r"]) == "Naive Hybrid & 0.500 \\\\\nStructural + Hybrid & \\textbf{0.750} \\\\"
    assert sinks.improvements(rows, "Structural + Hybrid", "r") == "r: 0.750 against 0.500 of Naive Hybrid (+0.250, +50.0%)"


def test_objects(spark):
    docs = spark.createDataFrame([(0, STATUTE)], "doc_id long, text string")
    parsed = api.DocumentParser().parse(docs)
    chunks = api.StructureChunker(max_cross_refs=1).chunk(parsed)
    one = chunks.where("section_no = '3'").first()
    assert one["cross_references"] == ["2"] and one["breadcrumb"] == "SMALL CLAIMS ACT > Chapter II: Of Later Claims > Section 3"
    assert not api.StructureChunker(resolve_cross_refs=False, add_breadcrumbs=False).chunk(parsed).where("has_cross_refs or text like '[%'").count()
    numbered = pipelines.numbered(chunks, "test")
    for kind in (api.DenseRetriever, api.SparseRetriever, api.HybridRetriever):
        hit = kind(numbered).retrieve("late claims lapse", 2).orderBy("rank").first()
        assert "12A" in hit["text"] and hit["rank"] == 1
    assert api.HybridRetriever(numbered, encoder=None).retrieve("claims").count() > 0
    rel = spark.createDataFrame([(1, k, int(k in (1, 8))) for k in range(1, 11)], "query_id long, rank int, rel int")
    m = api.RetrievalMetrics()
    assert (m.recall_at_k(rel, 1), m.precision_at_k(rel, 5), m.mrr(rel), m.map_at_k(rel)) == (1.0, 0.2, 1.0, 0.625)
    assert m.compute_all(rel)["map_10"] == 0.625 and m.per_query_scores(rel).first()["ap"] == 1.0
    assert m.format_table_row("x", {"r": 0.5}, {"r": 0.4}) == "x & \\textbf{0.500} \\\\"
    assert api.StructureChunker.breadcrumb_stats(chunks).first()["n"] == 4
