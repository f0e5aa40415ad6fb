"""Nearest neighbours, near duplicates, the classifier and the pipeline, against brute force."""

from __future__ import annotations

import contextlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import common, near_dedup, nn_descent, pii, quality_classifier, quality_rules

V = "vec_id long, embedding array<float>, id int"


def exact(ids, x, k=20, every=20):
    out, ids = {}, np.asarray(ids)
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        s[i] = -np.inf
        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.delete(np.arange(len(s)), i)
        out[int(ids[i])] = ids[near[np.lexsort((ids[near], -s[near]))][:k]].tolist()
    return out


def test_recall(spark, sf_dir):
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()
    want = exact([r[0] for r in rows], np.array([r[1] for r in rows], np.float64))
    got = {}
    for r in nn_descent.nearest(common.table(spark, sf_dir, "embeddings")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(got[q]) == len(w) for q, w in want.items())
    assert np.mean([len({*got[q]} & {*w}) / len(w) for q, w in want.items()]) >= 0.9


def recall(spark, ids, x):
    x = np.array(x, np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "id": pa.array([1] * len(ids), pa.int32())}))
    want, got = exact(ids, x.astype(np.float64)), {}
    for r in nn_descent.nearest(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return np.mean([len({*got[q]} & {*w}) / len(w) for q, w in want.items()])


def test_recall_beside_a_large_vector(spark):
    x = np.random.default_rng(3).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1000
    assert recall(spark, list(range(600)), x) >= 0.9


def test_recall_in_tight_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(6, 16)), 100, axis=0) + rng.normal(size=(600, 16)) * 0.0005
    assert recall(spark, list(range(600)), x) >= 0.9


def test_recall_with_unequal_lengths(spark):
    """The longest vectors are everyone's neighbours."""
    rng = np.random.default_rng(6)
    assert recall(spark, list(range(3000)), rng.normal(size=(3000, 16)) * rng.lognormal(0, 1, (3000, 1))) >= 0.9


def test_recall_over_many_leaves(spark):
    """50,000 vectors in 40 clusters: the tree's leaves, the graph and the search all matter."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 50_000)] + rng.normal(size=(50_000, 24)) * 0.6
    assert recall(spark, list(range(50_000)), x / np.linalg.norm(x, axis=1)[:, None]) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], 1), (8, [], 1), (9, [1.0], 1), (20, [0.0, 1.0], 1), (20, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (40, [0.0, 0.0], 1)]
    got = [tuple(r) for r in nn_descent.nearest(spark.createDataFrame(rows, V)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0), (20, 3, 7, 0.0)]


def test_no_vectors(spark):
    assert not nn_descent.nearest(spark.createDataFrame([], V)).collect()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    sets = {k: shingles(t) for k, t in docs}
    top = {k: k for k in sets}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and 100 * min(n, m) >= 85 * max(n, m):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (n + m - both):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in keys)


def noisy(rng, words, share):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def test_near_duplicates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [None, "", "  ", "One two", "one TWO", "one\ttwo\n", "a b c d e", "A B C D E", "É b c d e", "é b c d e"]
    for copies in (1, 2, 5, 40, 150):
        base = [word() for _ in range(rng.choice((30, 200, 600)))]
        for _ in range(copies):
            texts.append(noisy(rng, base, rng.choice((0.0, 0.004, 0.012, 0.03))))
    texts += [" ".join(word() for _ in range(60)) for _ in range(60)] + ["w " * 30_000, "w " * 30_001]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = list(zip(order, texts, strict=True))
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n int, digest string").repartition(5)
    got = sorted(map(tuple, near_dedup.near_duplicates(rows).collect()))
    assert got == brute(docs)
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(rows).collect()) == [k for k, _, _, kept in got if kept]


def edited(rng, base, edits):
    words = list(base)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def labels_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows).collect()}


def test_copies_with_equal_sketches(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    texts = [edited(rng, base, 1) for _ in range(60)]
    got = labels_of(spark, texts)
    assert got == {k: first for k, _, first, _ in brute(enumerate(texts))}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("edits", [1, 10])
def test_crowd_of_copies(spark, edits):
    """Each text is linked with the first; with 10 edits, with few others."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    texts = [" ".join(base)] + [edited(rng, base, edits) for _ in range(3000)]
    first = shingles(texts[0])
    assert all(100 * len(first & x) >= 85 * len(first | x) for x in map(shingles, texts[1:]))
    assert set(labels_of(spark, texts).values()) == {0}


def test_long_run_of_equal_sketches_is_a_chain():
    same = np.zeros((100, near_dedup.ROW), np.uint8)
    same[:, near_dedup.SKETCH :] = 17
    pairs = {tuple(sorted(map(int, p))) for p in near_dedup._region_pairs(same, np.full(100, 50), 85)}
    assert {(k, k + 1) for k in range(99)} <= pairs


def test_a_rejected_pair_hides_no_other():
    """Three alike sketches: the first pass gives a forest; while none is linked, the second gives all pairs."""
    sketch = np.zeros((3, near_dedup.ROW), np.uint8)
    sketch[:, near_dedup.SKETCH :] = 17
    sketch[1, 100:104] = sketch[2, 110:114] = 1
    for forest, n in ((True, 2), (False, 3)):
        assert len(near_dedup.leaf_pairs(sketch, np.array([50, 50, 50]), forest=forest)) == n
    keys = pa.array([1, 2, 3], pa.int64())
    batch = pa.record_batch([pa.array([0] * 3, pa.int32()), pa.array([r.tobytes() for r in sketch]), keys, pa.array([50] * 3, pa.int32()), pa.array([1, 1, 3], pa.int64())], names=["tree", "permuted", "key", "n", "component"])
    found = sorted((r["a"], r["b"]) for out in near_dedup._candidates(85, False)([batch]) for r in out.to_pylist())
    assert found == [(1, 3), (2, 3)]


@pytest.mark.parametrize("n", [3, 40, 146, 1000, 20_000])
def test_bins_leave_out_no_pair_at_the_threshold(n):
    """Of 2,000 pairs at the threshold, in unions of n, none is left out; of those well under it, most are."""
    rng = np.random.default_rng(n)
    pairs = 2000 if n < 2000 else 200
    for share, least, most in ((0.85, 0.998, 1), (0.70, 0, 0.2 if n > 100 else 1)):
        sets = []
        for _ in range(pairs):
            union = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            both = int(np.ceil(share * n))
            half = both + (n - both) // 2
            sets += [np.sort(union[:half]), np.sort(np.concatenate([union[:both], union[half:]]))]
        sizes, rows = np.array([len(x) for x in sets]), near_dedup.bin_sketches(sets)
        sketch = np.concatenate([np.zeros((len(rows), near_dedup.SKETCH), np.uint8), rows], axis=1)
        likely = near_dedup.likely_by_bins(sketch, sizes, np.arange(0, len(sets), 2), np.arange(1, len(sets), 2), 85).mean()
        assert least <= likely <= most


def test_parts_of_a_crowded_region_overlap():
    """200 rows of one region, in parts of 50: each row is linked with its neighbour, over the borders as well."""
    sketch = np.full((200, near_dedup.ROW), 17, np.uint8)
    keys, sizes = pa.array(range(200), pa.int64()), pa.array([50] * 200, pa.int32())
    batch = pa.record_batch([pa.array([0] * 200, pa.int32()), pa.array([r.tobytes() for r in sketch]), keys, sizes, keys], names=["tree", "permuted", "key", "n", "component"])
    batches = [batch.slice(k, 25) for k in range(0, 200, 25)]
    found = {(r["a"], r["b"]) for out in near_dedup._candidates(85, True, 50)(batches) for r in out.to_pylist()}
    assert {(k, k + 1) for k in range(199)} <= found


def test_each_order_reports_its_pairs():
    """A boundary can part a pair in the orders where its common prefix is longest."""
    sketch = np.zeros((2, near_dedup.ROW), np.uint8)
    sketch[:, near_dedup.SKETCH :] = 17
    sketch[1, : near_dedup.SKETCH : 16] = 1
    keys, sizes = pa.array([3, 4], pa.int64()), pa.array([50, 50], pa.int32())
    for k, p in enumerate(near_dedup.PERMUTATIONS):
        rows = np.concatenate([sketch[:, p], sketch[:, near_dedup.SKETCH :]], axis=1)
        batch = pa.record_batch([pa.array([k, k], pa.int32()), pa.array([r.tobytes() for r in rows]), keys, sizes, keys], names=["tree", "permuted", "key", "n", "component"])
        found = [(r["a"], r["b"]) for out in near_dedup._candidates(85)([batch]) for r in out.to_pylist()]
        assert found == ([(3, 4)] if (rows[0] == rows[1])[: near_dedup.MIN_DEPTH].all() else [])


def test_repeated_rows_and_null_keys(spark):
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (5, "A b c d e f")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (None, 2, None, True)], key=str)
    assert not near_dedup.near_duplicates(rows.where("false")).collect()


def test_no_step_keeps_the_shuffle_files_of_another(spark, sf_dir, monkeypatch):
    """Shuffle files go when a step has been written, without waiting for the driver's garbage; so do large tables that no later step reads."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f}

    def size():
        total = 0
        for f in files() - before:
            with contextlib.suppress(OSError):  # it may go meanwhile
                total += os.path.getsize(f)
        return total

    def written(df, name, *rest, **named):
        out = write(df, name, *rest, **named)
        end = time.time() + 3
        while size() > 50_000 and time.time() < end:
            time.sleep(0.05)
        steps.append((name, size(), out._scratch))
        return out

    before, steps, write = files(), [], common.written
    monkeypatch.setattr(common, "written", written)
    near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))
    assert {"classes", "candidates", "sets", "links", "components"} <= {name for name, _, _ in steps}
    assert [(name, n) for name, n, _ in steps if n > 50_000] == []
    assert not any(os.path.exists(path) for name, _, path in steps if name in ("classes", "sets"))
    assert spark.conf.get(common.CLEANUP, None) is None, "the session's setting is as it was"


@pytest.mark.parametrize("hub", [10_000, 50])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(near_dedup, "HUB", hub)
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    top = {}

    def find(k):
        while top.setdefault(k, k) != k:
            k = top[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r[0]: r[1] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in list(top)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    rows = scored.where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == quality_classifier.is_held_out(r["doc_id"]) for r in scored.collect())


def test_classifier_cases(spark):
    texts = [("fine plain words here and there " * 5, 1), ("## $$ %% spam ## click " * 5, 0)] * 30
    m = quality_classifier.fit([t for t, _ in texts], [y for _, y in texts])
    rows = spark.createDataFrame([(1, texts[0][0], 7), (2, texts[1][0], 7), (3, None, 7), (4, "", 7), (5, "x " * 200_000, 7), (1, texts[0][0], 7), (None, " ", 7)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(rows, m).collect()}
    assert got[1] > 0.8 and got[2] < 0.2 and got[3] == got[4] and 0 <= got[None] <= 1 and 0 <= got[5] <= 1
    assert {1} <= {r["doc_id"] for r in quality_classifier.keep_accepted(rows, m).collect()} and quality_classifier.keep_accepted(rows, m).columns == rows.columns
    assert not quality_classifier.score(rows.where("false"), m).collect()
    assert quality_classifier.fit([], []).offset == 0.0


def plain_score(model, text):
    """The score worked out n-gram by n-gram."""
    mask = (1 << 64) - 1
    mix, p = int(quality_classifier._MIX), int(quality_classifier._P)

    def bucket(h, salt):
        h = (h + salt) * mix & mask
        h ^= h >> 29
        return (h * mix & mask) >> (64 - quality_classifier.BITS)

    words = [b"<" + w.encode() + b">" for w in re.split("[\\x20\\x09-\\x0D]+", text or "")]  # white space at an end gives an empty word, and so does no text
    hashes = [sum((c + 1) * pow(p, k, 1 << 64) for k, c in enumerate(w)) & mask for w in words]
    found = [bucket(h, 1) for h in hashes]
    for w in words:
        for n in quality_classifier.GRAMS:
            for k in range(len(w) - n + 1):
                h = 0
                for c in w[k : k + n]:
                    h = (h * p + c + 1) & mask
                found.append(bucket(h, n))
    for a, b in itertools.pairwise(hashes):
        found += [bucket((a * p + b) & mask, 2), bucket(int(a == b), 9)]
    total = sum(float(model.weights[k]) for k in found) / max(len(found), 1) + model.offset
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def test_scores_are_those_of_a_plain_version(spark):
    rng = random.Random(3)
    texts = [("fine plain words here and there " * 5, 1), ("## $$ %% spam ## click " * 5, 0)] * 20
    m = quality_classifier.fit([t for t, _ in texts], [y for _, y in texts])
    m.weights = np.random.default_rng(0).normal(size=1 << quality_classifier.BITS).astype(np.float32)
    mixed = ["", "a", "a a", "naïve café 漢字", "x " * 500, "two\nlines\tand more", " edge ", "word" * 3000, None] + [" ".join(rng.choice(["ab", "cde", "fghij", "é", "1"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    want = [plain_score(m, t) for t in mixed]
    assert m.scores(pa.array(mixed)).tolist() == pytest.approx(want, abs=1e-6)
    order = list(range(len(mixed)))
    rng.shuffle(order)
    assert m.scores(pa.array([mixed[k] for k in order])).tolist() == pytest.approx([want[k] for k in order], abs=1e-6), "neither order nor company matters"
    assert [float(m.scores(pa.array([t], pa.string()))[0]) for t in mixed] == pytest.approx(want, abs=1e-6)
    rows = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["score"] for r in quality_classifier.score(rows, m).collect()} == pytest.approx(dict(enumerate(want)), abs=1e-6)


def test_training_sample(spark):
    ids = [k for k in range(200) if not quality_classifier.is_held_out(k)][:12]
    docs = spark.createDataFrame([(k, ("fine words " if k % 2 else "## spam ") * 100, "x") for k in ids], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids] + [(ids[0], 1 - ids[0] % 2), (None, 1), (ids[1], None), (ids[2], 5)], "doc_id long, quality int")
    whole = quality_classifier.train(docs, labels)
    same = quality_classifier.train(docs.where(F.col("doc_id") != ids[0]), labels.where(F.col("doc_id") != ids[0]))
    assert (whole.weights == same.weights).all(), "an id with both labels is left out"
    assert not quality_classifier.train(docs, labels, size=1000).weights.any(), "no text fits"
    small = quality_classifier.train(docs, labels, size=5000)
    assert small.weights.any() and (small.weights != whole.weights).any()


def test_repeated_ids_crowd_out_no_class(spark):
    ids = [k for k in range(100) if not quality_classifier.is_held_out(k)][:4]
    docs = spark.createDataFrame([(ids[0], "fine plain words")] * 50 + [(k, "## spam ##" if k > ids[1] else "fine plain words") for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k <= ids[1])) for k in ids], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels, rows=2)
    assert model.weights.any()
    once = quality_classifier.train(docs.distinct(), labels, rows=2)
    assert (model.weights == once.weights).all() and model.offset == once.offset


def test_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_classifier.train(docs, common.table(spark, sf_dir, "labels"))
    kept = [r["doc_id"] for r in quality_classifier.score(docs, model).where("predicted = 1").collect()]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = common.written(stage(spark, now, sf_dir), "test-stage")
        assert now.columns == docs.columns
        ids = sorted(r["doc_id"] for r in now.select("doc_id").collect())
        if k == 1:
            good = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
            kept = [i for i in kept if i in good]
        if k == 2:
            kept = [i for i, _, _, first in brute([(i, texts[i]) for i in kept]) if first]
        assert ids == sorted(kept)
    last = corpus_pipeline.STAGES[4][1](spark, now, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == set(kept)
    assert corpus_pipeline.run(spark, sf_dir).count() == last.count()


def test_stages_take_odd_rows(spark, sf_dir):
    """Nulls in every column, repeated rows, empty and very long texts, and columns with the operators' own names."""
    good = "the people of the town and the river had a long day in the sun and it was good for all of them to be there with us " * 4
    rows = [(1, good, "en", "s", 5, 1), (1, good, "en", "s", 5, 1), (2, None, None, None, None, None), (None, good + " more words", None, "s", 1, 2), (3, "", "en", "s", 0, 3), (4, "word " * 100_000, "en", "s", 0, 4), (5, good.upper() + " x@y.org", "en", "s", 0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = common.written(stage(spark, now, sf_dir), "test-stage")
        assert now.columns == docs.columns, k
    kept = [r["doc_id"] for r in now.collect()]
    packed = corpus_pipeline.STAGES[4][1](spark, now, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    assert now.where("text like '%x@y.org%'").isEmpty()


def test_last_stages(spark, sf_dir):
    """Pseudonyms and packing of whole texts, against plain versions."""
    from test_pii import plain

    docs = common.table(spark, sf_dir, "documents")
    hidden = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.hide_persons(spark, docs, sf_dir).collect()}
    texts = {r["doc_id"]: plain(r["text"], pii.TEST_KEY)[0] for r in docs.collect()}
    assert hidden == {k: (t, None if t is None else len(t)) for k, t in texts.items()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.pack(spark, docs, sf_dir).collect())
    want = []
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes())) for at in range(0, len(ids), 1024)]
    assert pieces == sorted(want)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, sf_dir, k):
    none = common.table(spark, sf_dir, "documents").where("false")
    assert not corpus_pipeline.STAGES[k][1](spark, none, sf_dir).collect()
