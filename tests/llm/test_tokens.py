"""Token counts, token files, packing and rank tables, against the libraries themselves."""

from __future__ import annotations

import base64
import hashlib
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscope.llm import byte_bpe, common, packing, token_counts, token_files
from folioscope.llm.pieces import PieceEncoder, settings

ODD = [None, "", " ", "  a  b ", "<|endoftext|>", "a <|endoftext|> b", "don't  stop\n\n now ", "naïve café — 漢字 かな\u3000x", "👩‍👩‍👧 é e\u0301 \u200b \x00\x01", "x" * 5000, "ab " * 4000, "\n", "\t\tif x:\r\n  y", "I'LL we'Ll 12345 6,7", "<|startoftext|>Hi</w>", "İstanbul ẞ ß ǅ \xa0 a\x85b", "12 % ( a ) - b ... ?!", "repeated", "repeated"]
SCHEMA = "doc_id long, text string, n_tokens string, digest string, key int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "x", "y", 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


def library(name):
    return Tokenizer.from_file(P.path(name))


HARD = ["a  b", " a", "a ", "  ", "a   b  c ", "a \n b", "a\n b  c", "x  <|endoftext|>  y", " " * 5000, "a " * 300 + " ", "\u3000 a \u3000", "a\t \tb", "don't  'll  we", "1  2 ,  , .", "\x85 a \xa0 b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_runs_of_white_space(name):
    t, e = library(name), common.encoder(name)
    rng = np.random.default_rng(0)
    texts = HARD + ODD + ["".join(rng.choice([" ", "  ", "a", "Bc", "\n", "'s", ",", "é"], 30)) for _ in range(500)]
    assert [x.tolist() for x in e.each(pa.array(texts, pa.string()))] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_white_space_costs_little():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    plain = [" ".join(rng.choice(words, 100)) for _ in range(4000)]
    times = {}
    for kind, texts in (("plain", plain), ("double", [x.replace(" ", "  ", 1) for x in plain]), ("all double", [x.replace(" ", "  ") for x in plain])):
        e = PieceEncoder(library("byte_bpe_50k.json"))
        began = time.perf_counter()
        list(e.encode(pa.array(texts)))
        times[kind] = time.perf_counter() - began
    assert times["double"] < 3 * times["plain"] + 0.2 and times["all double"] < 6 * times["plain"] + 0.5, times


def test_settings_come_from_the_tokenizer():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    assert settings(library("byte_bpe_50k.json")) == (True, False) and settings(library("word_bpe_49k.json")) == (False, True)
    t = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "ab": 3}, [("a", "b")]))
    t.pre_tokenizer, t.normalizer = pre_tokenizers.Whitespace(), normalizers.Lowercase()
    texts = ["AB  ab", "a b", "", None, " a"]
    assert settings(t) is None
    assert [x.tolist() for x in PieceEncoder(t).each(pa.array(texts, pa.string()))] == [t.encode(x or "").ids for x in texts]


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "corpus"])
def docs(request, odd, spark, sf_dir):
    return odd if request.param == "odd" else common.table(spark, sf_dir, "documents")


def test_counts(docs, spark):
    cache = common.scratch(spark, "test-cache")
    t = library("byte_bpe_50k.json")
    want = sorted((k, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for k, x in rows_of(docs))
    assert sorted(map(tuple, token_counts.count_tokens(docs, cache).collect())) == want
    rows = spark.read.parquet(cache).count()
    assert sorted(map(tuple, token_counts.count_tokens(docs, cache).collect())) == want, "from the cache"
    assert spark.read.parquet(cache).count() == rows, "nothing is encoded twice"
    token_counts.count_tokens(docs, cache, tokenizer="word_bpe_49k.json").collect()
    assert spark.read.parquet(cache).count() == 2 * rows, "another version has its own counts"


def test_files(docs, spark):
    path = common.scratch(spark, "test-ids")
    t = library("word_bpe_49k.json")
    token_files.write_ids(docs, path, chunk_ids=1000)
    start, want = 0, []
    for k, x in sorted(rows_of(docs)):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.documents_of(spark, path).select("key", "start", "n_tokens", "ids_crc32").collect()) == want
    back = {r["key"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.token_ids(spark, path).collect()}
    assert all(back[k] == [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in rows_of(docs))


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes(n, bits):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (token_files.unpack(n, *token_files.pack(ids, bits), bits) == ids).all()


def test_crc_join():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_files.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_packing(docs):
    t = library("byte_bpe_50k.json")
    rows = packing.pack_documents(docs).collect()
    want = []
    for k, x in rows_of(docs):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        want += [(k, at, len(p := ids[at : at + 1024]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), 1024)]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 500).tolist()
    rooms, plain = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in rooms if r >= lengths[k]]
        room = min(fits) if fits else 100
        if fits:
            rooms.remove(room)
        plain[k] = 100 - room
        rooms.append(room - lengths[k])
    found = packing.best_fit(lengths, 100)
    assert sorted(at for _, at in found) == sorted(plain.values())
    assert len({s for s, _ in found}) == len(rooms)


def test_rank_table(docs):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for k, x in rows_of(docs):
        ids = t.encode_ordinary(x)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.round_trip(docs).collect())) == sorted(want)


def test_ids_and_spans(odd):
    rows = {r["key"]: r for r in byte_bpe.encode(odd.withColumnRenamed("key", "other").withColumnRenamed("doc_id", "key"), key="key").collect()}
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode(byte_bpe.encode(odd)).collect()}
    for k, text in enumerate(ODD):
        assert back[k] == (text or "")
        assert not rows[k]["ends"] or max(rows[k]["ends"]) == len(text)
        assert all(a < b for a, b in zip(rows[k]["starts"], rows[k]["ends"], strict=True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert not token_counts.count_tokens(none, common.scratch(spark, "none")).collect()
    assert not packing.pack_documents(none).collect() and not byte_bpe.round_trip(none).collect()
    path = common.scratch(spark, "none")
    token_files.write_ids(none, path)
    assert not token_files.documents_of(spark, path).collect()


def test_null_and_repeated_keys(spark, odd):
    rows = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, None, 3), (3, None, 4), (4, "c", 5)], "doc_id long, text string, n_tokens int")
    counts = token_counts.count_tokens(rows, common.scratch(spark, "test-cache")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in counts) == [("3", 0), ("3", 0), ("4", 1), ("None", 2), ("None", 2)]
    path = common.scratch(spark, "test-ids")
    token_files.write_ids(rows, path)
    got = token_files.documents_of(spark, path).orderBy("start").collect()
    assert [(r["key"], r["n_tokens"]) for r in got] == [(None, 3), (None, 3), (3, 1), (3, 1), (4, 2)] and [r["start"] for r in got] == [0, 3, 6, 7, 8]
    packed = packing.pack_documents(rows).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in packed) == [("3", 1), ("3", 1), ("4", 2), ("None", 3), ("None", 3)]


def test_padding(spark):
    docs = spark.createDataFrame([(k, "a few words " * (1 + k % 200)) for k in range(2000)], "doc_id long, text string")
    rows = packing.stored(packing.pack_documents(docs)).collect()
    assert all(r["stored"] in (r["filled"], 1024) and (r["stored"] == 1024 or r["stored"] & (r["stored"] - 1) == 0) for r in rows)
    assert sum(r["stored"] for r in rows) <= 1.02 * sum(r["filled"] for r in rows)
    few = spark.createDataFrame([(1, "sid", 100), (2, "x", 64)], "sequence_id long, o string, length long")
    assert {(r["sequence_id"], r["filled"], r["stored"]) for r in packing.stored(few).collect()} == {(1, 100, 1024), (2, 64, 64)}


def test_packing_does_not_depend_on_splits(spark):
    docs = spark.createDataFrame([(k, "a few words " * (1 + k % 40)) for k in range(400)], "doc_id long, text string")
    n = [packing.pack_documents(docs.repartition(parts)).select("sequence_id").distinct().count() for parts in (1, 50)]
    rows = packing.pack_documents(docs.repartition(50)).collect()
    assert n[0] == n[1]
    assert len({r["doc_id"] for r in rows}) == 400
