"""WARC records, quality rules."""

from __future__ import annotations

import gzip
import hashlib
import re

import oracle
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, quality_rules, queries, warc


def no_python(df) -> bool:
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.differences(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name]) == []


PAGES = [(1, "u1", "abc"), (2, "u 2\n", "abc"), (3, "u3", None), (4, None, ""), (5, "u5", "é" * 5000), (6, "u6", "é" * 5000), (7, "u7", "x" * 999), (None, "u8", "abc"), (2, "u 2\n", "abc")]


@pytest.mark.parametrize(("chunk", "least"), [(100, 0), (1 << 20, 4)])
def test_records(spark, chunk, least):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    path = common.scratch(spark, "test-warc")
    warc.write_archives(pages, path, chunk_bytes=chunk, min_revisit=least)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect()]
    first, want = {}, []
    for k, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", k)
    for k, _, h in PAGES:
        raw = (h or "").encode()
        again = k is not None and len(raw) >= least and first[h or ""] != k
        want.append((k, len(raw), warc.base32(hashlib.sha1(raw).digest()), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    chunks = warc.archive_chunks(spark, path)
    assert chunks.where("chunk > 0").count() == (0 if chunk > 10_000 else 99 + 9)
    assert chunks.groupBy("archive", "record").agg(F.max("payload_upto").alias("n")).agg(F.sum("n")).first()[0] == sum(w[1] for w in want if w[3] == "response")


def warc_records(data):
    """Records of a WARC file's plain bytes: header fields and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        assert version == "WARC/1.1" and len(block) == n and data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        yield fields, block
        at = end + 8 + n


def test_archives_are_warc_files(spark, tmp_path):
    """Each archive's rows in order are a .warc.gz file, a member for each record, long payloads of many chunks included."""
    pages = spark.createDataFrame([*PAGES, (8, "u9", "line of text\n" * 300_000), (9, "u10", "line of text\n" * 300_000)], "page_id long, url string, html string").repartition(3)
    path = common.scratch(spark, "test-warc")
    warc.write_archives(pages, path, chunk_bytes=10_000)
    seen = []
    for r in warc.archive_chunks(spark, path).select("archive").distinct().collect():
        file = tmp_path / f"{r['archive']}.warc.gz"
        with file.open("wb") as f:
            f.writelines(warc.archive_bytes(spark, path, r["archive"]))
        with gzip.open(file) as f:
            seen += list(warc_records(f.read()))
    assert len(seen) == len(PAGES) + 2 and len({f["WARC-Record-ID"] for f, _ in seen}) >= 9
    for fields, block in seen:
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + warc.base32(hashlib.sha1(block).digest())
        else:
            assert not block and fields["WARC-Refers-To"] in {f["WARC-Record-ID"] for f, _ in seen}
    assert sum(len(b) == 3_900_000 for _, b in seen) == 1
    assert {r["record_type"] for r in warc.read_archives(spark, path).where("page_id >= 8").collect()} == {"response", "revisit"}


def test_a_damaged_payload_is_found(spark):
    path, bad = common.scratch(spark, "test-warc"), common.scratch(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    row = warc.archive_chunks(spark, path).first().asDict()
    row["data"] = gzip.compress(gzip.decompress(bytes(row["data"])).replace(b"abc", b"abd"))
    spark.createDataFrame([tuple(row.values())], warc.ROWS).write.parquet(bad)
    with pytest.raises(Exception, match="digest in its header"):
        warc.read_archives(spark, bad).collect()


def test_no_pages(spark):
    path = common.scratch(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert not warc.read_archives(spark, path).collect()


TEXTS = [None, "", " \t\n", "a b c a b c", "the cat sat on the mat and it was a fine day for all of us " * 6, "# " * 80, "one\none\none\n" * 30, "y z " * 2000]


def test_rules(spark):
    rows = spark.createDataFrame([(k, t, 3, "q") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], 3, "q")], "doc_id long, text string, n_words int, _q string")
    judged = quality_rules.judge(rows)
    assert no_python(judged)
    got = {r["doc_id"]: r for r in judged.collect()}
    for k, t in enumerate(TEXTS):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {p for i, x in enumerate(three) if three.count(x) > 1 for p in (i, i + 1, i + 2)} if len(words) < 1000 else set(range(len(words)))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep_good(rows)
    assert kept.columns == rows.columns and no_python(kept)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged.where("kept").collect())
    assert not quality_rules.keep_good(rows.where("false")).collect()


def test_kept_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    a = {r[0] for r in quality_rules.judge(docs).where("kept").select("doc_id").collect()}
    assert a == {r[0] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
