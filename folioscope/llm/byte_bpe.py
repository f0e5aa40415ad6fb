"""Byte-level BPE encoding and decoding by a rank table (operator 6).

The ranks become a tokenizers model: bytes are mapped to printable characters,
and each token's merge is the last step of merging its own bytes by lower
ranks.  Each match of the pattern is encoded by itself, and a match that is a
token is that token.  Decoding gathers the tokens' bytes from a table, so
characters that a text's ids split between them come whole again.

Plan: a map without shuffle over Arrow batches.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import BYTE_CHARS, CHAR_BYTES, PieceEncoder

VOCABULARY = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of several bytes, by ascending rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1)))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) == 2:  # else only a match that is the whole token gives it
            out.append((parts[0], parts[1]))
    return out


def build(path: str, pattern: str):
    """A tokenizers.Tokenizer of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = lambda token: "".join(BYTE_CHARS[x] for x in token)
    ranks = load_ranks(path)
    model = models.BPE({chars(t): r for t, r in ranks.items()}, [(chars(a), chars(b)) for a, b in merges(ranks)], ignore_merges=True)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@functools.cache
def codec(name: str = VOCABULARY) -> tuple[PieceEncoder, Decoder]:
    t = build(public_tokenizers.path(name), public_tokenizers.PATTERN)
    return PieceEncoder(t), Decoder({i: c for c, i in t.get_vocab().items()})


class Decoder:
    """Bytes of ids, by one gather from the tokens' bytes."""

    def __init__(self, tokens: dict[int, str]):
        raw = [bytes(CHAR_BYTES[c] for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        self.lengths = np.array([len(x) for x in raw])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.table = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.table[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def spans(self, ids: np.ndarray) -> np.ndarray:
        """(first character, end) of each id in the decoded text; a character that ids split counts for each of them."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        starts_char = (np.frombuffer(self(ids), np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(starts_char)])
        first = upto[np.minimum(ends - n + 1, len(starts_char))] - 1
        return np.stack([np.maximum(first, 0), upto[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)


def _digests(name: str):
    def run(batches):
        encode, decode = codec(name)
        for b in batches:
            rows = [(len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids)).hexdigest()) for ids in encode.each(b.column("text"))]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.record_batch([b.column("key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(name: str):
    def run(batches):
        encode, decode = codec(name)
        for b in batches:
            ids = [x for x in encode.each(b.column("text"))]
            spans = [decode.spans(x) for x in ids]
            yield pa.record_batch([b.column("key"), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([x[:, 0].tolist() for x in spans], pa.list_(pa.int32())), pa.array([x[:, 1].tolist() for x in spans], pa.list_(pa.int32()))], names=["key", "ids", "starts", "ends"])

    return run


def _decode(name: str):
    def run(batches):
        _, decode = codec(name)
        for b in batches:
            raw = [decode(np.asarray(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("key"), pa.array(raw, pa.binary()), pa.array([x.decode(errors="replace") for x in raw], pa.string())], names=["key", "raw", "text"])

    return run


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, and the half-open span of characters of each id (starts, ends); a null text is the empty one."""
    rows = _rows(docs, key, text)
    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(_encode(vocabulary), f"key {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("key", key)


def decode(ids: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key, raw (the bytes of the ids), text (bytes that are no whole character become U+FFFD); null ids count as none."""
    rows = ids.select(F.col(key).alias("key"), F.col(column).alias("ids"))
    return rows.mapInArrow(_decode(vocabulary), f"key {dict(rows.dtypes)['key']}, raw binary, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each row's text.

    Special strings are ordinary text.  A null text is the empty one; null or
    repeated keys give their rows; an empty table gives none; other columns are
    not looked at.
    """
    rows = _rows(docs, key, text)
    return rows.mapInArrow(_digests(vocabulary), f"key {dict(rows.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded by the 50k rank table and decoded again."""
    return round_trip(common.table(spark, sf_dir, "documents"))
