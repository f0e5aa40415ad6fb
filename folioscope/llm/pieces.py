"""Exact tokenisation of whole texts through a cache of space-separated pieces.

A byte-pair tokenizer treats what lies between two safe cuts on its own, so a
text is cut there, each distinct piece is encoded once by the tokenizers
library and its ids are kept in a bounded cache of the Python worker.

Safe cuts
    A cut lies before a single space that has a non-space character on either
    side.  The pre-tokenizer's matches never run over such a place and don't
    look past it, normalisation doesn't either, and no added token holds a
    space.  Everything else (runs of spaces, line ends, odd separators) stays
    inside one piece, so it is the library that decides about it.  Texts are split
    at every space first; pieces that are empty or end in white space are put
    together with those that follow, up to one that doesn't.

Plain pieces
    A piece of Latin letters with closing punctuation is two matches of either
    pre-tokenizer; these go straight to the library's merge model, without the
    library's normaliser and pre-tokenizer.  All other pieces take the full way.

That holds for the two pre-tokenizers that settings() knows, by what a tokenizer's
own file says of it.  With any other, whole texts go to the library.

Id arrays are little-endian unsigned 32-bit bytes, which join by concatenation.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters with the same class and the same lower case in every Unicode version, then marks that are no apostrophe and no "<".
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;?@\\\]^_`{|}~-]*)")
#: Pieces kept by one Python worker; a full cache starts anew.
CACHE_PIECES = 700_000
#: Longer pieces are encoded, but not kept.
KEPT_CHARS = 64
#: Text handled at once.
SLICE_BYTES = 8 << 20
#: The pattern that byte-level vocabularies cut words by, and the word vocabulary's normaliser and pattern.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT = [chr(x) for x in [*range(33, 127), *range(161, 173), *range(174, 256)]]
_OTHER = [x for x in range(256) if chr(x) not in set(_SHORT)]
#: Byte to the printable character that stands for it in byte-level vocabularies, and back.
BYTE_CHARS = {ord(c): c for c in _SHORT} | {x: chr(256 + k) for k, x in enumerate(_OTHER)}
CHAR_BYTES = {c: x for x, c in BYTE_CHARS.items()}


def byte_level(text: str) -> str:
    """The text's UTF-8 bytes, each as its printable character."""
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


def settings(tokenizer) -> tuple[bool, bool] | None:
    """(leading, lower) of a tokenizer whose texts can be cut at single spaces, else None.

    leading: it keeps the space before a word; else it drops all white space.
    lower: it lower-cases.
    """
    d = json.loads(tokenizer.to_str())
    model, pre, normal = d["model"], d["pre_tokenizer"] or {}, d["normalizer"]
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback")) or d["truncation"] or d["padding"]:
        return None
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"]):
        return None
    if pre.get("type") == "Sequence":
        split, *rest = pre["pretokenizers"]
        if len(rest) != 1 or split["type"] != "Split" or rest[0] | {"trim_offsets": True} != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}:
            return None
        how = (split["pattern"].get("Regex"), split["behavior"], split["invert"])
        if normal is None and how == (BYTE_LEVEL_PATTERN, "Isolated", False) and not model.get("end_of_word_suffix"):
            return True, False
        return (False, True) if normal == WORD_NORMALIZER and how == (WORD_PATTERN, "Removed", True) else None
    if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not model.get("end_of_word_suffix"):
        return True, False
    return None


class PieceEncoder:
    """Encodes texts as tokenizer.encode(text, add_special_tokens=False) does.

    tokenizer: a tokenizers.Tokenizer.  Memory is bounded by limit pieces and a few
    times SLICE_BYTES or the longest text.  Nulls count as empty texts.
    """

    def __init__(self, tokenizer, limit: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Python worker; Spark is what runs in parallel
        self.known = settings(tokenizer)
        leading, self.lower = self.known or (True, False)
        self.tokenizer, self.model, self.limit = tokenizer, tokenizer.model, limit
        self.space, self.spaced = (" ", BYTE_CHARS[32]) if leading else ("", "")
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _merged(self, pretoken: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(pretoken)]).tobytes() if pretoken else b""

    def _pieces(self, pieces: list[str], space: str) -> list[bytes]:
        """Ids of pieces that are cut off safely, each with space before it."""
        out: list[bytes] = [b""] * len(pieces)
        odd, spaced, words, marks = [], self.spaced if space else "", {}, self.marks
        plain, tokenize, lower = PLAIN.fullmatch, self.model.tokenize, self.lower
        if len(marks) > 10_000:
            marks.clear()
        for k, piece in enumerate(pieces):
            if (m := plain(piece)) and len(piece) <= KEPT_CHARS:
                word, mark = m.groups()
                if lower:
                    word = word.lower()
                if (ids := words.get(word)) is None:
                    pretoken = spaced + (word if word.isascii() else byte_level(word))
                    ids = words[word] = array("I", [x.id for x in tokenize(pretoken)]).tobytes()
                if mark:
                    if mark not in marks:
                        marks[mark] = self._merged(mark)
                    ids += marks[mark]
                out[k] = ids
            else:
                odd.append(k)
        for at in range(0, len(odd), 1000):
            some = odd[at : at + 1000]
            for k, x in zip(some, self.tokenizer.encode_batch([space + pieces[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = struct.pack(f"<{len(x.ids)}I", *x.ids)
        return out

    def _values(self, known: dict, pieces: list[str], space: str) -> list[bytes]:
        """Ids of distinct pieces."""
        out = list(map(known.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        learned = [pieces[k] for k in new]
        if len(known) + len(new) > self.limit:
            known.clear()
        for k, piece, ids in zip(new, learned, self._pieces(learned, space), strict=True):
            out[k] = ids
            if len(piece) <= KEPT_CHARS:
                known[piece] = ids
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.known:
            found = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array(list(itertools.chain.from_iterable(found)), "<u4"), np.array([len(x) for x in found], np.int64)
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        index, starts = coded.indices.to_numpy(), bounds[:-1] - bounds[0]
        pieces = coded.dictionary.to_pylist()
        pieces, index, starts = self._together(pieces, index, starts)
        heads = np.zeros(len(index), bool)
        heads[starts if self.space else []] = True  # the first piece of a text has no space before it
        values = []
        places = np.empty(len(index), np.int64)
        for known, space, at in ((self.rest, self.space, np.flatnonzero(~heads)), (self.first, "", np.flatnonzero(heads))):
            own = index[at]
            used = np.flatnonzero(np.bincount(own, minlength=len(pieces)))
            place = np.zeros(len(pieces), np.int64)
            place[used] = np.arange(len(values), len(values) + len(used))
            places[at] = place[own]
            values += self._values(known, [pieces[k] for k in used.tolist()], space)
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids = np.frombuffer(b"".join(values), "<u4")
        at, n = (np.cumsum(lengths) - lengths)[places], lengths[places]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        flat = ids[np.repeat((at - (ends - n)).astype(kind), n) + np.arange(total, dtype=kind)]
        return flat, np.add.reduceat(n, starts)

    @staticmethod
    def _together(pieces: list[str], index: np.ndarray, starts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces, their numbers in the texts and each text's first, with open pieces and those after them put together.

        A text's piece is open if it is empty or ends in white space, and isn't the text's last.
        """
        open_ = np.fromiter((not p or p[-1].isspace() for p in pieces), bool, len(pieces))[index]
        open_[np.append(starts[1:], len(index)) - 1] = False
        if not open_.any():
            return pieces, index, starts
        begins = np.flatnonzero(~np.concatenate([[False], open_[:-1]]))
        sizes = np.diff(np.append(begins, len(index)))
        joined, new, own = index[begins].copy(), {}, index.tolist()
        several = np.flatnonzero(sizes > 1)
        numbers = [new.setdefault(tuple(own[b : b + n]), len(pieces) + len(new)) for b, n in zip(begins[several].tolist(), sizes[several].tolist(), strict=True)]
        joined[several] = numbers
        return pieces + [" ".join([pieces[k] for k in key]) for key in new], joined, np.searchsorted(begins, starts)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of texts: its first row's number, all its ids and the count of each row."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            collects = gc.isenabled()
            gc.disable()  # the caches hold no cycles, and walking them is what would cost most
            try:
                flat, counts = self._slice(texts[at:upto])
            finally:
                if collects:
                    gc.enable()
            yield at, flat, counts
            at = upto

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of one text after another."""
        for _, flat, counts in self.encode(texts):
            yield from np.split(flat, np.cumsum(counts)[:-1])
