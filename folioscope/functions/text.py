"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of white space as every engine here understands them.
SPACE = r"[ \t\n\r\f\x0B]+"

# ---- fixed values: patterns, words and bounds on which results depend

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(])"
#: References of a section to others, as a parser counts them.
PARSED_REFERENCES = (
    r"section\s+(\d+[A-Z]?)",
    r"under\s+section\s+(\d+[A-Z]?)",
    r"subject\s+to\s+(?:the\s+provisions\s+of\s+)?section\s+(\d+[A-Z]?)",
    r"referred\s+to\s+in\s+section\s+(\d+[A-Z]?)",
    r"provided\s+(?:for\s+)?(?:in|under)\s+section\s+(\d+[A-Z]?)",
    r"notwithstanding\s+(?:anything\s+)?(?:contained\s+)?in\s+section\s+(\d+[A-Z]?)",
    r"order\s+([IVX]+)",
    r"rule\s+(\d+)",
)
#: References that a chunk is augmented with, in the order in which they count.
CHUNK_REFERENCES = (
    r"subject\s+to\s+(?:the\s+provisions\s+of\s+)?section\s+(\d+[A-Z]?)",
    r"notwithstanding\s+(?:anything\s+)?(?:contained\s+)?in\s+section\s+(\d+[A-Z]?)",
    r"under\s+section\s+(\d+[A-Z]?)",
    r"referred\s+to\s+in\s+section\s+(\d+[A-Z]?)",
    r"section\s+(\d+[A-Z]?)",
    r"order\s+([IVX]+)",
    r"rule\s+(\d+)",
)
#: Datasets by what a path holds, in this order, then by words of the query, in this one.
PATH_DATASETS = ("contractnli", "cuad", "maud", "privacyqa")
WORD_DATASETS = (("contractnli", ("non-disclosure", "nda")), ("privacyqa", ("privacy", "data practice")), ("maud", ("merger", "acquisition", "m&a")))
DEFAULT_DATASET = "cuad"

# ----

#: Version 1 of the stop words that a lexical index may leave out.
STOP_WORDS_V1 = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def tokens_estimate(text: Column) -> Column:
    """Four characters to a token."""
    return F.floor(F.length(text) / 4).cast("int")


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalised(text: Column, limit: int = 5000) -> Column:
    """White space runs become one space, ends are stripped, the rest is cut."""
    return F.substring(strip(F.regexp_replace(text, r"(?U)\s+", " ")), 1, limit)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def terms(text: Column, least: int = 2) -> Column:
    """Lower-case ASCII terms of at least that many characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Stripped sentences, blank ones left out."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def mentioned_sections(text: Column, compat: bool = False) -> Column:
    """Distinct section or article numbers that a text mentions: extract once, then join on equality.

    compat: a § counts only right after a word's character.
    """
    sign = r"(?U)\b§\s*(\w+)\b" if compat else r"(?U)(?<!\w)§\s*(\w+)\b"
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(?iU)\b(?:section|article)\s+(\w+)\b", sign)]
    return F.array_distinct(F.concat(*found))


def references(text: Column, patterns: tuple[str, ...] = CHUNK_REFERENCES) -> Column:
    """Distinct references, pattern by pattern, then in text order."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in patterns)))


def subdataset(path: Column, text: Column) -> Column:
    """The dataset that a path, without its underscores, names, else what the query's words hint at."""
    p, t = F.replace(F.lower(path), F.lit("_"), F.lit("")), F.lower(text)
    out = F.when(F.lit(False), "")
    for name in PATH_DATASETS:
        out = out.when(p.contains(name), name)
    for name, hints in WORD_DATASETS:
        for hint in hints:
            out = out.when(t.contains(hint), name)
    return out.otherwise(DEFAULT_DATASET)


def same_file(a: Column, b: Column) -> Column:
    """Do two paths name one file: equal, of equal stem, or one within the other?"""
    return (a == b) | (stem(a) == stem(b)) | a.contains(b) | b.contains(a)


def format_p(p: Column) -> Column:
    """A p-value for a table."""
    return F.when(p < 0.0001, "≤0.0001").when(p < 0.001, F.format_string("%.4f", p)).otherwise(F.format_string("%.3f", p))
