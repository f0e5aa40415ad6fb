"""Quality rules as one Spark projection (operator 7).

A table of thresholds (RULES) is compiled into one expression over counts that
JVM functions take from each text: words, symbols, stop words, lines.  There is
no user function, no shuffle and no join.

Repeated words: the text's 3-word windows are compared with their distinct set
first.  Only texts where those differ sort their windows with positions, and
mark the equal neighbours; so the work is n log n of one text's words and no
window leaves its row.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = sorted(
    set(
        "the be to of and that have with a in is it for was on are as at by this from or not "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er einer "
        "le la les de des du un une et est en que qui dans par pour pas au sur ne se "
        "el los las y del con por para una su no lo al como más".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """A text fails when factor * top exceeds share * bottom (sign 1), or falls short of it (sign -1)."""

    name: str
    top: str
    factor: int
    share: int
    bottom: str
    sign: int = 1

    def fails(self, bottom: Column | None = None, top: Column | None = None) -> Column:
        a = (F.col(self.top) if top is None else top) * self.factor
        b = (F.col(self.bottom) if bottom is None else bottom) * self.share
        return a > b if self.sign > 0 else a < b

    def sql(self) -> str:
        return f"{self.top} * {self.factor} {'>' if self.sign > 0 else '<'} {self.bottom} * {self.share}"


RULES = (
    # the two that are fixed: under 50 words, or over half of the words in repeated windows
    Rule("few_words", "n_words", 1, 50, "one", -1),
    Rule("repeated_words", "n_repeat_words", 100, 50, "n_words"),
    # length: 2 to 20 characters a word
    Rule("short_words", "word_chars", 1, 2, "n_words", -1),
    Rule("long_words", "word_chars", 1, 20, "n_words"),
    # symbols: at most 1 for each 10 words
    Rule("symbols", "n_symbols", 100, 10, "n_words"),
    # stop words: at least 1 in 25
    Rule("stop_words", "n_stop_words", 100, 4, "n_words", -1),
    # lines, of those with a word
    Rule("repeated_lines", "n_dup_lines", 100, 50, "n_lines"),
    Rule("bullets", "n_bullets", 100, 90, "n_lines"),
    Rule("cut_off_lines", "n_ellipses", 100, 30, "n_lines"),
)
BASE = ("few_words", "repeated_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_bullets", "n_ellipses", "n_repeat_words")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column counts, which holds COUNTS as longs; a null text has no words."""
    # names that no column of docs has
    own = "_q" + "_" * max((len(c) for c in docs.columns), default=0)
    t, words, lines, windows, sorted_, at = (own + x for x in ("t", "w", "l", "x", "s", "p"))
    c = F.col
    out = docs.withColumn(t, F.coalesce(c(text), F.lit("")))
    out = out.withColumns({words: F.array_remove(F.split(t, SPACE), ""), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    spots = F.sequence(F.lit(0), F.size(words) - 3)
    three = F.transform(spots, lambda i: F.concat_ws(" ", c(words)[i], c(words)[i + 1], c(words)[i + 2]))
    out = out.withColumn(windows, F.when(F.size(words) > 2, three).otherwise(F.array().cast("array<string>")))
    ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = out.withColumn(sorted_, F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered))
    same = lambda j, k: F.get(sorted_, j)["x"] == F.get(sorted_, k)["x"]
    twice = F.transform(sorted_, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"]))
    out = out.withColumn(at, F.array_compact(twice))
    covered = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))
    number = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_repeat_words": F.when(c(sorted_).isNull(), 0).otherwise(F.size(covered)),
    }
    counts = F.struct(*(number[k].cast("long").alias(k) for k in COUNTS))
    return out.withColumn(own, counts).drop(t, words, lines, windows, sorted_, at).withColumnRenamed(own, own + "counts")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS, base_failed, failed (names of the rules that a text breaks, joined by commas), kept.

    Null, empty and white texts have no words and fail.  Repeated rows each give
    theirs; an empty table gives none; other columns are not looked at.  The counts
    come out of a generator, so a filter on the verdict isn't pushed into them.
    """
    rows = counted(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    counts = rows.columns[-1]
    rows = rows.select("key", F.explode(F.array(counts)).alias(counts))
    rows = rows.select(F.col("key").alias(key), f"{counts}.*", F.lit(1).cast("long").alias("one"))
    failed = F.concat_ws(",", *(F.when(r.fails(), r.name) for r in rules))
    base = [r.fails() for r in rules if r.name in BASE]
    return rows.select(key, *COUNTS, (base[0] | base[1]).alias("base_failed"), failed.alias("failed"), (failed == "").alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that break no rule, with the columns of docs.

    The verdict is taken inside a generator, which gives a row or none: a filter
    would be pushed below the projections, and with it a copy of all the counting
    for each count that a rule reads.
    """
    rows = counted(docs, text)
    counts = rows.columns[-1]

    def good(x: Column) -> Column:
        fails = [r.fails(F.lit(1) if r.bottom == "one" else x[r.bottom], x[r.top]) for r in rules]
        return ~functools.reduce(lambda a, b: a | b, fails)

    return rows.select(*(F.col(c) for c in docs.columns), F.explode(F.filter(F.array(counts), good)).alias(counts)).drop(counts)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for all documents."""
    return judge(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t,
        list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
      from d),
tri as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
rep as (select doc_id, g from tri group by doc_id, g having count(*) > 1),
cov as (select doc_id, count(distinct p) as n
        from (select tri.doc_id, unnest([i, i + 1, i + 2]) as p from tri join rep on tri.doc_id = rep.doc_id and tri.g = rep.g)
        group by doc_id),
c as (select w.doc_id, cast(len(ws) as bigint) as n_words,
        cast(length(array_to_string(ws, '')) as bigint) as word_chars,
        cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
        cast(len(list_filter(ws, lambda x: x in ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) as bigint) as n_stop_words,
        cast(len(ls) as bigint) as n_lines,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
        cast(len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) as bigint) as n_bullets,
        cast(len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) as bigint) as n_ellipses,
        coalesce(cov.n, 0) as n_repeat_words, 1 as one
      from w left join cov on w.doc_id = cov.doc_id)
select doc_id, {", ".join(COUNTS)}, ({" or ".join(r.sql() for r in RULES if r.name in BASE)}) as base_failed,
  concat_ws(',', {", ".join(f"case when {r.sql()} then '{r.name}' end" for r in RULES)}) as failed,
  not ({" or ".join(r.sql() for r in RULES)}) as kept
from c
"""
