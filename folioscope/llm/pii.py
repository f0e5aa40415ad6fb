"""Format-preserving pseudonyms for personal data (operator 3).

One pattern finds the candidates, each kind is validated (Luhn digit, octets,
calendar, number ranges), and what is valid is permuted by a keyed Feistel
network on its own format: digits to digits in the same layout, an address to
an address, a date to a date, a card number to one with a right check digit.
The permutation depends on the key and the kind alone, so equal values stay
equal in all documents and different ones stay different, and a valid value
becomes a valid one.  What fails its validation is left as it is.  Mail
addresses, hexadecimal secrets and access keys, which have no numeric format,
become keyed digests of the same form.

All of it is SQL functions on the rows of one scan: no user function, no
shuffle, no join.  Repetition without a bound is possessive in every pattern:
Java matches that in a loop, where any other repeated group is a recursion that
a long text would run out of stack with.

Not covered: dates in words or with years of two digits, and numbers without a
country code in other layouts than those of PHONE.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: For the query over the test tables; whoever has it can take all pseudonyms back.
TEST_KEY = "folioscope-pseudonyms-1"
KEY_SETTING = "spark.folioscope.pii.key"
ROUNDS = 8
FIRST_DAY = datetime.date(1, 1, 1)
DAYS = (datetime.date(9999, 12, 31) - FIRST_DAY).days + 1
#: Dates are permuted within periods of a hundred years, one of which begins on PERIOD_START.
PERIOD_START = datetime.date(1930, 1, 1)
PERIOD = (75, 487)
_PERIOD_DAYS = PERIOD[0] * PERIOD[1]
_SHIFT = _PERIOD_DAYS - (PERIOD_START - FIRST_DAY).days % _PERIOD_DAYS
_EPOCH = (datetime.date(1970, 1, 1) - FIRST_DAY).days

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
ACCESS_KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]|\.[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DOT_DATE = r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|\.[0-9])"
US_DATE = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,5}\)?){2,5}(?![0-9])|(?<![0-9.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
CARD = r"(?<![A-Za-z0-9_])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9_])"
CANDIDATE = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, IP6, IP, ISO_DATE, DOT_DATE, US_DATE, SSN, PHONE, CARD))
#: The country codes of one and two digits; all others have three.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _prf(kind: str, key: str, r: Column, x: Column) -> Column:
    """A number under 2 ** 60 from the key, the kind, the round and a half."""
    digest = F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), r.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(kind: str, key: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """struct(l, r): (left, right) permuted over left_size * right_size pairs."""

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        new_left = F.when(even, F.pmod(acc["l"] + _prf(kind, key, r, acc["r"]), left_size)).otherwise(acc["l"])
        new_right = F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + _prf(kind, key, r, acc["l"]), right_size))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _with(value: Column, use) -> Column:
    """use(value), where value is worked out once."""
    return F.transform(F.array(value), use)[0]


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(kind: str, key: str, digits: Column) -> Column:
    """A digit string of the same length; a permutation for each kind, key and length (2 to 36)."""

    def run(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        new = feistel(kind, key, F.substring(d, F.lit(1), a).cast("long"), F.substring(d, a + 1, n - a).cast("long"), _power(a), _power(n - a))
        return _with(new, lambda x: F.concat(F.lpad(x["l"].cast("string"), a, "0"), F.lpad(x["r"].cast("string"), n - a, "0")))

    return _with(digits, run)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _layout(m: Column, digits: Column) -> Column:
    """m with its digits replaced by those, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))

    def step(acc: Column, ch: Column) -> Column:
        is_digit = ch.rlike("[0-9]")
        return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(ch)).alias("s"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(m, ""), start, step)["s"]


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a digit string, where every second digit from the right is doubled, from number doubled on (0: the last)."""

    def step(s: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == doubled, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    """All digits but the last, which is the Luhn digit; a number of one digit only is no card's."""
    one_digit = r"^(.)\1*$"

    def permuted(d: Column) -> Column:
        body = permute_digits("card", key, F.substring(d, F.lit(1), F.length(d) - 1))
        return _with(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))

    def run(d: Column) -> Column:
        new = _with(permuted(d), lambda x: F.when(x.rlike(one_digit), permuted(x)).otherwise(x))
        return F.when((luhn_sum(d, 1) % 10 == 0) & ~d.rlike(one_digit), _with(new, lambda x: _layout(m, x)))

    return _with(_digits(m), run)


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code, which is there where there is a +."""

    def run(d: Column) -> Column:
        skip = F.when(m.startswith("+"), F.length(F.regexp_extract(d, COUNTRY, 0))).otherwise(0)
        new = F.concat(F.substring(d, F.lit(1), skip), permute_digits("phone", key, F.substring(d, skip + 1, F.length(d))))
        return F.when(F.length(d).between(8, 15), _with(new, lambda x: _layout(m, x)))

    return _with(_digits(m), run)


def _ssn(m: Column, key: str) -> Column:
    """Within the valid numbers: areas 001 to 899 but 666, groups from 01, serials from 0001."""
    valid = ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    new = feistel("ssn", key, area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    shown = lambda x: F.concat_ws("-", pad(x["l"] + 1 + (x["l"] >= 665).cast("int"), 3), pad(F.floor(x["r"] / 9999) + 1, 2), pad(x["r"] % 9999 + 1, 4))
    return F.when(valid, _with(new, shown))


def _ip(m: Column, key: str) -> Column:
    part = lambda k: F.split(m, r"\.")[k].cast("int")
    valid = F.greatest(*(part(k) for k in range(4))) < 256
    new = feistel("ip", key, part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
    octets = lambda x: F.concat_ws(".", *((F.floor(x[h] / 256) if top else x[h] % 256).cast("string") for h in "lr" for top in (True, False)))
    return F.when(valid, _with(new, octets))


def _ip6(m: Column, key: str) -> Column:
    """The seven groups after the first, which tells the kind of address; in lower case, without leading zeros."""

    def run(h: Column) -> Column:
        half = lambda at: F.conv(F.substring(h, at, 14), 16, 10).cast("long")
        new = feistel("ip6", key, half(5), half(19), F.lit(1 << 56), F.lit(1 << 56))
        digits = lambda x: F.concat(*(F.lpad(F.lower(F.hex(x[k])), 14, "0") for k in "lr"))
        groups = lambda x: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.regexp_replace(F.substring(x, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))
        return _with(_with(new, digits), lambda x: F.concat_ws(":", F.regexp_replace(F.substring(h, 1, 4), "^0{1,3}", ""), groups(x)))

    return _with(F.array_join(F.transform(F.split(F.lower(m), ":"), lambda g: F.lpad(g, 4, "0")), ""), run)


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A: 10) make, modulo 97."""

    def step(acc: Column, ch: Column) -> Column:
        letter = ch.rlike("[A-Z]")
        return (acc * F.when(letter, 100).otherwise(10) + F.ascii(ch) - F.when(letter, 55).otherwise(48)) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """The digits of the account, not its letters; the check digits follow."""

    def run(x: Column) -> Column:
        country, check, account = F.substring(x, 1, 2), F.substring(x, 3, 2), F.substring(x, F.lit(5), F.length(x))
        valid = check.between("02", "98") & (_mod97(F.concat(account, country, check)) == 1) & (F.length(_digits(account)) >= 2)
        digits = permute_digits("iban", key, _digits(account))
        new = _with(digits, lambda d: _layout(account, d))
        checked = _with(new, lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), _digits(b)))
        return F.when(valid, _with(checked, lambda d: _layout(m, d)))

    return _with(F.regexp_replace(m, " ", ""), run)


def _date(m: Column, key: str, at: tuple[int, int, int], form: str) -> Column:
    """Within the date's period; those at either end of the calendar, which are shorter, are rotated.  at: where year, month and day begin."""
    y, mo, d = (F.substring(m, p, 4 if k == 0 else 2).cast("int") for k, p in enumerate(at))
    first = F.make_date(y, mo, F.lit(1))
    valid = F.when((y >= 1) & mo.between(1, 12), d.between(1, F.dayofmonth(F.last_day(first)))).otherwise(F.lit(False))

    def run(day: Column) -> Column:
        begin = F.floor((day + _SHIFT) / _PERIOD_DAYS) * _PERIOD_DAYS - _SHIFT
        return _with(F.struct(day.alias("d"), F.greatest(begin, F.lit(0)).alias("a"), F.least(begin + _PERIOD_DAYS, F.lit(DAYS)).alias("b")), within)

    def within(x: Column) -> Column:
        whole = x["b"] - x["a"] == _PERIOD_DAYS
        rows, side = F.when(whole, PERIOD[0]).otherwise(1), F.when(whole, F.lit(PERIOD[1]).cast("long")).otherwise(x["b"] - x["a"])
        place = x["d"] - x["a"]
        return _with(feistel("date", key, F.floor(place / side), place % side, rows, side), lambda n: x["a"] + n["l"] * side + n["r"])

    new = _with(F.unix_date(F.date_add(first, d - 1)) + _EPOCH, run)
    return F.when(valid, _with(new, lambda x: F.date_format(F.date_from_unix_date((x - _EPOCH).cast("int")), form)))


def _digest(kind: str, key: str, m: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), F.lower(m)), 512)


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal digits that follow from a digest, as many as there were, in the same case."""

    def run(d: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 128)), lambda i: F.sha2(F.concat(d, F.lit("|"), i.cast("string")), 512))
        return F.substring(F.array_join(parts, ""), F.lit(1), F.length(m))

    return _with(_with(_digest("secret", key, m), run), lambda x: F.when(m.rlike("[a-f]"), x).otherwise(F.upper(x)))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or null where it is not valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), F.concat(F.lit("u"), F.substring(_digest("email", key, m), 1, 16), F.lit("@mail.invalid")))
        .when(whole("[0-9A-Fa-f]{32,}+") & m.rlike("[A-Fa-f]"), _secret(m, key))
        .when(whole("A[KS]IA[A-Z0-9]{16}"), F.concat(F.substring(m, 1, 4), F.upper(F.substring(_digest("access", key, m), 1, 16))))
        .when(m.contains(":"), _ip6(m, key))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), _iban(m, key))
        .when(whole(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), _ip(m, key))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}"), _date(m, key, (1, 6, 9), "yyyy-MM-dd"))
        .when(whole(r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), _date(m, key, (7, 4, 1), "dd.MM.yyyy"))
        .when(whole("[0-9]{2}/[0-9]{2}/[0-9]{4}"), _date(m, key, (7, 1, 4), "MM/dd/yyyy"))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(m, key))
        .when(m.startswith("+") | whole(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"), _phone(m, key))
        .when(F.length(_digits(m)).between(13, 19), _card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with the personal data in text replaced; count names a new column with how many were.

    key: the secret of the permutations.  A null text stays null and counts 0, an
    empty one stays empty; texts are taken whole, however long.  Repeated rows get
    equal texts, whatever their other columns hold; empty tables, other columns and
    their order stay as they are.  If count is a column of docs, it is replaced.
    """
    found = "_p" + "_" * max((len(c) for c in docs.columns), default=0)
    gaps, new = found + "g", found + "n"
    c = F.col
    none = F.array().cast("array<string>")
    out = docs.withColumn(found, F.coalesce(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), none))
    out = out.withColumn(new, F.transform(found, lambda m: pseudonym(m, key)))
    out = out.withColumn(gaps, F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)))
    parts = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.get(found, i), F.lit(""))))
    replaced = {text: F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(c(text))}
    if count:
        replaced[count] = F.size(F.array_compact(new)).cast("long")
    return out.withColumns(replaced).drop(found, gaps, new)


def key_of(spark: SparkSession) -> str:
    """The key that the session's settings name, else the one for tests."""
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and how many values were replaced in each."""
    return pseudonymise(common.table(spark, sf_dir, "documents"), key_of(spark), count="n_pii")
