"""Column expressions on text, all evaluated by the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import constants as K


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(x: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.trim(x, F.lit(K.SPACE_CHARACTERS))


def bare(x: Column) -> Column:
    """Do printable ASCII characters stand at both ends, so that there is nothing to strip?"""
    return F.ascii(x).between(33, 126) & F.ascii(F.substring(x, -1, 1)).between(33, 126)


def norm(x: Column) -> Column:
    return F.lower(strip(x))


def matches(x: Column, pattern: str) -> Column:
    return x.rlike(pattern)


def to_double(x: Column) -> Column:
    """Text to double, NULL when it is not a plain decimal number."""
    s = strip(x)
    return F.when(number_start(s) & s.rlike(K.NUMBER), s.try_cast("double"))


def number_start(x: Column) -> Column:
    """Does the text begin like a number (sign, point or digit)? Spares the pattern on other text."""
    return F.ascii(x).between(43, 57)


def without(x: Column, characters: str) -> Column:
    return F.translate(x, characters, "")


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def numeric_looking(x: Column) -> Column:
    """Does the text read as a number once separators, currency and percent signs are gone?"""
    s = strip(without(x, ",$₹%"))
    return number_start(s) & s.rlike(K.NUMBER)


def value_key(x: Column) -> Column:
    """A short stand-in for a text value: itself, or its digest when it is long.

    Counting distinct documents then shuffles 40 bytes per value instead of the whole text.
    """
    return F.when(F.length(x) > 40, F.concat(F.lit("md5:"), F.md5(x))).otherwise(x)


def name_has(name: str, words: list[str]) -> bool:
    """Does a column name contain any of the words, anywhere?"""
    low = name.lower()
    return any(w in low for w in words)


# Column names often join two words; the last one tells what they hold.
COMPOUNDS = {
    "date": {"datetime", "orderdate", "shipdate", "commitdate", "receiptdate", "duedate", "startdate", "enddate", "birthdate", "hiredate", "saledate"},
    "time": {"datetime", "timestamp", "starttime", "endtime"},
    "phone": {"telephone", "cellphone", "phonenumber", "phoneno", "homephone", "workphone"},
    "mail": {"email"}, "email": {"emailaddress", "useremail"}, "year": {"birthyear", "fiscalyear"}, "mobile": {"mobilenumber", "mobileno"},
}


def name_has_token(name: str, words: list[str]) -> bool:
    """Is any token of a column name one of the words, its plural, or a listed compound of it?

    Tokens split at non-letters and at camelCase humps, so 'date' meets 'order_date' but not 'candidate'.
    """
    import re

    humps = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    tokens = {t for t in re.split(r"[^a-z]+", humps.lower()) if t}
    return any(w in tokens or w + "s" in tokens or tokens & COMPOUNDS.get(w, set()) for w in words)


def fix_mojibake(x: Column) -> Column:
    out = x
    for bad, good in K.MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.replace(out, F.lit("\u00a0"), F.lit(" "))


# Text without any of these is tidy already: edge or double spaces, or anything but printable ASCII.
UNTIDY = r"^ | $|  |[^\x20-\x7E]"


def clean_space(x: Column) -> Column:
    """Drop zero-width characters, turn odd white space into spaces, collapse and strip."""
    plain = F.translate(x, "\u00a0\t\r\n\u200b\u200c\u200d\ufeff", "    ")
    tidy = strip(F.regexp_replace(plain, K.SPACE + "{2,}", " "))
    return F.when(x.rlike(UNTIDY), tidy).otherwise(x)


def is_null_token(x: Column, extra: tuple[str, ...] = ()) -> Column:
    return norm(x).isin(*K.NULL_TOKENS, *extra)


def words(x: Column) -> Column:
    """Words between white space of any kind."""
    plain = F.translate(x, K.SPACE_CHARACTERS, " " * len(K.SPACE_CHARACTERS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def title_case(x: Column) -> Column:
    """Upper case for the first letter of every run of letters, lower case for the others."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")
