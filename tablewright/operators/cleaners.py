"""Gated text cleaners: what each one counts, when it acts, and what it does.

A cleaner is three small pieces of Column algebra. ``counts`` are conditions tallied over a
column's non-null values; ``fires`` decides from the tallies and the column's name; ``apply``
is the expression to run when it does. Running them on a table is the plan module's work.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions import constants as K
from tablewright.functions.dates import parse_date
from tablewright.functions.text import (clean_space, fix_mojibake, is_null_token, let, name_has_token, norm, number_start,
                                        strip, to_double, without)

Tally = dict  # name of a count -> its value; "present" holds the non-null values


def ratio(t: Tally, name: str) -> float:
    return t[name] / t["present"] if t["present"] else 0.0


@dataclass(frozen=True)
class Cleaner:
    name: str
    action: str
    confidence: int
    counts: Callable[[Column], dict[str, Column]]
    fires: Callable[[Tally, str], bool]
    apply: Callable[[Column, Tally, str], Column]
    affected: Callable[[Tally, str], int]
    output: Callable[[Tally], str | None] = field(default=lambda t: None)  # new type, None stays text
    concerns: Callable[[str], bool] = field(default=lambda n: True)  # column names worth counting for


# --------------------------------------------------------------------------- expressions


def nullify(x: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.when(~is_null_token(x, extra), x)


def percent_value(x: Column) -> Column:
    return to_double(without(x, "%,"))


def boolean_value(x: Column, true: list[str] = K.TRUE_TOKENS, false: list[str] = K.FALSE_TOKENS) -> Column:
    low = norm(x)
    return F.when(low.isin(*true), F.lit(True)).when(low.isin(*false), F.lit(False))


def year_value(x: Column, named: bool, cutoff: int = 30) -> Column:
    def settled(number: Column) -> Column:
        whole = (number == F.floor(number))
        full = F.when(whole & number.between(1900, 2100), number)
        if named:
            full = F.when(whole & number.between(0, cutoff), number + 2000).when(whole & number.between(0, 99), number + 1900).otherwise(full)
        return F.when(full.between(1900, 2100), full).cast("int")

    s = strip(x)
    return F.when(number_start(s), let(to_double(F.regexp_replace(s, r"\.0$", "")), settled))


def phone_value(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"[\s\-\.\(\)]", "")


def paren_value(x: Column) -> Column:
    """Text with accounting negatives rewritten as signed numbers."""
    s, inner = strip(x), _inside_parens(x)
    return F.when(in_parens(x) & inner.isNotNull(), (-inner).cast("string")).otherwise(s)


def _inside_parens(x: Column) -> Column:
    return to_double(F.regexp_replace(strip(x), r"[\(\)\$₹£€¥,\s]", ""))


def in_parens(x: Column) -> Column:
    s = strip(x)
    return s.startswith("(") & s.endswith(")") & s.rlike(K.PAREN_NUMBER)


def paren_numeric(x: Column) -> Column:
    """Is the value a number once accounting negatives are read?"""
    return F.when(in_parens(x), _inside_parens(x).isNotNull()).otherwise(to_double(x).isNotNull())


def is_percent(x: Column) -> Column:
    s = strip(x)
    return s.endswith("%") & s.rlike(K.PERCENT)


def is_rating(x: Column) -> Column:
    return F.lower(x).contains("out") & strip(x).rlike(K.RATING)


def digit_first(x: Column, pattern: str) -> Column:
    s = strip(x)
    return F.ascii(s).between(48, 57) & s.rlike(pattern)


def email_value(x: Column) -> Column:
    """Lower case, with the domain replaced when it is a known typo."""
    import re

    out = norm(x)
    for right in sorted(set(K.EMAIL_DOMAIN_FIXES.values())):
        typos = "|".join(re.escape(bad) for bad, good in K.EMAIL_DOMAIN_FIXES.items() if good == right)
        out = F.regexp_replace(out, f"@({typos})$", "@" + right)
    return out


def prefix_pattern(prefixes: list[str]) -> str:
    """One alternation of literal prefixes, tried in the given order."""
    import re

    return r"(?i)^(" + "|".join(re.escape(p).replace(r"\ ", " ") for p in prefixes) + ")"


def drop_prefix(x: Column, prefixes: list[str]) -> Column:
    return strip(F.regexp_replace(strip(x), prefix_pattern(prefixes), ""))


def rating_value(x: Column) -> Column:
    return F.regexp_extract(strip(x), K.RATING, 1).try_cast("double")


def drop_marks(x: Column) -> Column:
    return strip(F.regexp_replace(x, K.REFERENCE_MARK, ""))


def currency_value(x: Column) -> Column:
    plain = F.regexp_replace(x, r"[\$₹£€¥,\s]", "")
    return to_double(F.regexp_replace(plain, K.REFERENCE_MARK, ""))


def separated_value(x: Column) -> Column:
    return to_double(without(x, ","))


def standard_number(x: Column) -> Column:
    """One notation for numbers: 1,234.5 and 1.234,5 both become 1234.5."""
    s = strip(x)
    european = s.rlike(K.EUROPEAN_NUMBER) & (s.contains(",") | s.rlike(r"\..*\."))
    return F.when(european, F.translate(F.translate(s, ".", ""), ",", ".")).otherwise(without(x, ","))


def iso_date(x: Column) -> Column:
    return F.coalesce(F.date_format(parse_date(x), "yyyy-MM-dd"), x)


# --------------------------------------------------------------------------- the cleaners

def with_option(name: str, option) -> str:
    """A cleaner's name with its option, which ``named`` turns back into the cleaner."""
    return name if option is None else f"{name}:{json.dumps(option)}"


def null_strings(extra: tuple[str, ...] = ()) -> Cleaner:
    """Texts that stand for nothing, and any of ``extra`` (compared without case and edge space)."""
    extra = tuple(token.strip().lower() for token in extra)
    return Cleaner(
        with_option("null_strings", list(extra) or None), "CLEAN_NULL_STRINGS", 96,
        lambda x: {"null_tokens": is_null_token(x, extra)},
        lambda t, n: t["null_tokens"] > 0,
        lambda x, t, n: nullify(x, extra),
        lambda t, n: t["null_tokens"])


NULL_STRINGS = null_strings()

WHITESPACE = Cleaner(
    "whitespace", "CLEAN_WHITESPACE", 98,
    lambda x: {"odd_space": clean_space(x) != x},
    lambda t, n: t["odd_space"] > 0,
    lambda x, t, n: clean_space(x),
    lambda t, n: t["odd_space"])


def prefix_cleaner(extra: tuple[str, ...] = ()) -> Cleaner:
    extra = [p.lower() for p in extra]
    prefixes = K.LABEL_PREFIXES + extra
    pattern = prefix_pattern(prefixes)
    return Cleaner(
        with_option("text_prefixes", extra or None), "STRIP_TEXT_PREFIXES", 95,
        lambda x: {"prefixed": strip(x).rlike(pattern)},
        lambda t, n: t["prefixed"] > 0 and ratio(t, "prefixed") >= 0.3,
        lambda x, t, n: drop_prefix(x, prefixes),
        lambda t, n: t["prefixed"])


TEXT_PREFIXES = prefix_cleaner()

RATINGS = Cleaner(
    "rating_strings", "EXTRACT_RATING", 97,
    lambda x: {"ratings": is_rating(x)},
    lambda t, n: ratio(t, "ratings") >= 0.4,
    lambda x, t, n: rating_value(x),
    lambda t, n: t["ratings"], lambda t: "double")

def percentages(as_share: bool = False) -> Cleaner:
    """Percentages as numbers: 45% is 45, or 0.45 ``as_share``."""
    return Cleaner(
        with_option("percentages", as_share or None), "CLEAN_PERCENTAGES", 94,
        lambda x: {"percents": is_percent(x)},
        lambda t, n: ratio(t, "percents") >= 0.4,
        lambda x, t, n: percent_value(x) / 100 if as_share else percent_value(x),
        lambda t, n: t["percents"], lambda t: "double")


PERCENTAGES = percentages()

BOOLEANS = Cleaner(
    "booleans", "NORMALIZE_BOOLEANS", 93,
    lambda x: {"booleans": norm(x).isin(*K.TRUE_TOKENS, *K.FALSE_TOKENS)},
    lambda t, n: ratio(t, "booleans") >= 0.7,
    lambda x, t, n: boolean_value(x),
    lambda t, n: t["booleans"], lambda t: "boolean")


def _parens_numeric(t: Tally) -> bool:
    return ratio(t, "paren_numeric") > 0.6


NEGATIVE_PARENS = Cleaner(
    "negative_parens", "CLEAN_NEGATIVE_PARENS", 94,
    lambda x: {"parens": in_parens(x), "paren_numeric": paren_numeric(x)},
    lambda t, n: t["parens"] >= 2 and ratio(t, "parens") >= 0.05,
    lambda x, t, n: to_double(paren_value(x)) if _parens_numeric(t) else paren_value(x),
    lambda t, n: t["parens"], lambda t: "double" if _parens_numeric(t) else None)

EMAILS = Cleaner(
    "emails", "NORMALIZE_EMAILS", 92,
    lambda x: {"email_changes": email_value(x) != strip(x)},
    lambda t, n: name_has_token(n, K.EMAIL_NAMES) and t["email_changes"] > 0,
    lambda x, t, n: email_value(x),
    lambda t, n: t["email_changes"], concerns=lambda n: name_has_token(n, K.EMAIL_NAMES))

PHONES = Cleaner(
    "phone_numbers", "NORMALIZE_PHONES", 90,
    lambda x: {"phones": strip(x).rlike(K.PHONE), "phone_changes": phone_value(x) != x},
    lambda t, n: name_has_token(n, K.PHONE_NAMES) and ratio(t, "phones") >= 0.5 and t["phone_changes"] > 0,
    lambda x, t, n: phone_value(x),
    lambda t, n: t["phone_changes"], concerns=lambda n: name_has_token(n, K.PHONE_NAMES))

INDIAN_NUMBERS = Cleaner(
    "indian_numbers", "CLEAN_INDIAN_NUMBERS", 88,
    lambda x: {"indian": digit_first(x, K.INDIAN_NUMBER), "western": digit_first(x, K.WESTERN_NUMBER)},
    lambda t, n: t["indian"] >= 3 and ratio(t, "indian") >= 0.3 and t["western"] < t["indian"],
    lambda x, t, n: separated_value(x),
    lambda t, n: t["indian"], lambda t: "double")


def _year_like(t: Tally, n: str) -> float:
    named = name_has_token(n, K.YEAR_NAMES)
    return (t["years"] + (t["short_years"] if named else 0)) / t["present"] if t["present"] else 0.0


def years(cutoff: int | None = None) -> Cleaner:
    """Years as whole numbers; two digits up to the cutoff (30 unless told) are of this century."""
    last = 30 if cutoff is None else cutoff
    return Cleaner(
        with_option("years", cutoff), "CLEAN_YEARS", 95,
        lambda x: {"years": digit_first(x, K.YEAR_ONLY), "short_years": digit_first(x, K.YEAR_SHORT),
                   "valid_years": year_value(x, True, last).isNotNull(), "valid_long_years": year_value(x, False, last).isNotNull()},
        lambda t, n: (_year_like(t, n) >= 0.5 and t["valid_years"] > 0) if name_has_token(n, K.YEAR_NAMES)
        else (_year_like(t, n) >= 0.7 and t["valid_long_years"] > 0),
        lambda x, t, n: year_value(x, name_has_token(n, K.YEAR_NAMES), last),
        lambda t, n: t["valid_years"] if name_has_token(n, K.YEAR_NAMES) else t["valid_long_years"], lambda t: "int")


YEARS = years()

DATES = Cleaner(
    "dates", "NORMALIZE_DATES", 90,
    lambda x: {"years": digit_first(x, K.YEAR_ONLY), "dates": parse_date(x).isNotNull()},
    lambda t, n: t["present"] > 0 and ratio(t, "years") <= 0.7 and t["dates"] > 0
    and ratio(t, "dates") >= (0.3 if name_has_token(n, K.DATE_NAMES) else 0.5),
    lambda x, t, n: parse_date(x),
    lambda t, n: t["dates"], lambda t: "timestamp")

MOJIBAKE = Cleaner(
    "mojibake", "FIX_ENCODING", 95,
    lambda x: {"broken": fix_mojibake(x) != x},
    lambda t, n: t["broken"] > 0,
    lambda x, t, n: fix_mojibake(x),
    lambda t, n: t["broken"])

REFERENCES = Cleaner(
    "references", "STRIP_REFERENCES", 92,
    lambda x: {"marks": x.rlike(K.REFERENCE_MARK), "mark_changes": drop_marks(x) != x},
    lambda t, n: t["marks"] > 0 and (t["marks"] >= 2 or ratio(t, "marks") > 0.05),
    lambda x, t, n: drop_marks(x),
    lambda t, n: t["mark_changes"])

CURRENCY = Cleaner(
    "currency", "PARSE_CURRENCY", 95,
    lambda x: {"symbols": x.rlike(K.CURRENCY), "currency_numbers": currency_value(x).isNotNull()},
    lambda t, n: ratio(t, "symbols") > 0.3 and ratio(t, "currency_numbers") > 0.6,
    lambda x, t, n: currency_value(x),
    lambda t, n: t["currency_numbers"], lambda t: "double")

TEXT_TO_NUMERIC = Cleaner(
    "text_to_numeric", "CONVERT_TO_NUMERIC", 90,
    lambda x: {"separated_numbers": separated_value(x).isNotNull()},
    lambda t, n: ratio(t, "separated_numbers") > 0.7,
    lambda x, t, n: separated_value(x),
    lambda t, n: t["separated_numbers"], lambda t: "double")


def date_shapes(x: Column) -> dict[str, Column]:
    return {f"shape_{i}": x.rlike(p) for i, p in enumerate(K.DATE_SHAPES.values())}


STANDARD_DATES = Cleaner(
    "standard_dates", "STANDARDIZE_DATE", 88,
    lambda x: {**date_shapes(x), "dates": parse_date(x).isNotNull()},
    lambda t, n: sum(t[f"shape_{i}"] > 0 for i in range(3)) > 1 and ratio(t, "dates") >= 0.8,
    lambda x, t, n: iso_date(x),
    lambda t, n: t["dates"])

STANDARD_NUMBERS = Cleaner(
    "standard_numbers", "STANDARDIZE_NUMBER", 85,
    lambda x: {"comma_numbers": x.rlike(K.WESTERN_NUMBER), "dot_numbers": x.rlike(K.EUROPEAN_NUMBER),
               "standard_numbers": to_double(standard_number(x)).isNotNull()},
    lambda t, n: t["comma_numbers"] > 0 and t["dot_numbers"] > 0 and ratio(t, "standard_numbers") > 0.7,
    lambda x, t, n: standard_number(x),
    lambda t, n: t["standard_numbers"])

PARSE_YEARS = Cleaner(
    "parse_years", "PARSE_YEAR", 95,
    lambda x: {"years": digit_first(x, K.YEAR_ONLY)},
    lambda t, n: name_has_token(n, K.PARSE_DATE_NAMES) and ratio(t, "years") > 0.8,
    lambda x, t, n: to_double(F.regexp_replace(strip(x), r"\.0$", "")).cast("long"),
    lambda t, n: t["years"], lambda t: "bigint", lambda n: name_has_token(n, K.PARSE_DATE_NAMES))

PARSE_DATES = Cleaner(
    "parse_dates", "PARSE_DATE", 92,
    lambda x: {"dates": parse_date(x).isNotNull()},
    lambda t, n: name_has_token(n, K.PARSE_DATE_NAMES) and ratio(t, "dates") > 0.7,
    lambda x, t, n: parse_date(x),
    lambda t, n: t["dates"], lambda t: "timestamp", lambda n: name_has_token(n, K.PARSE_DATE_NAMES))

# The order is part of the result: text-only repairs first, then the first type that fits.
SEMANTIC = [NULL_STRINGS, WHITESPACE, TEXT_PREFIXES, RATINGS, PERCENTAGES, BOOLEANS, NEGATIVE_PARENS, EMAILS, PHONES]
RUN_ALL = [*SEMANTIC, INDIAN_NUMBERS, YEARS, DATES]
TYPE_FIXES = [REFERENCES, CURRENCY, TEXT_TO_NUMERIC]
FORMAT_FIXES = [STANDARD_DATES, STANDARD_NUMBERS]
CORRECT = [MOJIBAKE, *SEMANTIC, *TYPE_FIXES, *FORMAT_FIXES]
DATE_FIXES = [PARSE_YEARS, PARSE_DATES]
EVERY = {c.name: c for c in [MOJIBAKE, *RUN_ALL, *TYPE_FIXES, *FORMAT_FIXES, *DATE_FIXES]}


def named(name: str) -> Cleaner:
    """The cleaner of a name, with its option if the name carries one."""
    if name in EVERY:
        return EVERY[name]
    base, _, option = name.partition(":")
    return {"null_strings": null_strings, "text_prefixes": prefix_cleaner, "percentages": percentages, "years": years}[base](json.loads(option))
