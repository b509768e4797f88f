"""Fixes named by a supplied plan: each item becomes a gated cleaner of its own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import norm, strip, title_case, to_double, without
from tablewright.operators.cleaners import Cleaner, boolean_value, drop_prefix, ratio


def _changing(name: str, fix: dict, value: Callable[[Column], Column]) -> Cleaner:
    """A text-to-text fix that acts when it changes anything."""
    return Cleaner(
        name, name.upper(), int(fix.get("confidence", 0) * 100),
        lambda x: {"changes": value(x) != x},
        lambda t, n: t["changes"] > 0,
        lambda x, t, n: value(x),
        lambda t, n: t["changes"])


def insensitive(pattern: str) -> str:
    return "(?i)" + pattern


def java_replacement(text: str) -> str:
    """Group references of the plan (backslash and digit) in the notation of the JVM."""
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", r"\$"))


def _extract_number(fix: dict) -> Cleaner:
    pattern = insensitive(fix["extract_regex"])

    def extracted(x: Column) -> Column:
        found = F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))
        return F.when(to_double(found).isNotNull() & (found != x), strip(found))

    def value(x: Column) -> Column:
        return F.coalesce(extracted(x), x)

    def numeric(t: dict) -> bool:
        return ratio(t, "numeric_after") > 0.8

    return Cleaner(
        "extract_number", "EXTRACT_NUMBER", int(fix.get("confidence", 0) * 100),
        lambda x: {"changes": extracted(x).isNotNull(), "numeric_after": to_double(value(x)).isNotNull()},
        lambda t, n: t["changes"] > 0,
        lambda x, t, n: to_double(value(x)) if numeric(t) else value(x),
        lambda t, n: t["changes"],
        lambda t: "double" if numeric(t) else None)


def _to_numeric(fix: dict) -> Cleaner:
    characters = fix.get("strip_chars", ",₹$£€¥ ")

    def value(x: Column) -> Column:
        return to_double(without(x, characters))

    return Cleaner(
        "to_numeric", "TO_NUMERIC", int(fix.get("confidence", 0) * 100),
        lambda x: {"numbers": value(x).isNotNull()},
        lambda t, n: ratio(t, "numbers") >= 0.5,
        lambda x, t, n: value(x),
        lambda t, n: t["numbers"], lambda t: "double")


def _to_null(fix: dict) -> Cleaner:
    tokens = [s.lower() for s in fix.get("null_strings", [])]
    return Cleaner(
        "to_null", "TO_NULL", int(fix.get("confidence", 0) * 100),
        lambda x: {"changes": norm(x).isin(*tokens) if tokens else F.lit(False)},
        lambda t, n: t["changes"] > 0,
        lambda x, t, n: F.when(~norm(x).isin(*tokens), x),
        lambda t, n: t["changes"])


def _to_boolean(fix: dict) -> Cleaner:
    true = [v.lower() for v in fix.get("true_values", [])]
    false = [v.lower() for v in fix.get("false_values", [])]
    return Cleaner(
        "to_boolean", "TO_BOOLEAN", int(fix.get("confidence", 0) * 100),
        lambda x: {"known": norm(x).isin(*true, *false)},
        lambda t, n: ratio(t, "known") >= 0.7,
        lambda x, t, n: boolean_value(x, true, false),
        lambda t, n: t["known"], lambda t: "boolean")


def _map_values(fix: dict) -> Callable[[Column], Column]:
    pairs = {k.lower(): v for k, v in fix.get("mapping", {}).items()}
    lookup = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return lambda x: F.coalesce(lookup[norm(x)], x) if pairs else x


def _regex_replace(fix: dict) -> Callable[[Column], Column]:
    pattern, by = insensitive(fix.get("find", "")), java_replacement(fix.get("replace", ""))

    def value(x: Column) -> Column:
        out = strip(F.regexp_replace(x, pattern, by))
        return F.when(out == "", x).otherwise(out)

    return value


def _case(fix: dict) -> Callable[[Column], Column]:
    style = fix.get("case_style", "title")
    change = {"title": title_case, "lower": F.lower, "upper": F.upper}.get(style, lambda x: x)
    return lambda x: change(strip(x))


def unique_words(x: Column) -> Column:
    """Drop words that repeat the word before them, whatever their case."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    kept = F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1))))
    return F.array_join(kept, " ")


def fix_cleaner(fix: dict) -> Cleaner:
    kind = fix["fix_type"]
    if kind == "strip_prefix":
        return _changing("strip_prefix", fix, lambda x: drop_prefix(x, [p.lower() for p in fix["prefix_patterns"]]))
    if kind == "strip_suffix":
        return _changing("strip_suffix", fix, lambda x: strip(F.regexp_replace(x, fix["suffix_pattern"], "")))
    if kind == "extract_number":
        return _extract_number(fix)
    if kind == "to_numeric":
        return _to_numeric(fix)
    if kind == "to_null":
        return _to_null(fix)
    if kind == "regex_replace":
        return _changing("regex_replace", fix, _regex_replace(fix))
    if kind == "map_values":
        return _changing("map_values", fix, _map_values(fix))
    if kind == "to_boolean":
        return _to_boolean(fix)
    if kind == "normalise_case":
        return _changing("normalise_case", fix, _case(fix))
    if kind == "deduplicate_words":
        return _changing("deduplicate_words", fix, unique_words)
    raise ValueError(f"unknown fix type {kind}")
