"""Whole-table pipelines: correction, automatic cleaning, user actions, and before/after."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.text import col
from tablewright.operators import cleaners as C
from tablewright.operators import correct, impute
from tablewright.operators import profile as P
from tablewright.operators.quality import dimension_scores, quality_score
from tablewright.operators.threats import threat_counts
from tablewright.plans.cleaning import apply_fixes, clean_numeric_years, measure_plan, run_cleaners
from tablewright.session import cut_lineage


@dataclass
class Result:
    """A cleaned table, what was done to it, and its shape before and after."""

    table: DataFrame
    audit: list[dict]
    shape: tuple[int, int]
    new_shape: tuple[int, int]
    changed: set[str] | None = None  # columns whose values may differ, where no row went; None where any may


def _numbered(audit: list[dict]) -> list[dict]:
    return [{**a, "step": i} for i, a in enumerate(audit)]


def auto_correct(df: DataFrame, corrections: DataFrame | None = None, threshold: float = 0.90, fuzzy: bool = True) -> Result:
    """Headers, encoding, semantic types, type fixes, formats, category merges, empty references."""
    out, audit = correct.clean_column_names(df)
    out, done = run_cleaners(out, C.CORRECT)
    audit += done
    out, done = correct.merge_categories(out, threshold, fuzzy)
    audit += done
    if corrections is not None:
        counted = correct.correction_counts(out, corrections).collect()
        out = correct.apply_corrections(out, corrections)
        audit += [{"action": "VALUE_CORRECTION", "column_name": r.column_name, "rows_affected": r.rows_affected, "confidence": 100,
                   "source": "user_approved"} for r in counted]
    out, done = correct.drop_empty_reference_columns(out)
    rows = df.count()
    return Result(out, _numbered(audit + done), (rows, len(df.columns)), (rows, len(out.columns)), _touched(df, out, audit + done))


def _touched(before: DataFrame, after: DataFrame, audit: list[dict]) -> set[str]:
    """Columns that the audit says were worked on, and new ones."""
    return {a["column_name"] for a in audit if a.get("column_name")} | (set(after.columns) - set(before.columns))


def auto_clean(df: DataFrame, fixes: dict[str, list[dict]] | None = None, strategies: dict[str, str] | None = None,
               clip: bool = False, order: dict | None = None, store: Callable[[DataFrame], DataFrame] = cut_lineage) -> Result:
    """Clean, correct, parse dates, remove copies, settle case, impute, clip and fill forward.

    Every decision is read from the table as it then is, not from a profile taken at the start.
    ``store`` makes the table reliable once after duplicate removal; later passes read that copy
    instead of repeating the shuffle. ``order`` gives forward fill its keys and order columns.
    """
    rows = df.count()
    later = [*C.TYPE_FIXES, C.MOJIBAKE, *C.DATE_FIXES]
    names, renamed = correct.clean_column_names(df)
    if fixes or renamed:  # what comes between changes values or the names that cleaners go by
        out, audit = run_cleaners(df, C.RUN_ALL)
        out, done = clean_numeric_years(out)
        audit += done
        if fixes:
            out, done = apply_fixes(out, fixes)
            audit += done
        out = out.toDF(*names.columns)
        audit += renamed
        out, done = run_cleaners(out, later)
        audit += done
    else:
        first = {c.name for c in C.RUN_ALL}
        plan = measure_plan(df, [*C.RUN_ALL, *later])
        out, audit = plan.apply(P.spread_out(df)) if plan.steps else df, plan.audit()
        typed = {s.column for s in plan.steps if s.rule.output(s.tally) and s.cleaner in first}
        out, done = clean_numeric_years(out, columns=[c for c in P.numeric_columns(out) if c in typed or c in P.numeric_columns(df)])
        audit += done
    out, done = correct.drop_empty_reference_columns(out)
    audit += done
    out = store(impute.remove_duplicates(out))
    left = out.count()
    if left < rows:
        audit.append({"action": "REMOVE_DUPLICATES", "column_name": None, "rows_affected": rows - left, "confidence": 99, "source": "deterministic"})
    out, done = impute.standardize_case(out)
    audit += done
    outline = P.outline(out)
    chosen = impute.choose_imputation(outline, strategies)
    out, done = impute.impute(out, {r.column_name: r.strategy for r in chosen.collect()}, outline)
    audit += done
    if clip:
        out, done = impute.winsorize(out)
        audit += done
    if order:
        out, done = impute.forward_fill_sorted(out, **order)
        audit += done
    return Result(out, _numbered(audit), (rows, len(df.columns)), (left, len(out.columns)), _touched(df, out, audit) if left == rows else None)


def transform_actions(df: DataFrame, actions: list[dict]) -> DataFrame:
    """Apply a user's approved actions in order."""
    out = df
    for action in actions:
        kind, column = action.get("type"), action.get("column")
        if kind == "remove_duplicates":
            out = impute.remove_duplicates(out)
        elif column is None or column not in out.columns:
            continue
        elif kind == "impute_median":
            out = impute.impute_with(out, "median", [column])
        elif kind == "impute_mode":
            out = impute.impute_with(out, "mode", [column])
        elif kind == "standardize_case":
            out = impute.standardize_case(out, [column])[0]
        elif kind == "drop_column":
            out = out.drop(col(column))
    return out


# --------------------------------------------------------------------------- before and after


def _facts(p: P.TableProfile, as_of: str) -> DataFrame:
    missing = sum(m["missing"] for m in p.metrics)
    rows = [
        {"section": "shape", "item": "rows", "value": p.rows}, {"section": "shape", "item": "cols", "value": p.cols},
        {"section": "missing", "item": "cells", "value": missing},
        {"section": "missing", "item": "pct", "value": round(missing * 100.0 / max(p.rows * p.cols, 1), 2)},
        {"section": "duplicates", "item": "rows", "value": p.duplicates},
    ]
    facts = P.rows_frame(p.spark, rows, "section string, item string, value double")
    score = quality_score(p, as_of).select(F.lit("quality_score").alias("section"), F.lit("overall").alias("item"), F.col("overall").alias("value"))
    dims = dimension_scores(p, as_of).select(F.lit("dimension").alias("section"), F.col("dimension").alias("item"), F.round("score", 1).alias("value"))
    threats = threat_counts(p, as_of).unpivot([], ["total", "critical"], "item", "value").select(
        F.lit("threats").alias("section"), "item", F.col("value").cast("double").alias("value"))
    columns = p.frame().select(F.lit("column_missing_pct").alias("section"), F.col("column_name").alias("item"),
                               F.round(F.col("missing") * 100.0 / F.col("rows"), 2).alias("value"))
    return facts.unionByName(score).unionByName(dims).unionByName(threats).unionByName(columns)


def compare_profiles(before: P.TableProfile, after: P.TableProfile, as_of: str) -> DataFrame:
    """(section, item, before, after, change): a missing side marks a dropped or added column."""
    a = _facts(before, as_of).withColumnRenamed("value", "before")
    b = _facts(after, as_of).withColumnRenamed("value", "after")
    joined = a.join(b, ["section", "item"], "full_outer")
    change = F.round(F.col("after") - F.col("before"), 2)
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "dropped").when(change == 0, "same").otherwise("changed")
    return joined.select("section", "item", "before", "after", change.alias("change"), status.alias("status"))


@dataclass
class Session:
    """An active table with its profile, audit trail and iteration count."""

    original: DataFrame
    as_of: str
    table: DataFrame | None = None
    profile: P.TableProfile | None = None
    audit: list[dict] = field(default_factory=list)
    iterations: int = 0

    def iterate(self, clean: Callable[[DataFrame], Result]) -> DataFrame:
        """Clean the active table, re-profile what changed of it, and report the change; the result becomes active."""
        current = self.original if self.table is None else self.table
        before = self.profile or P.measure(current)
        result = clean(current)
        table = cut_lineage(result.table)
        after = P.measure(table, known=before, changed=result.changed)
        self.table, self.profile = table, after
        self.audit += [{**a, "step": len(self.audit) + i} for i, a in enumerate(result.audit)]
        self.iterations += 1
        return compare_profiles(before, after, self.as_of)
