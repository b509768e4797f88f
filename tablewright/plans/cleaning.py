"""Measure, decide, transform.

Gates of all columns and all cleaners are tallied together in one grouped scan of the unpivoted text columns. The
driver reads one small row per column and decides which cleaners act; columns that cleaners change and leave text take one more scan. What was decided is a
``CleaningPlan``: plain data that compiles to one ``select``, can be stored as JSON, and applies
unchanged to new batches or to a stream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.distincts import folded_values
from tablewright.functions.text import col, name_has_token
from tablewright.functions import constants as K
from tablewright.operators import cleaners as C
from tablewright.operators.fixes import fix_cleaner
from tablewright.operators.profile import held, numeric_columns, rows_frame, spread_out, text_columns

AUDIT_SCHEMA = "step int, action string, column_name string, rows_affected long, confidence int, source string, detail string"

# Cleaners that leave a column alone when they have nothing to do: they run before any gate
# is read, so their effect does not cost a scan of its own.
UNGATED = {C.NULL_STRINGS.name, C.WHITESPACE.name, C.MOJIBAKE.name}


@dataclass
class Step:
    column: str
    cleaner: str
    tally: dict
    fix: dict | None = None  # parameters of a plan-driven fix

    @property
    def rule(self) -> C.Cleaner:
        return fix_cleaner(self.fix) if self.fix else C.named(self.cleaner)


@dataclass
class CleaningPlan:
    steps: list[Step] = field(default_factory=list)

    def of(self, column: str) -> list[Step]:
        return [s for s in self.steps if s.column == column]

    def expression(self, column: str) -> Column:
        x = col(column)
        for s in self.of(column):
            x = s.rule.apply(x, s.tally, column)
        return x

    def apply(self, df: DataFrame) -> DataFrame:
        """One projection; works on a batch or a stream."""
        touched = {s.column for s in self.steps}
        return df.select(*[self.expression(c).alias(c) if c in touched else col(c) for c in df.columns])

    def audit(self) -> list[dict]:
        return [
            {"step": i, "action": s.rule.action, "column_name": s.column,
             "rows_affected": s.rule.affected(s.tally, s.column), "confidence": _confidence(s),
             "source": "plan" if s.fix else "deterministic", "detail": _detail(s)}
            for i, s in enumerate(self.steps)]

    def to_json(self) -> str:
        return json.dumps([s.__dict__ for s in self.steps])

    @classmethod
    def from_json(cls, text: str) -> "CleaningPlan":
        return cls([Step(**s) for s in json.loads(text)])


def values_lost(step: Step) -> int:
    """Values that a change of type leaves missing, because they could not be read as the new type."""
    if not step.rule.output(step.tally):
        return 0
    return max(step.tally.get("present", 0) - step.rule.affected(step.tally, step.column), 0)


def _detail(step: Step) -> str:
    lost = values_lost(step)
    changed = f"{step.rule.affected(step.tally, step.column)} of {step.tally.get('present', 0)} values changed"
    return changed + (f"; {lost} could not be read and are missing now" if lost else "")


def _confidence(step: Step) -> int:
    if step.cleaner == C.DATES.name and not name_has_token(step.column, K.DATE_NAMES):
        return 82
    return step.rule.confidence


def audit_frame(spark: SparkSession, audit: list[dict]) -> DataFrame:
    return rows_frame(spark, audit, AUDIT_SCHEMA)


@dataclass
class State:
    """A column as some cleaners leave it."""

    column: str
    value: Column
    at: int  # the cleaners before this one have had their turn


def tally(df: DataFrame, states: list[State], lead: list[C.Cleaner], cleaners: list[C.Cleaner]) -> list[dict]:
    """Counts of the conditions of ``cleaners`` over the values of every state, and of those of ``lead`` one after another, in one scan.

    Equal values of a stretch of rows are looked at once.
    """
    narrow = spread_out(df.select(*[s.value.alias(f"s{i}") for i, s in enumerate(states)]))
    names = F.array(*[F.lit(s.column) for s in states])
    long = folded_values(narrow).select(F.col("key").alias("state"), names[F.col("key")].alias("column_name"), F.col("value").alias("raw"), "n")
    flags, x = {}, F.col("raw")
    for i, cleaner in enumerate(lead):
        flags[f"{i}__present"] = x.isNotNull()
        flags.update({f"{i}__{k}": e for k, e in cleaner.counts(x).items()})
        x = cleaner.apply(x, {}, "")
    value = F.col("value")
    long, columns = long.withColumn("value", x), {s.column for s in states}
    flags["present"] = value.isNotNull()
    for c in cleaners:
        named = [n for n in columns if c.concerns(n)]
        for k, e in c.counts(value).items():
            concerned = e if len(named) == len(columns) else F.col("column_name").isin(*named) & e if named else F.lit(False)
            flags[k] = flags[k] | concerned if k in flags and len(named) < len(columns) else concerned
    marked = long.select("state", *[F.when(f, F.col("n")).alias(k) for k, f in flags.items()])
    rows = marked.groupBy("state").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags]).collect()
    found = {r["state"]: {k: r[k] for k in flags} for r in rows}
    return [found.get(i, dict.fromkeys(flags, 0)) for i in range(len(states))]


def measure_plan(df: DataFrame, cleaners: list[C.Cleaner], columns: list[str] | None = None) -> CleaningPlan:
    """Decide which cleaners act on which text columns.

    The first scan counts all conditions of all cleaners, on what the leading ungated ones leave. A column is settled by it unless a
    cleaner that fires leaves it text. What such a column looks like after each of its cleaners is foretold from the counts so far, and the next scan counts
    every foretold state at once; only where it proves a forecast wrong is there another. A plan is the one that deciding cleaner by cleaner gives.
    """
    columns = text_columns(df) if columns is None else columns
    if not columns:
        return CleaningPlan()
    with held(df.select(*[col(c) for c in columns])) as table:
        return _measure_plan(table, cleaners, columns)


def _first_hit(cleaners: list[C.Cleaner], at: int, t: dict, column: str) -> int | None:
    if not t["present"]:
        return None
    return next((i for i in range(at, len(cleaners)) if cleaners[i].fires(t, column)), None)


def _kept(cleaner: C.Cleaner, t: dict) -> dict:
    return {"present": t["present"], **{k: t[k] for k in cleaner.counts(F.lit(""))}}


def _foretold(cleaners: list[C.Cleaner], state: State, t: dict) -> list[State]:
    """``state`` and those that follow it if the counts ``t`` stay what they are."""
    out = [state]
    while (hit := _first_hit(cleaners, out[-1].at, t, state.column)) is not None and not cleaners[hit].output(_kept(cleaners[hit], t)):
        out.append(State(state.column, cleaners[hit].apply(out[-1].value, _kept(cleaners[hit], t), state.column), hit + 1))
    return out


def _measure_plan(df: DataFrame, cleaners: list[C.Cleaner], columns: list[str]) -> CleaningPlan:
    plan = CleaningPlan()
    lead = 0
    while lead < len(cleaners) and cleaners[lead].name.partition(":")[0] in UNGATED:
        lead += 1
    counts = tally(df, [State(c, col(c), 0) for c in columns], cleaners[:lead], cleaners[lead:])
    chains, known = {}, {}
    for c, t in zip(columns, counts):
        x = col(c)
        for i, cleaner in enumerate(cleaners[:lead]):
            own = {k.split("__", 1)[1]: v for k, v in t.items() if k.startswith(f"{i}__")}
            if cleaner.fires(own, c):
                plan.steps.append(Step(c, cleaner.name, own))
                x = cleaner.apply(x, own, c)
        chains[c], known[c] = [State(c, x, lead)], [t]
    while chains:
        ahead: dict[str, list[State]] = {}
        for c, chain in chains.items():
            for j, (state, t) in enumerate(zip(chain, known[c])):
                hit = _first_hit(cleaners, state.at, t, c)
                if hit is None:
                    break
                cleaner, kept = cleaners[hit], _kept(cleaners[hit], t)
                plan.steps.append(Step(c, cleaner.name, kept))
                if cleaner.output(kept) or hit + 1 >= len(cleaners):
                    break
                if j + 1 == len(chain) or chain[j + 1].at != hit + 1:  # not foretold
                    ahead[c] = _foretold(cleaners, State(c, cleaner.apply(state.value, kept, c), hit + 1), t)
                    break
        states = [s for chain in ahead.values() for s in chain]
        if not states:
            break
        counts = iter(tally(df, states, [], cleaners[min(s.at for s in states):]))
        chains, known = ahead, {c: [next(counts) for _ in chain] for c, chain in ahead.items()}
    order = {c: i for i, c in enumerate(df.columns)}
    plan.steps.sort(key=lambda s: order[s.column])
    return plan


def measure_fixes(df: DataFrame, fixes: dict[str, list[dict]], min_confidence: float = 0.75) -> CleaningPlan:
    """Decide which of a supplied plan's fixes act, column by column in the given order.

    Each round reads the gates of the next fix of every column in one aggregate.
    """
    text = set(text_columns(df))
    queue = {c: [f for f in items if f.get("confidence", 0) >= min_confidence] for c, items in fixes.items() if c in text}
    expressions = {c: col(c) for c in queue}
    plan = CleaningPlan()
    while any(queue.values()):
        turn = {c: (items.pop(0)) for c, items in queue.items() if items}
        rules = {c: fix_cleaner(f) for c, f in turn.items()}
        narrow = df.select(*[expressions[c].alias(f"x{i}") for i, c in enumerate(turn)])
        aggregates = []
        for i, c in enumerate(turn):
            aggregates.append(F.count(f"x{i}").alias(f"{i}__present"))
            aggregates += [F.count_if(e).alias(f"{i}__{k}") for k, e in rules[c].counts(F.col(f"x{i}")).items()]
        row = narrow.agg(*aggregates).first().asDict()
        for i, c in enumerate(turn):
            t = {k.split("__", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}__")}
            if not t["present"] or not rules[c].fires(t, c):
                continue
            plan.steps.append(Step(c, rules[c].name, t, turn[c]))
            if rules[c].output(t):
                queue[c] = []
            else:
                expressions[c] = rules[c].apply(expressions[c], t, c)
    order = {c: i for i, c in enumerate(df.columns)}
    plan.steps.sort(key=lambda s: order[s.column])
    return plan


def apply_fixes(df: DataFrame, fixes: dict[str, list[dict]], min_confidence: float = 0.75) -> tuple[DataFrame, list[dict]]:
    plan = measure_fixes(df, fixes, min_confidence)
    return plan.apply(df), plan.audit()


def run_cleaners(df: DataFrame, cleaners: list[C.Cleaner] = C.RUN_ALL, columns: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """Cleaned table and audit rows. The table is lazy: one projection over the input."""
    plan = measure_plan(df, cleaners, columns)
    return plan.apply(spread_out(df)) if plan.steps else df, plan.audit()


def clean_numeric_years(df: DataFrame, cutoff: int = 30, columns: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """Year clean-up of numeric columns, only where the name says they hold years."""
    named = [c for c in (numeric_columns(df) if columns is None else columns) if name_has_token(c, K.YEAR_NAMES)]
    if not named:
        return df, []
    fixed = {c: C.year_value(col(c).cast("long").cast("string"), True, cutoff) for c in named}
    counts = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(named)],
                    *[F.count(fixed[c]).alias(f"y{i}") for i, c in enumerate(named)],
                    *[F.count_if(col(c).between(0, 99) | col(c).between(1000, 9999)).alias(f"k{i}") for i, c in enumerate(named)]).first()
    audit, out = [], df
    for i, c in enumerate(named):
        if counts[f"n{i}"] and counts[f"k{i}"] / counts[f"n{i}"] >= 0.5 and counts[f"y{i}"]:
            out = out.withColumn(c, fixed[c])
            audit.append({"step": len(audit), "action": "CLEAN_YEARS", "column_name": c, "rows_affected": counts[f"y{i}"],
                          "confidence": 95, "source": "deterministic"})
    return out, audit
