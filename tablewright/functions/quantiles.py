"""Moments, exact quantiles and counts beyond limits of many columns, in two scans of the table.

*First scan.* Each task sums up its part of every column: counts, moments, and a sorted summary of at most ``SIZE`` weighted values. A summary
keeps every value's rank to within a number that it carries along (``error``; none while the column has no more than ``SIZE`` values of its own),
so summaries merge in any order. What tasks give is a few thousand numbers per column; many tasks' are merged in groups first.

*Brackets.* For a wanted rank, the summary names two values that the value of that rank lies between, for certain. Limits such as the fences of
the quartiles lie between the limits of the brackets' ends.

*Second scan*, over columns of more values. Per bracket it is counted what lies below and above, and the values inside are counted one by one: a few in ten thousand rows per
bracket, whatever the column. They settle every rank and every count exactly. Where even these are more than ``MOST`` the values inside are stored with their
counts and searched in the same way, so the table itself is never read a third time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

SIZE = 1 << 13  # values a summary keeps
CHUNK = 1 << 17  # values of a column that a task holds and sorts at a time
MOST = 1 << 21  # values of all brackets that reach the driver
SMALL = 1 << 30  # bytes of a table whose few tasks' summaries go to the driver as they are
STATE = "key long, n long, total double, mean double, m2 double, m3 double, m4 double, low double, high double, error long, vals binary, weights binary"
COUNTS = "key long, part int, kind int, value double, n long"
INSIDE, BELOW, ABOVE = 0, 1, 2


@dataclass
class Summary:
    """One column, or a part of one. ``vals`` rise; ``weights`` add up to ``n``."""

    n: int = 0
    total: float = 0.0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    m4: float = 0.0
    low: float = math.inf
    high: float = -math.inf
    error: int = 0
    vals: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    @classmethod
    def of(cls, x: np.ndarray, weights: np.ndarray | None = None) -> "Summary":
        if not len(x):
            return cls()
        if weights is None:
            x = np.sort(x)
            weights = np.ones(len(x), dtype=np.int64)
        else:
            order = np.argsort(x, kind="stable")
            x, weights = x[order], weights[order]
        n, w = int(weights.sum()), weights.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):  # moments of the largest doubles overflow, their ranks do not
            mean = float(x @ w / n)
            away = x - mean
            square = away * away
            out = cls(n, float((x * w).sum()), mean, float(square @ w), float(square * away @ w), float(square * square @ w), float(x[0]), float(x[-1]), 0, x, weights)
        return out.settled()

    def settled(self) -> "Summary":
        """At most ``SIZE`` values: those at even steps of the rank, each standing for a step. Equal values have no spread, not even by rounding."""
        if self.n and self.low == self.high:
            self.mean, self.m2, self.m3, self.m4 = self.low, 0.0, 0.0, 0.0
        if len(self.vals) > 1:
            new = np.flatnonzero(np.append(True, self.vals[1:] != self.vals[:-1]))
            if len(new) < len(self.vals):
                self.vals, self.weights = self.vals[new], np.add.reduceat(self.weights, new)
        if len(self.vals) <= SIZE:
            return self
        step = -(-self.n // SIZE)
        upto = np.cumsum(self.weights)
        places = np.arange(0, self.n, step)
        kept = np.minimum(np.searchsorted(upto, places + step // 2, "right"), len(upto) - 1)
        weights = np.full(len(places), step, dtype=np.int64)
        weights[-1] = self.n - step * (len(places) - 1)
        self.error += step
        self.vals, self.weights = self.vals[kept], weights
        return self

    def ranks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values with about how many values lie below each, and how many do not lie above."""
        first = np.flatnonzero(np.append(True, self.vals[1:] != self.vals[:-1]))
        upto = np.append(0, np.cumsum(self.weights))
        return self.vals[first], upto[first], upto[np.append(first[1:], len(self.vals))]

    def bracket(self, rank: int) -> tuple[float, float]:
        """Two values that the value of a 0-based rank lies between, for certain."""
        own, below, upto = self.ranks()
        low, high = np.flatnonzero(below + self.error <= rank), np.flatnonzero(upto - self.error > rank)
        return (float(own[low[-1]]) if len(low) else self.low), (float(own[high[0]]) if len(high) else self.high)

    def at_most(self, low: float, high: float) -> int:
        """No more values than this lie between ``low`` and ``high``."""
        own, below, upto = self.ranks()
        a, b = np.searchsorted(own, low, "left"), np.searchsorted(own, high, "right")
        return int((upto[b - 1] if b else 0) - (below[a] if a < len(below) else self.n)) + 2 * self.error if b > a else 2 * self.error


def merged(parts: Iterable[Summary]) -> Summary:
    """One summary of what several were made of, in any order."""
    out, vals, weights = Summary(), [], []
    for p in parts:
        if not p.n:
            continue
        vals.append(p.vals)
        weights.append(p.weights)
        a, b, n = out.n, p.n, out.n + p.n
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.float64(p.mean) - out.mean
            m4 = out.m4 + p.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3 + 6 * d * d * (a * a * p.m2 + b * b * out.m2) / n**2 + 4 * d * (a * p.m3 - b * out.m3) / n
            m3 = out.m3 + p.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * p.m2 - b * out.m2) / n
            m2 = out.m2 + p.m2 + d * d * a * b / n
            mean = out.mean + d * b / n
        out = Summary(n, out.total + p.total, float(mean), float(m2), float(m3), float(m4), min(out.low, p.low), max(out.high, p.high), out.error + p.error)
    if vals:
        x, w = np.concatenate(vals), np.concatenate(weights)
        order = np.argsort(x, kind="stable")
        out.vals, out.weights = x[order], w[order]
    return out.settled()


def add_summary(levels: list[list[Summary]], part: Summary) -> None:
    """Keep ``part`` with those merged as often as it; sixteen of them become one of the next level, so what a merge adds to the error is added once per level."""
    for own in levels:
        own.append(part)
        if len(own) < 16:
            return
        part = merged(own)
        own.clear()
    levels.append([part])


def state_rows(states: dict[int, Summary]) -> pa.RecordBatch:
    columns = [pa.array(list(states), pa.int64())]
    for name in ("n", "total", "mean", "m2", "m3", "m4", "low", "high", "error"):
        columns.append(pa.array([getattr(s, name) for s in states.values()], pa.int64() if name in ("n", "error") else pa.float64()))
    columns += [pa.array([s.vals.tobytes() for s in states.values()], pa.binary()), pa.array([s.weights.tobytes() for s in states.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in STATE.split(", ")])


def read_states(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, Summary]]:
    for row in table.to_pylist():
        row.pop("group", None)
        row["vals"], row["weights"] = np.frombuffer(row["vals"]), np.frombuffer(row["weights"], dtype=np.int64)
        yield row.pop("key"), Summary(**row)


class _Chunks:
    """Values of every key, given on in arrays of about ``CHUNK`` values."""

    def __init__(self, use):
        self.use, self.held, self.size = use, {}, {}

    def add(self, key: int, x: np.ndarray, weights: np.ndarray | None) -> None:
        self.held.setdefault(key, []).append((x, weights))
        self.size[key] = self.size.get(key, 0) + len(x)
        if self.size[key] >= CHUNK:
            self.give(key)

    def give(self, key: int) -> None:
        held = self.held.pop(key, [])
        self.size[key] = 0
        if held:
            x = np.concatenate([h[0] for h in held])
            self.use(key, x, None if held[0][1] is None else np.concatenate([h[1] for h in held]))

    def finish(self) -> None:
        for key in list(self.held):
            self.give(key)


def _read(batches: Iterator[pa.RecordBatch], wide: bool, chunks: _Chunks) -> None:
    """Wide rows have one column per key; long ones are (key, value, n)."""
    for batch in batches:
        if wide:
            for i, column in enumerate(batch.columns):
                x = column.drop_null().to_numpy() if column.null_count else column.to_numpy()
                if len(x):
                    chunks.add(i, x, None)
        elif batch.num_rows:
            key, value, n = (c.to_numpy() for c in batch.columns)
            order = np.argsort(key, kind="stable")
            own, first = np.unique(key[order], return_index=True)
            for k, part in zip(own.tolist(), np.split(order, first[1:])):
                chunks.add(k, value[part], n[part])
    chunks.finish()


def _summarise(wide: bool):
    def run(batches):
        states: dict[int, list[list[Summary]]] = {}

        def use(key, x, weights):
            add_summary(states.setdefault(key, []), Summary.of(x, weights))

        _read(batches, wide, _Chunks(use))
        if states:
            yield state_rows({k: merged(p for level in levels for p in level) for k, levels in states.items()})

    return run


def _merge_group(table: pa.Table) -> pa.Table:
    parts: dict[int, list[Summary]] = {}
    for key, s in read_states(table):
        parts.setdefault(key, []).append(s)
    return pa.Table.from_batches([state_rows({k: merged(s) for k, s in parts.items()})])


def summaries(df: DataFrame, wide: bool = True) -> dict[int, Summary]:
    """Summary of every key that has a value. One scan; what tasks give is merged in groups while it is much."""
    states = df.mapInArrow(_summarise(wide), STATE)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        states = states.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("key", "group").applyInArrow(_merge_group, STATE)
        states = states.groupBy("key").applyInArrow(_merge_group, STATE)
    parts: dict[int, list[Summary]] = {}
    for key, s in read_states(states.toArrow()):
        parts.setdefault(key, []).append(s)
    return {k: merged(s) for k, s in parts.items()}


def _count(wide: bool, brackets: dict[int, list[tuple[float, float]]]):
    def run(batches):
        found: dict[tuple[int, int], list] = {}

        def rows(key, part, x, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(x), key)), pa.array(np.full(len(x), part, dtype=np.int32)), pa.array(np.full(len(x), INSIDE, dtype=np.int32)), pa.array(x), pa.array(n)],
                ["key", "part", "kind", "value", "n"])

        def use(key, x, weights):
            if key not in brackets:
                return
            if weights is None:
                x, upto = np.sort(x), np.arange(len(x) + 1)
            else:
                order = np.argsort(x, kind="stable")
                x, upto = x[order], np.append(0, np.cumsum(weights[order]))
            for part, (low, high) in enumerate(brackets[key]):
                at = found.setdefault((key, part), [0, -math.inf, 0, math.inf, []])
                a, b = np.searchsorted(x, low, "left"), np.searchsorted(x, high, "right")
                at[0] += int(upto[a])
                at[2] += int(upto[-1] - upto[b])
                if a:
                    at[1] = max(at[1], float(x[a - 1]))
                if b < len(x):
                    at[3] = min(at[3], float(x[b]))
                if a < b:
                    new = a + np.flatnonzero(np.append(True, x[a + 1 : b] != x[a : b - 1]))
                    at[4].append((x[new], np.diff(upto[np.append(new, b)])))

        chunks = _Chunks(use)
        _read(batches, wide, chunks)
        edges = []
        for (key, part), (n_below, most, n_above, least, inside) in found.items():
            edges += [(key, part, BELOW, most, n_below), (key, part, ABOVE, least, n_above)]
            if inside:
                x, place = np.unique(np.concatenate([i[0] for i in inside]), return_inverse=True)
                n = np.zeros(len(x), dtype=np.int64)
                np.add.at(n, place, np.concatenate([i[1] for i in inside]))
                yield rows(key, part, x, n)
        if edges:
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[i] for e in edges], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["key", "part", "kind", "value", "n"])

    return run


@dataclass
class Part:
    """What lies below, inside and above one bracket: counts, the nearest values outside, the values inside."""

    below: int = 0
    nearest_below: float = -math.inf
    above: int = 0
    nearest_above: float = math.inf
    vals: np.ndarray = field(default_factory=lambda: np.empty(0))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))

    def less_than(self, limit: float) -> int:
        """Values below a limit that lies in the bracket."""
        return self.below + int(self.counts[self.vals < limit].sum())

    def more_than(self, limit: float) -> int:
        return self.above + int(self.counts[self.vals > limit].sum())

    def largest_below(self, limit: float) -> float:
        return float(max(self.nearest_below, self.vals[self.vals < limit].max(initial=-math.inf)))

    def smallest_above(self, limit: float) -> float:
        return float(min(self.nearest_above, self.vals[self.vals > limit].min(initial=math.inf)))

    def at(self, rank: int) -> float:
        return float(self.vals[np.searchsorted(np.cumsum(self.counts), rank - self.below, "right")])


def _counted(df: DataFrame, brackets: dict[int, list[tuple[float, float]]], wide: bool) -> DataFrame:
    """Rows (key, part, kind, value, n) of the second scan, added up over the tasks."""
    rows = df.mapInArrow(_count(wide, brackets), COUNTS)
    exact = F.when(F.col("kind") == INSIDE, F.col("value"))
    outer = F.when(F.col("kind") == BELOW, F.max("value")).when(F.col("kind") == ABOVE, F.min("value")).otherwise(F.first("value"))
    return rows.groupBy("key", "part", "kind", exact.alias("inside")).agg(outer.alias("value"), F.sum("n").alias("n")).select("key", "part", "kind", "value", "n")


def _parts(rows: pa.Table) -> dict[tuple[int, int], Part]:
    out: dict[tuple[int, int], Part] = {}
    key, part, kind, value, n = (rows[c].to_numpy() for c in ("key", "part", "kind", "value", "n"))
    for place in np.flatnonzero(kind != INSIDE):
        p = out.setdefault((int(key[place]), int(part[place])), Part())
        if kind[place] == BELOW:
            p.below, p.nearest_below = int(n[place]), float(value[place])
        else:
            p.above, p.nearest_above = int(n[place]), float(value[place])
    inside = np.flatnonzero(kind == INSIDE)
    order = inside[np.lexsort((value[inside], part[inside], key[inside]))]
    if len(order):
        new = np.flatnonzero(np.append(True, (key[order][1:] != key[order][:-1]) | (part[order][1:] != part[order][:-1])))
        for own in np.split(order, new[1:]):
            p = out.setdefault((int(key[own[0]]), int(part[own[0]])), Part())
            p.vals, p.counts = value[own], n[own]
    return out


def _fence(quarter: tuple[tuple[float, float], tuple[float, float]], reach: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Brackets of the lower and the upper limit ``reach`` quartile distances beyond brackets of the quartiles."""
    (a, b), (c, d) = quarter
    slack = 1e-9 * max(abs(a), abs(d), 1e-300)  # rounding of the limits themselves
    lower = a - reach * (d - a) - slack, b - reach * (c - b) + slack
    upper = c + reach * (c - b) - slack, d + reach * (d - a) + slack
    return (min(lower), max(lower)), (min(upper), max(upper))


def _interpolated(values: dict[int, float], n: int, p: float) -> float:
    at = p * (n - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def column_facts(df: DataFrame, columns: list[str], probabilities: Iterable[float] = (), fences: tuple[float, ...] = (), known: dict[int, Summary] | None = None,
                 wide: bool = True) -> dict[str, dict]:
    """Per column: its ``summary``, exact ``quantiles`` {p: value}, and for each reach in ``fences`` the limits that far beyond the quartiles with
    what lies outside: (lower, upper, below, above, largest below, smallest above).

    ``df`` holds the columns as doubles, missing values as NULL, in that order. ``known`` are summaries made before.
    """
    found = summaries(df, wide) if known is None else known
    out = {c: {"summary": found.get(i, Summary()), "quantiles": {p: None for p in probabilities}, "fences": {}} for i, c in enumerate(columns)}
    wanted = list(dict.fromkeys([*probabilities, *((0.25, 0.75) if fences else ())]))
    if not wanted:
        return out
    brackets: dict[int, list[tuple[float, float]]] = {}
    ranks: dict[int, list[int]] = {}
    for i, s in found.items():
        ranks[i] = sorted({r for p in wanted for r in (math.floor(p * (s.n - 1)), math.ceil(p * (s.n - 1)))})
        brackets[i] = [s.bracket(r) for r in ranks[i]]
        if fences:
            of = dict(zip(ranks[i], brackets[i]))
            ends = [(of[math.floor(p * (s.n - 1))][0], of[math.ceil(p * (s.n - 1))][1]) for p in (0.25, 0.75)]
            for reach in fences:
                brackets[i] += _fence(tuple(ends), reach)
    if not brackets:
        return out
    parts = {(i, k): Part(vals=s.vals, counts=s.weights) for i, s in found.items() if not s.error for k in range(len(brackets[i]))}
    open_ = [i for i, s in found.items() if s.error]
    if open_:
        some = df.select(*[F.col(f"`{df.columns[i].replace('`', '``')}`") for i in open_]) if wide else df.filter(F.col("key").isin(open_))
        name = dict(enumerate(open_)) if wide else {i: i for i in open_}
        own = _settled(some, {j: brackets[i] for j, i in name.items()}, {j: found[i] for j, i in name.items()}, {j: ranks[i] for j, i in name.items()}, wide)
        parts.update({(name[j], k): p for (j, k), p in own.items()})
    for i, s in found.items():
        at = {r: parts[i, k].at(r) for k, r in enumerate(ranks[i])}
        facts = out[columns[i]]
        facts["quantiles"] = {p: _interpolated(at, s.n, p) for p in probabilities}
        if fences:
            q1, q3 = _interpolated(at, s.n, 0.25), _interpolated(at, s.n, 0.75)
            for f, reach in enumerate(fences):
                lower, upper = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
                under, over = parts[i, len(ranks[i]) + 2 * f], parts[i, len(ranks[i]) + 2 * f + 1]
                facts["fences"][reach] = (lower, upper, under.less_than(lower), over.more_than(upper), under.largest_below(lower), over.smallest_above(upper))
    return out


def _settled(df: DataFrame, brackets: dict, found: dict[int, Summary], ranks: dict[int, list[int]], wide: bool) -> dict[tuple[int, int], Part]:
    """The parts of all brackets; large ones of ranks keep only what lies around their rank."""
    counted = _counted(df, brackets, wide)
    expected = sum(min(found[i].at_most(*b), found[i].n) for i, own in brackets.items() for b in own)
    if expected <= MOST:
        return _parts(counted.toArrow())
    held = cut_lineage(counted)
    parts = _parts(held.filter(F.col("kind") != INSIDE).toArrow())
    number = {(i, k): j for j, (i, k) in enumerate((i, k) for i, own in brackets.items() for k in range(len(own)))}
    names = held.sparkSession.createDataFrame([(i, k, j) for (i, k), j in number.items()], "key long, part int, own long")
    inner = held.filter(F.col("kind") == INSIDE).join(F.broadcast(names), ["key", "part"]).select(F.col("own").alias("key"), "value", "n")
    inside = summaries(inner, wide=False)
    narrow, asked = {}, {}
    for (i, k), j in number.items():
        if j not in inside:
            continue
        p = parts.setdefault((i, k), Part())
        if k < len(ranks[i]):
            asked[j] = [ranks[i][k] - p.below]
            narrow[j] = [inside[j].bracket(asked[j][0])]
        else:  # a limit: all of its bracket counts, in steps of the summary
            narrow[j], asked[j] = [(inside[j].low, inside[j].high)], []
    if all(narrow[j][0] == (inside[j].low, inside[j].high) for j in narrow):
        return _parts(held.toArrow())  # nothing gets narrower: values of few kinds
    again = _settled(inner, narrow, inside, asked, False)
    for (i, k), j in number.items():
        if j in inside:
            p, q = parts[i, k], again[j, 0]
            p.nearest_below, p.nearest_above = max(p.nearest_below, q.nearest_below), min(p.nearest_above, q.nearest_above)
            p.below, p.above, p.vals, p.counts = p.below + q.below, p.above + q.above, q.vals, q.counts
    return parts


def exact_quantiles(df: DataFrame, columns: Iterable[str], probabilities: list[float]) -> dict[str, list]:
    """Linearly interpolated quantiles per column; ``df`` holds at least these columns, as doubles."""
    names = list(columns)
    facts = column_facts(df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in names]), names, probabilities) if names else {}
    return {c: [facts[c]["quantiles"][p] for p in probabilities] for c in names}
