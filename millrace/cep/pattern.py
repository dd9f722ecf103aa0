"""Event patterns: a small language, and its compilation to window functions.

A pattern is a list of steps, each a predicate on an event. Contiguity is strict (the next event of the key must
match) or relaxed (the next matching event counts). Matches are looked up backwards: for the last step first, every
row learns the rest of the match that would follow it, the next row's (strict) or the first one ahead (relaxed), in
reversed order, where both are what was seen last. All lookups share one partitioning and order, so a pattern of any
length costs one shuffle and two sorts, and time in proportion to the rows, also for a single key.
A negated step bounds the lookup: nothing that matches it may stand before the step after it. There is one match at
most for each start event; quantifiers complete at their minimum; optional steps are taken if they match.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.windows import micros


@dataclass(frozen=True)
class Step:
    name: str
    where: Column
    least: int = 1
    optional: bool = False
    negated: bool = False
    within: str | None = None


@dataclass(frozen=True)
class Pattern:
    name: str
    steps: tuple[Step, ...] = ()
    total: str | None = None
    relaxed: bool = False
    conditions: tuple[tuple[str, str, str, str], ...] = field(default=())

    # ---- building

    def begin(self, name: str, where: Column) -> Pattern:
        return replace(self, steps=(Step(name, where),))

    def then(self, name: str, where: Column) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, where)))

    def not_followed_by(self, name: str, where: Column) -> Pattern:
        return replace(self, steps=(*self.steps, Step(name, where, negated=True)))

    def _last(self, **kw) -> Pattern:
        return replace(self, steps=(*self.steps[:-1], replace(self.steps[-1], **kw)))

    def times(self, n: int) -> Pattern:
        return self._last(least=n)

    at_least = times

    def between(self, low: int, high: int) -> Pattern:
        """Like all open counts, complete at the least number; a range without a number from 1 up never matches."""
        never = self.steps[-1].where & F.lit(False)
        return self._last(least=max(low, 1)) if high >= max(low, 1) else self._last(where=never)

    def at_most(self, n: int) -> Pattern:
        return self.between(1, n)

    def one_or_more(self) -> Pattern:
        return self._last(least=1)

    def zero_or_more(self) -> Pattern:
        return self.optional()

    def optional(self) -> Pattern:
        return self._last(optional=True)

    def step_within(self, duration: str) -> Pattern:
        return self._last(within=duration)

    def within(self, duration: str) -> Pattern:
        return replace(self, total=duration)

    def skipping(self) -> Pattern:
        return replace(self, relaxed=True)

    def where(self, left: str, op: str, right: str, column: str) -> Pattern:
        """A condition between two steps on a column: eq, ne, gt, lt, gte, lte."""
        if op not in OPS:
            raise ValueError(f"unknown comparison {op}")
        return replace(self, conditions=(*self.conditions, (left, op, right, column)))

    def variants(self) -> list[list[Step]]:
        """The step lists that the pattern stands for, those with more optional steps first."""
        opts = [k for k, s in enumerate(self.steps) if s.optional]
        out = []
        for n in range(len(opts), -1, -1):
            for taken in itertools.combinations(opts, n):
                out.append([replace(s, least=1) for k, s in enumerate(self.steps) if k not in opts or k in taken for _ in range(s.least)])
        return out


# Comparison names.
OPS = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "lt": "__lt__", "gte": "__ge__", "lte": "__le__"}


def match(df: DataFrame, pattern: Pattern, key: str | None, ts: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, pattern, first_ts, last_ts, steps): steps has each matched event's step name, time and ``columns``.

    ``key=None`` matches over all events as one sequence, which is one task's work: for small inputs only.
    """
    base = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(base))
    # What comes next is looked up in reversed order: a frame that grows row by row, where one that shrinks is read anew for every row.
    base = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(F.col("_n").desc())
    ahead = base.rowsBetween(Window.unboundedPreceding, -1)
    found: list[Column] = []
    for v, steps in enumerate(pattern.variants()):
        out, chain = _compile(out, pattern, steps, base, ahead, ts, columns, f"_v{v}")
        found.append(chain)
    out = out.withColumn("steps", F.coalesce(*found)).where("steps IS NOT NULL")
    keys = [F.col(key)] if key else []
    return out.select(*keys, F.lit(pattern.name).alias("pattern"), F.col("steps")[0].ts.alias("first_ts"), F.element_at("steps", -1).ts.alias("last_ts"), "steps")


def _compile(df: DataFrame, p: Pattern, steps: list[Step], base, ahead, ts: str, columns: list[str], tag: str) -> tuple[DataFrame, Column]:
    rest: Column | None = None  # the column with the match of what follows, for each row
    real = [s for s in steps if not s.negated]
    if not real or steps[0].negated:
        raise ValueError("a pattern starts with a step that must occur")
    for k in range(len(steps) - 1, -1, -1):
        s = steps[k]
        if s.negated:
            continue
        me = F.array(F.struct(F.lit(s.name).alias("step"), F.col(ts).alias("ts"), F.col("_n").alias("n"), *[F.col(c) for c in columns]))
        value = me if rest is None else F.when(rest.isNotNull(), F.concat(me, rest))
        if rest is None and k < len(steps) - 1:  # negated steps at the tail: none of them in the pattern's time
            if not p.total:
                raise ValueError("a pattern that ends with a negated step needs within()")
            hits = [F.last(F.when(t.where, F.col(ts)), ignorenulls=True).over(ahead) for t in steps[k + 1 :]]
            names = [f"{tag}_tail{j}" for j in range(len(hits))]
            df = df.withColumns(dict(zip(names, hits, strict=True)))
            for nm in names:
                value = F.when(F.col(nm).isNull() | (F.col(nm) > F.col(ts) + F.expr(f"INTERVAL {p.total}")), value)
        here = f"{tag}_m{k}"
        df = df.withColumn(here, F.when(s.where, value))
        if k == 0:
            rest = F.col(here)
            break
        nots = []
        j = k - 1
        while steps[j].negated:
            nots.append(steps[j])
            j -= 1
        loose = p.relaxed or bool(nots)
        nxt = f"{tag}_c{k}"
        df = df.withColumn(nxt, F.last(here, ignorenulls=True).over(ahead) if loose else F.lag(here, 1).over(base))
        rest = F.col(nxt)
        if nots:
            names = [f"{tag}_b{k}_{i}" for i in range(len(nots))]
            df = df.withColumns({nm: F.last(F.when(t.where, F.col("_n")), ignorenulls=True).over(ahead) for nm, t in zip(names, nots, strict=True)})
            for nm in names:
                rest = F.when(F.col(nm).isNull() | (F.col(nm) > rest[0].n), rest)
        if s.within:
            rest = F.when(rest[0].ts <= F.col(ts) + F.expr(f"INTERVAL {s.within}"), rest)
    chain = rest
    if p.total:
        chain = F.when(F.element_at(chain, -1).ts <= chain[0].ts + F.expr(f"INTERVAL {p.total}"), chain)
    position = {}
    for i, s in enumerate(real):
        position.setdefault(s.name, i)
    for left, op, right, col in p.conditions:
        if left in position and right in position:
            chain = F.when(getattr(chain[position[left]][col], OPS[op])(chain[position[right]][col]), chain)
    return df, chain


def frequency(df: DataFrame, key: str, ts: str, where: Column, n: int, within: str) -> DataFrame:
    """Events at which at least n matching events of the key lie within the time up to them."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-micros(within), 0)
    hits = df.where(where)
    return hits.withColumn("n_in_window", F.count("*").over(w)).where(F.col("n_in_window") >= n)


def severity(n: Column, first: Column, last: Column) -> Column:
    """By events a minute: above 10 critical, 5 high, 2 medium, else low; no duration is critical."""
    minutes = F.timestamp_diff("MICROSECOND", first, last) / 60_000_000
    rate = F.when(minutes > 0, n / minutes)
    return F.when(rate.isNull(), "critical").when(rate > 10, "critical").when(rate > 5, "high").when(rate > 2, "medium").otherwise("low")


def describe(matches: DataFrame, user: str | None = None, ip: str | None = None) -> DataFrame:
    """Adds severity and metadata: event_count, unique_users, unique_ips."""
    out = matches.withColumn("event_count", F.size("steps").cast("bigint"))
    out = out.withColumn("severity", severity(F.col("event_count"), F.col("first_ts"), F.col("last_ts")))
    for name, col in (("unique_users", user), ("unique_ips", ip)):
        if col:
            out = out.withColumn(name, F.size(F.array_distinct(F.col("steps")[col])).cast("bigint"))
    return out


def predicate(field_: str, spec) -> Column:
    """Equality, or a comparison written as text (">100", "<5"); a missing field matches nothing."""
    c = F.col(field_)
    if isinstance(spec, str) and spec[:1] in "<>":
        v = F.lit(float(spec[1:]))
        cond = c.try_cast("double") > v if spec[0] == ">" else c.try_cast("double") < v
    else:
        cond = c == F.lit(spec)
    return F.coalesce(cond, F.lit(False))


class PatternRegistry:
    def __init__(self):
        self.patterns: dict[str, Pattern] = {}
        self.calls: dict[str, Callable[[DataFrame], None]] = {}

    def register(self, p: Pattern, call: Callable[[DataFrame], None] | None = None) -> None:
        """``call`` gets the table of the pattern's matches whenever ``deliver`` is given events."""
        if p.name in self.patterns:
            raise ValueError(f"pattern {p.name} is registered already")
        self.patterns[p.name] = p
        if call:
            self.calls[p.name] = call

    def unregister(self, name: str) -> None:
        del self.patterns[name]
        self.calls.pop(name, None)

    def deliver(self, df: DataFrame, key: str, ts: str, order: list[str], columns: list[str]) -> None:
        """Hands each pattern's matches to its call; of use in foreachBatch."""
        for name, call in self.calls.items():
            call(match(df, self.patterns[name], key, ts, order, columns))

    def run(self, df: DataFrame, key: str, ts: str, order: list[str], columns: list[str]) -> DataFrame:
        """All patterns over one table."""
        out = None
        for p in self.patterns.values():
            m = match(df, p, key, ts, order, columns)
            out = m if out is None else out.unionByName(m)
        if out is None:
            raise ValueError("no pattern is registered")
        return out

    def statistics(self, matches: DataFrame) -> DataFrame:
        return matches.groupBy("pattern").agg(F.count("*").alias("matches"))
