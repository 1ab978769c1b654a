"""Trading rules as frozen values that compile to Spark columns.

A rule reads completed bars only: every operand has a shift of at least one. An undefined operand makes its
comparison false, and so the negation of that comparison true; three-valued logic never shows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .indicators.windowed import W

#: Limits of a rule: depth, nodes, children of a junction, filters, and periods.
MAX_DEPTH, MAX_NODES, CHILDREN, MAX_FILTERS, PERIODS = 8, 64, (2, 8), 6, (2, 2000)


@dataclass(frozen=True)
class Value:
    """kind: price, indicator (both name a column), context (session_hour or day_of_week), or constant."""

    kind: str
    name: str = ""
    shift: int = 1
    value: float = 0.0

    def at(self, extra: int = 0) -> Column:
        if self.kind == "constant":
            return F.lit(float(self.value))
        if self.kind == "context":
            col = F.hour("local_time") if self.name == "session_hour" else F.dayofweek("local_time") - 1
            return F.lag(col, self.shift + extra).over(W())
        return F.lag(self.name, self.shift + extra).over(W())

    def check(self) -> None:
        if self.kind != "constant" and self.shift < 1:
            raise ValueError("a rule reads completed bars: shift must be 1 or more")
        if self.kind == "constant" and not abs(self.value) < float("inf"):
            raise ValueError("a constant must be finite")


@dataclass(frozen=True)
class Test:
    """op: gt, lt, cross_above, cross_below (left, right) or between (left, right, upper)."""

    op: str
    left: Value
    right: Value
    upper: Value | None = None

    def column(self) -> Column:
        a, b = self.left.at(), self.right.at()
        if self.op in ("gt", "lt"):
            return _sure(a > b if self.op == "gt" else a < b)
        if self.op == "between":
            return _sure((a >= b) & (a <= self.upper.at()))
        p, q = self.left.at(1), self.right.at(1)
        return _sure((a > b) & (p <= q) if self.op == "cross_above" else (a < b) & (p >= q))


@dataclass(frozen=True)
class Junction:
    """op: and, or, not over other rules."""

    op: str
    parts: tuple

    def column(self) -> Column:
        columns = [p.column() for p in self.parts]
        if self.op == "not":
            return ~columns[0]
        return reduce(lambda x, y: x & y if self.op == "and" else x | y, columns)


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def check(rule, depth: int = 1) -> int:
    """Nodes of a rule; raises ValueError beyond the limits."""
    if depth > MAX_DEPTH:
        raise ValueError(f"a rule is at most {MAX_DEPTH} deep")
    if isinstance(rule, Test):
        values = [v for v in (rule.left, rule.right, rule.upper) if v is not None]
        for v in values:
            v.check()
        nodes = 1 + len(values)
    else:
        least, most = (1, 1) if rule.op == "not" else CHILDREN
        if not least <= len(rule.parts) <= most:
            raise ValueError(f"{rule.op} takes {least} to {most} parts")
        nodes = 1 + sum(check(p, depth + 1) for p in rule.parts)
    if nodes > MAX_NODES:
        raise ValueError(f"a rule has at most {MAX_NODES} nodes")
    return nodes


def canonical(rule):
    """Constants settled to 1e-6 and the parts of and / or in a fixed order: equal rules become equal values."""
    if isinstance(rule, Test):
        settle = lambda v: v if v is None or v.kind != "constant" else Value("constant", value=round(v.value * 1e6) / 1e6 + 0.0)
        return Test(rule.op, settle(rule.left), settle(rule.right), settle(rule.upper))
    parts = [canonical(p) for p in rule.parts]
    return Junction(rule.op, tuple(parts if rule.op == "not" else sorted(parts, key=_text)))


def _text(rule) -> str:
    return json.dumps(asdict(rule), sort_keys=True)


def fingerprint(rule) -> str:
    return hashlib.sha256(_text(canonical(rule)).encode()).hexdigest()


def from_json(data: dict):
    """A rule from its JSON object: {"op", "left", "right"[, "upper"]} or {"op", "parts"}."""
    if "parts" in data:
        return Junction(data["op"], tuple(from_json(p) for p in data["parts"]))
    value = lambda v: None if v is None else Value(**v)
    return Test(data["op"], value(data["left"]), value(data["right"]), value(data.get("upper")))


def to_json(rule) -> dict:
    return json.loads(_text(rule))


def side(long: Column | None, short: Column | None, filters: tuple = ()) -> Column:
    """long, short, conflict (both) or none; filters have to hold first."""
    if len(filters) > MAX_FILTERS:
        raise ValueError(f"at most {MAX_FILTERS} filters")
    long, short = (F.lit(False) if x is None else x for x in (long, short))
    passed = reduce(lambda x, y: x & y, filters, F.lit(True))
    return F.when(~passed, "none").when(long & short, "conflict").when(long, "long").when(short, "short").otherwise("none")


def in_session(local: Column, sessions: list[tuple[int, int, int]]) -> Column:
    """Whether any window (day 0-6 from Sunday, open minute, close minute) holds the local time; no windows: always."""
    if not sessions:
        return F.lit(True)
    day, minute = F.dayofweek(local) - 1, F.hour(local) * 60 + F.minute(local)
    return reduce(lambda x, y: x | y, [(day == d) & (minute >= a) & (minute < b) for d, a, b in sessions])


def in_entry_window(local: Column, start: int = 2, stop: int = 19) -> Column:
    return (F.hour(local) >= start) & (F.hour(local) < stop)
