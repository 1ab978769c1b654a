"""Indicators with a recurrence that is not linear: state machines that read each symbol's bars in order. Linear ones are scans.

Spark shuffles bars by symbol and sorts them; a task then streams through its rows batch by batch and carries each
machine's state from one batch to the next. Memory is one batch and the state, however long a series is, and any
number of indicators share one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scans import Scan, atr_sqx, directional, ema, heiken_ashi, kama, macd, power, rsi, stochastic_smoothed, with_scans  # noqa: F401

Bar = tuple  # (open, high, low, close, tick_volume)
FIELDS = ("open", "high", "low", "close", "tick_volume")
OPEN, HIGH, LOW, CLOSE, VOLUME = range(5)


def field(src: str) -> Callable[[Bar], float]:
    """A source by name: a field, or median, typical or weighted price."""
    if src in FIELDS:
        at = FIELDS.index(src)
        return lambda b: b[at]
    return {
        "median": lambda b: (b[HIGH] + b[LOW]) / 2,
        "typical": lambda b: (b[HIGH] + b[LOW] + b[CLOSE]) / 3,
        "weighted": lambda b: (b[HIGH] + b[LOW] + 2 * b[CLOSE]) / 4,
    }[src]


class Mean:
    """Exponential mean, seeded by the plain mean of the first n defined values; undefined inputs leave the state alone."""

    def __init__(self, n: int, alpha: float | None = None) -> None:
        self.n, self.alpha = n, 2 / (n + 1) if alpha is None else alpha
        self.count, self.total, self.value = 0, 0.0, None

    def push(self, x: float | None) -> float | None:
        if x is None:
            return None
        self.count += 1
        if self.count <= self.n:
            self.total += x
            self.value = self.total / self.n if self.count == self.n else None
        else:
            self.value = self.alpha * x + (1 - self.alpha) * self.value
        return self.value


def _rsi(src: str, n: int):
    """Wilder's RSI bar by bar, for what follows it: 50 if nothing moved, 100 without losses; NULL before it is defined."""

    def make():
        of, last, gain, loss, count = field(src), None, 0.0, 0.0, 0

        def step(b):
            nonlocal last, gain, loss, count
            x, before = of(b), last
            last = x
            if before is None:
                return None
            up, down = max(x - before, 0.0), max(before - x, 0.0)
            count += 1
            if count < n:
                gain, loss = gain + up, loss + down
                return None
            if count == n:
                gain, loss = (gain + up) / n, (loss + down) / n
            else:
                gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
            if loss == 0:
                return 50.0 if gain == 0 else 100.0
            return 100 - 100 / (1 + gain / loss)

        return step

    return make


def qqe(r: int, s: int, tenths: int | None = None):
    """The smoothed RSI or, with a factor in tenths, its trailing line."""

    def make():
        base, smooth = _rsi("close", r)(), Mean(s)
        first, second = Mean(2 * r - 1), Mean(2 * r - 1)
        before, long, short, up = None, None, None, True

        def step(b):
            nonlocal before, long, short, up
            line = smooth.push(base(b))
            if tenths is None or line is None:
                return line if tenths is None else None
            last, before = before, line
            if last is None:
                return None
            dev = second.push(first.push(abs(last - line)))
            if dev is None:
                return None
            reach = dev * tenths / 10
            new_long, new_short = line - reach, line + reach
            if long is not None and last > long and line > long:
                new_long = max(new_long, long)
            if short is not None and last < short and line < short:
                new_short = min(new_short, short)
            long, short = new_long, new_short
            up = True if line > short else False if line < long else up
            return long if up else short

        return step

    return make


def parabolic_sar(first: float = 0.02, most: float = 0.2):
    """Stop and reverse: short from the first bar on, at the higher of the first two highs.

    A bar through the stop turns it to the extreme of all bars since the last turn, this one included. The newest bar
    is judged as if it were complete.
    """

    def make():
        before, up, stop, extreme, speed = None, False, None, None, first
        top, bottom = -math.inf, math.inf

        def step(b):
            nonlocal before, up, stop, extreme, speed, top, bottom
            top, bottom, last, before = max(top, b[HIGH]), min(bottom, b[LOW]), before, b
            if last is None:
                return b[HIGH]
            if stop is None:
                stop, extreme = top, b[LOW]
            if (stop > b[LOW]) if up else (stop < b[HIGH]):
                stop, extreme = (top, b[LOW]) if up else (bottom, b[HIGH])
                up, speed, top, bottom = not up, first, b[HIGH], b[LOW]
            elif (b[HIGH] > extreme) if up else (b[LOW] < extreme):
                extreme, speed = (b[HIGH] if up else b[LOW]), min(speed + first, most)
            shown = stop
            stop += speed * (extreme - stop)
            stop = min(stop, b[LOW], last[LOW]) if up else max(stop, b[HIGH], last[HIGH])
            return shown

        return step

    return make


def with_recurrences(bars: DataFrame, made: dict[str, Callable | Scan]) -> DataFrame:
    """bars with a double column for each named scan or machine; NULL where it is undefined.

    Scans are folded by blocks of a symbol's bars, machines stream through whole symbols.

    A bar with a NULL among its prices leaves all states alone and is undefined. Rows that share symbol and time are
    read in an unstated order.
    """
    scans, made = {n: m for n, m in made.items() if isinstance(m, Scan)}, {n: m for n, m in made.items() if not isinstance(m, Scan)}
    if scans:
        bars = with_scans(bars, scans)
    if not made:
        return bars
    names = list(made)
    schema = StructType([*bars.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    at = [bars.columns.index(f) for f in FIELDS]
    key = bars.columns.index("symbol")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, steps = object(), []
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in at]
            out = [[None] * len(batch) for _ in names]
            for row, (own, bar) in enumerate(zip(batch.column(key).to_pylist(), zip(*values, strict=True), strict=True)):
                if own != symbol:
                    symbol, steps = own, [make() for make in made.values()]
                if None in bar[:4]:
                    continue
                for column, step in zip(out, steps, strict=True):
                    value = step(bar)
                    column[row] = value if value is not None and math.isfinite(value) else None
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in out)], names=[*batch.schema.names, *names])

    return bars.repartition("symbol").sortWithinPartitions("symbol", F.asc_nulls_last("ts_ms")).mapInArrow(run, schema)
