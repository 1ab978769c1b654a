"""Path-dependent replay of rules over bars: one state machine per run, streamed in time order.

Signals, distances, spreads and gates are columns made before (rules, indicators, joins), so the machine only does what
depends on the path. Runs are independent: Spark parts them by run, sorts them by time, and a task streams through its
rows with one open position in memory. With finer bars beside each decision bar the same machine steps through them
for everything but decisions (two-timeframe replay).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns a replay reads; prices are bids, spread is in price units, distances too (NULL: none).
INPUT = ("run_id", "ts_ms", "open", "high", "low", "close", "spread", "long", "short", "exit_long", "exit_short", "stop_distance", "target_distance", "order_distance", "day", "hour", "swap_days", "tradable")


@dataclass(frozen=True)
class Settings:
    balance: float = 10_000.0
    risk: float = 100.0
    value_per_price: float = 1.0  # money a lot makes when the price moves by 1
    commission: float = 0.0  # a lot, both ways
    slippage: float = 0.0
    swap_long: float = 0.0  # money a lot and night
    swap_short: float = 0.0
    volume_step: float = 0.01
    volume_min: float = 0.01
    volume_max: float = 100.0
    digits: int = 5
    order: str = "market"  # or stop, limit
    expiry_bars: int = 3
    break_even_r: float | None = None
    trail_start_r: float | None = None
    trail_r: float = 1.0
    partials: tuple[tuple[float, float], ...] = ()  # (R, fraction of the first volume)
    time_stop: int | None = None
    flatten_hour: int | None = None
    entry_hours: tuple[int, int] = (0, 24)
    one_a_day: bool = False
    max_spread: float | None = None
    warmup: int = 320
    margin_per_lot: float = 0.0
    abandon_drawdown: float | None = None  # percent


@dataclass
class Position:
    side: int
    entry: float
    volume: float
    stop: float
    target: float | None
    distance: float
    entry_ms: int
    bar: int
    first_volume: float = 0.0
    peak: float = 0.0
    gross: float = 0.0
    commission: float = 0.0
    swap: float = 0.0
    closed: float = 0.0
    closed_value: float = 0.0
    done: set = field(default_factory=set)


TRADES = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("trade_no", T.LongType()), T.StructField("side", T.StringType()), T.StructField("entry_ms", T.LongType()), T.StructField("exit_ms", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("entry_price", "exit_price", "volume", "initial_stop", "initial_target", "gross_profit", "commission", "swap", "net_profit")]
    + [T.StructField("bars_held", T.LongType()), T.StructField("exit_reason", T.StringType()), T.StructField("balance", T.DoubleType())]
)


class Run:
    """One run's machine. step() takes a decision bar with its finer bars (the bar itself if there are none) and gives closed trades."""

    def __init__(self, run_id: str, s: Settings, long_series: bool = True) -> None:
        self.id, self.s, self.balance = run_id, s, s.balance
        self.i, self.prev, self.day = -1, None, None
        self.pos: Position | None = None
        self.pending: tuple | None = None
        self.locked = self.stopped = False
        self.trades, self.no, self.equity = [], 0, []
        self.conflicts, self.collisions, self.peak_equity = 0, 0, s.balance
        self.warmup = s.warmup if long_series else 0

    def grid(self, price: float) -> float:
        scale = 10**self.s.digits
        return math.copysign(math.floor(abs(price) * scale + 0.5) / scale, price)

    def size(self, distance: float) -> float:
        cost = distance * self.s.value_per_price + self.s.commission + 2 * self.s.slippage * self.s.value_per_price
        volume = math.floor(self.s.risk / cost / self.s.volume_step + 1e-9) * self.s.volume_step if cost > 0 else 0.0
        volume = min(volume, self.s.volume_max)
        return volume if volume >= self.s.volume_min - 1e-12 else 0.0

    def open_at(self, side: int, price: float, b: dict, stop_distance: float, target_distance: float | None, ms: int) -> bool:
        volume = self.size(stop_distance)
        if not volume or (self.s.margin_per_lot and volume * self.s.margin_per_lot > self.balance):
            return False
        stop, target = self.grid(price - side * stop_distance), None if target_distance is None else self.grid(price + side * target_distance)
        self.pos = Position(side, self.grid(price + side * self.s.slippage), volume, stop, target, stop_distance, ms, self.i, volume)
        self.first_stop, self.first_target = stop, target
        self.locked = self.s.one_a_day
        return True

    def money(self, p: Position, price: float, volume: float) -> float:
        return p.side * (price - p.entry) * volume * self.s.value_per_price

    def take(self, price: float, volume: float) -> None:
        p = self.pos
        price = self.grid(price - p.side * self.s.slippage)
        p.gross += self.money(p, price, volume)
        p.commission += self.s.commission * volume
        p.closed, p.closed_value, p.volume = p.closed + volume, p.closed_value + price * volume, p.volume - volume

    def close(self, price: float, ms: int, reason: str) -> None:
        p = self.pos
        if p.volume > 1e-12:
            self.take(price, p.volume)
        net = p.gross - p.commission + p.swap
        self.balance += net
        self.no += 1
        self.trades.append((self.id, self.no, "long" if p.side > 0 else "short", p.entry_ms, ms, p.entry, p.closed_value / p.closed, p.first_volume, self.first_stop, self.first_target, p.gross, p.commission, p.swap, net, self.i - p.bar, reason, self.balance))
        self.pos = None

    def exit_price(self, bid: float, spread: float) -> float:
        return bid if self.pos.side > 0 else bid + spread

    def manage(self, b: dict) -> None:
        """On the completed bar before: favourable peak, break-even, trailing, partial exits at this bar's open."""
        p, q = self.pos, self.prev
        if self.i - 1 == p.bar:
            best = self.exit_price(q["close"], q["spread"])  # the entry bar counts by its close only
        else:
            best = q["high"] if p.side > 0 else q["low"] + q["spread"]
        p.peak = max(p.peak, p.side * (best - p.entry))
        r, here = p.peak / p.distance, self.exit_price(b["open"], b["spread"])
        for wanted, level in ((self.s.break_even_r, p.entry), (self.s.trail_start_r, p.entry + p.side * (p.peak - self.s.trail_r * p.distance))):
            level = self.grid(level)
            if wanted is not None and r >= wanted and p.side * (level - p.stop) > 0 and p.side * (here - level) > 0:
                p.stop = level
        for k, (at, share) in enumerate(self.s.partials):
            if r >= at and k not in p.done:
                p.done.add(k)
                volume = math.floor(p.first_volume * share / self.s.volume_step + 1e-9) * self.s.volume_step
                if volume >= self.s.volume_min - 1e-12:
                    self.take(here, min(volume, p.volume))
        if p.volume <= 1e-12:
            self.close(here, b["ts_ms"], "PartialExit")

    def gap(self, bar: dict) -> bool:
        """Opens beyond the stop fill at the open, beyond the target at the target."""
        p, here = self.pos, self.exit_price(bar["open"], bar["spread"])
        if p.side * (here - p.stop) <= 0:
            self.close(here, bar["ts_ms"], "StopLoss")
        elif p.target is not None and p.side * (here - p.target) >= 0:
            self.close(p.target, bar["ts_ms"], "TakeProfit")
        return self.pos is None

    def inside(self, bar: dict) -> bool:
        """The stop wins where a bar touches both."""
        p, low, high = self.pos, self.exit_price(bar["low"], bar["spread"]), self.exit_price(bar["high"], bar["spread"])
        stopped = low <= p.stop if p.side > 0 else high >= p.stop
        reached = p.target is not None and (high >= p.target if p.side > 0 else low <= p.target)
        self.collisions += stopped and reached
        if stopped:
            self.close(p.stop, bar["ts_ms"], "StopLoss")
        elif reached:
            self.close(p.target, bar["ts_ms"], "TakeProfit")
        return self.pos is None

    def fill(self, bar: dict) -> bool:
        """A pending order fills where the ask (long) or bid (short) touches it: a stop at the worse of open and level, a limit at the better."""
        side, level, stop_distance, target_distance, _ = self.pending
        shift = bar["spread"] if side > 0 else 0.0
        first, low, high = bar["open"] + shift, bar["low"] + shift, bar["high"] + shift
        rising = (self.s.order == "stop") == (side > 0)
        if not (high >= level if rising else low <= level):
            return False
        price = max(first, level) if rising else min(first, level)
        self.pending = None
        return self.open_at(side, price, bar, stop_distance, target_distance, bar["ts_ms"])

    def step(self, b: dict, finer: list[dict]) -> None:
        if self.stopped:
            return
        self.i += 1
        fresh = self.i == 0
        if b["day"] != self.day:
            self.day, self.locked = b["day"], False
        first, last = self.s.entry_hours
        window, ended = first <= b["hour"] < last, False
        if not fresh:
            if self.s.flatten_hour is not None and b["hour"] >= self.s.flatten_hour:
                ended, self.pending = True, None
                if self.pos:
                    self.close(self.exit_price(b["open"], b["spread"]), b["ts_ms"], "EndOfDay")
            elif not window:
                self.pending = None
            if self.pos and b["swap_days"]:
                self.pos.swap += (self.s.swap_long if self.pos.side > 0 else self.s.swap_short) * b["swap_days"] * self.pos.volume
            if self.pos:
                self.manage(b)
            was_open = self.pos is not None
            if self.pos and not self.gap(b):
                p, here = self.pos, self.exit_price(b["open"], b["spread"])
                if b["exit_long"] if p.side > 0 else b["exit_short"]:
                    self.close(here, b["ts_ms"], "Rule")
                elif self.s.time_stop is not None and self.i - p.bar >= self.s.time_stop:
                    self.close(here, b["ts_ms"], "TimeStop")
            ended = ended or (was_open and self.pos is None)
            if self.pending and self.i >= self.pending[4] + self.s.expiry_bars:
                self.pending = None
            if not (self.pos or self.pending or ended) and self.i >= self.warmup:
                self.enter(b, window)
        for k, bar in enumerate(finer):
            opened = False
            if self.pending and window and self.pos is None:
                opened = self.fill(bar)
            if self.pos and (opened or k == 0 or not self.gap(bar)):
                self.inside(bar)
        mark = self.money(self.pos, self.exit_price(b["close"], b["spread"]), self.pos.volume) + self.pos.gross - self.pos.commission + self.pos.swap if self.pos else 0.0
        self.prev = b
        if fresh:
            return
        marked = self.balance + mark
        self.equity.append((self.id, b["ts_ms"], self.balance, marked))
        self.peak_equity = max(self.peak_equity, marked)
        if self.s.abandon_drawdown is not None and self.peak_equity > 0 and (self.peak_equity - marked) / self.peak_equity * 100 > self.s.abandon_drawdown:
            self.stopped = True

    def enter(self, b: dict, window: bool) -> None:
        if b["long"] and b["short"]:
            self.conflicts += 1
            return
        side = 1 if b["long"] else -1 if b["short"] else 0
        if not side or not b["tradable"] or not window or self.locked or not b["stop_distance"]:
            return
        if self.s.max_spread is not None and b["spread"] > self.s.max_spread:
            return
        here = b["open"] + (b["spread"] if side > 0 else 0.0)
        if self.s.order == "market":
            self.open_at(side, here, b, b["stop_distance"], b["target_distance"], b["ts_ms"])
        elif b["order_distance"]:
            away = side if self.s.order == "stop" else -side
            self.pending = (side, self.grid(here + away * b["order_distance"]), b["stop_distance"], b["target_distance"], self.i)

    def finish(self) -> None:
        if self.pos and self.prev:
            self.close(self.exit_price(self.prev["close"], self.prev["spread"]), self.prev["ts_ms"], "EndOfData")


EQUITY = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("balance", T.DoubleType()), T.StructField("equity", T.DoubleType())])


def _streamed(signals: DataFrame, settings: Settings, finer: bool, schema: T.StructType, drain) -> DataFrame:
    """Every run's machine over its rows; drain(machine) gives the rows that are ready."""
    columns = [*INPUT, *(["minutes"] if finer else [])]
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ready = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if machine is None or machine.id != row["run_id"]:
                    if machine:
                        machine.finish()
                        ready += drain(machine)
                    machine = Run(row["run_id"], settings, row["_bars"] > settings.warmup)
                minutes = row.pop("minutes") if finer else [row]
                if not minutes:
                    raise ValueError(f"no finer bars for {row['run_id']} at {row['ts_ms']}")
                machine.step(row, sorted(minutes, key=lambda m: m["ts_ms"]) if finer else minutes)
            ready += drain(machine) if machine else []
            if ready:
                yield batch_of(ready)
                ready = []
        if machine:
            machine.finish()
            ready += drain(machine)
        if ready:
            yield batch_of(ready)

    # the count and the machine share one shuffle by run
    counted = signals.select(*columns, F.count(F.lit(1)).over(Window.partitionBy("run_id")).alias("_bars"))
    return counted.sortWithinPartitions("run_id", "ts_ms").mapInArrow(run, schema)


def replay(signals: DataFrame, settings: Settings, finer: bool = False) -> DataFrame:
    """Trades of every run (TRADES). ``signals`` has INPUT's columns and, if ``finer``, minutes: array of ts_ms, open, high, low, close, spread.

    A NULL signal is false. A run that has no more rows than the warm-up has none. Rows of a run with equal times are
    read in an unstated order. A decision bar without minutes (NULL or empty) is an error in the two-timeframe form.
    """

    def drain(machine: Run) -> list[tuple]:
        machine.equity.clear()
        rows, machine.trades = machine.trades, []
        return rows

    return _streamed(signals, settings, finer, TRADES, drain)


def replay_equity(signals: DataFrame, settings: Settings, finer: bool = False) -> DataFrame:
    """Balance and marked equity (EQUITY) after each bar of every run but its first; see replay()."""

    def drain(machine: Run) -> list[tuple]:
        machine.trades.clear()
        rows, machine.equity = machine.equity, []
        return rows

    return _streamed(signals, settings, finer, EQUITY, drain)
