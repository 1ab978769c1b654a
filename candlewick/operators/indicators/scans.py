"""Indicators with a linear recurrence, as affine maps: y = a*y + b with a and b given by columns.

Maps compose, so a symbol's bars are folded in blocks (see series.affine) and no task streams through a whole symbol.
What an indicator needs besides its states are the value one bar before and short trailing windows, made by blocks too.
A bar's number in its symbol, _n, tells a warming-up from a running state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import divide, finite
from ...functions.scratch import Scratch
from .. import series
from ..bars import in_time
from .windowed import W

Maps = dict[str, tuple[Column, Column]]
PRICES = ("open", "high", "low", "close")


@dataclass
class Scan:
    """Columns made first, those wanted from the bar before (name -> column), trailing windows with their reach, states stage by stage, and the value."""

    value: Column
    stages: list[Maps]
    columns: dict[str, Column] = field(default_factory=dict)
    before: dict[str, str] = field(default_factory=dict)
    windows: dict[str, Column] = field(default_factory=dict)
    reach: int = 0


def source(src: str) -> Column:
    """A field, or median, typical or weighted price."""
    o, h, low, c = (F.col(x) for x in PRICES)
    return {"median": (h + low) / 2, "typical": (h + low + c) / 3, "weighted": (h + low + 2 * c) / 4}.get(src, F.col(src).cast("double"))


def mean_maps(x: Column, n: int, first: int = 0, alpha: float | None = None) -> tuple[Column, Column]:
    """Exponential mean of values from bar ``first`` on, seeded by the plain mean of the first n of them; defined from bar first + n - 1."""
    alpha = 2 / (n + 1) if alpha is None else alpha
    c = F.col("_n") - (first - 1)
    a = F.when(c < 1, 0.0).when(c < n, 1.0).when(c == n, 1 / n).otherwise(1 - alpha)
    return a, F.when(c < 1, 0.0).when(c < n, x).when(c == n, x / n).otherwise(alpha * x)


def since(n: int, value: Column) -> Column:
    return F.when(F.col("_n") >= n, value)


def ema(src: str, n: int) -> Scan:
    return Scan(since(n - 1, F.col(f"_ema_{src}_{n}")), [{f"_ema_{src}_{n}": mean_maps(source(src), n)}])


def power(side: str, n: int) -> Scan:
    """Bulls (high) or bears (low) power: distance from the EMA of closes."""
    mean = ema("close", n)
    return Scan(F.col("high" if side == "high" else "low") - mean.value, mean.stages)


def macd(src: str, fast: int, slow: int, signal: int, part: str) -> Scan:
    """part: main, signal or histogram."""
    p, q, first = ema(src, fast), ema(src, slow), max(fast, slow) - 1
    main = p.value - q.value
    name = f"_macd_{src}_{fast}_{slow}_{signal}"
    line = since(first + signal - 1, F.col(name))
    return Scan({"main": main, "signal": line, "histogram": main - line}[part], [p.stages[0] | q.stages[0], {name: mean_maps(main, signal, first)}])


def rsi(src: str, n: int, dialect: str = "mt5") -> Scan:
    """Wilder's RSI: 50 if nothing moved, 100 without losses; before it is defined NULL (mt5) or 0 (sqx)."""
    i, x, last = F.col("_n"), f"_src_{src}", f"_before_{src}"
    gain, loss = f"_gain_{src}_{n}", f"_loss_{src}_{n}"
    decay = F.when(i < n, 1.0).when(i == n, 1 / n).otherwise((n - 1) / n)
    share = F.when(i < n, 1.0).otherwise(1 / n)
    up, down = (F.greatest(d, F.lit(0.0)) * share for d in (F.col(x) - F.col(last), F.col(last) - F.col(x)))
    g, d = F.col(gain), F.col(loss)
    value = F.when(d == 0, F.when(g == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + divide(g, d)))
    shown = F.when(i >= n, value).otherwise(F.lit(0.0 if dialect == "sqx" else None).cast("double"))
    return Scan(shown, [{gain: (decay, up), loss: (decay, down)}], {x: source(src)}, {last: x})


def _true_range() -> Column:
    """High less low, or the distance of either from the last close, if that is more."""
    last = F.col("_before_close")
    return F.coalesce(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)), F.col("high") - F.col("low"))


def atr_sqx(n: int) -> Scan:
    """Expanding mean of true range, then Wilder's smoothing."""
    w = F.least(F.col("_n") + 1, F.lit(n))
    return Scan(F.col(f"_atr_{n}"), [{f"_atr_{n}": ((w - 1) / w, _true_range() / w)}], before={"_before_close": "close"})


def directional(n: int, part: str, dialect: str = "mt5") -> Scan:
    """ADX, +DI or -DI (part: adx, plus or minus). mt5: seeds over bars 1 to n, ADX from 2n - 1; sqx: expanding sums, 50 when both are 0."""
    i, sqx = F.col("_n"), dialect == "sqx"
    up, down = F.col("high") - F.col("_before_high"), F.col("_before_low") - F.col("low")
    plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when((down > up) & (down > 0), down).otherwise(0.0)
    filling = (i < n) if sqx else (i <= n)
    decay = F.when(filling, 1.0).otherwise(1 - 1 / n)
    tr = _true_range() if sqx else F.when(i > 0, _true_range()).otherwise(0.0)
    names = [f"_dm_{k}_{n}_{dialect}" for k in ("tr", "plus", "minus", "adx")]
    sums = {name: (decay, x) for name, x in zip(names[:3], (tr, plus, minus), strict=True)}
    pdi, mdi = (F.when(F.col(names[0]) != 0, 100 * F.col(s) / F.col(names[0])).otherwise(0.0) for s in names[1:3])
    spread = F.coalesce(divide(100 * F.abs(pdi - mdi), pdi + mdi), F.lit(0.0))
    if sqx:
        still = (pdi + mdi) == 0
        adx = F.when((i == 0) | still, 0.0).otherwise((n - 1) / n), F.when(i == 0, 0.0).when(still, 50.0).otherwise(spread / n)
        value = F.when(i == 0, 0.0).otherwise({"adx": F.col(names[3]), "plus": pdi, "minus": mdi}[part])
    else:
        adx = mean_maps(spread, n, n, 1 / n)
        value = since(2 * n - 1, F.col(names[3])) if part == "adx" else since(n, pdi if part == "plus" else mdi)
    return Scan(value, [sums, {names[3]: adx}], before={"_before_close": "close", "_before_high": "high", "_before_low": "low"})


def heiken_ashi(part: str) -> Scan:
    """part: open, high, low or close."""
    close, o = F.col("_ha_close"), F.col("_ha_open")
    maps = F.when(F.col("_n") == 0, 0.0).otherwise(0.5), F.when(F.col("_n") == 0, (F.col("open") + F.col("close")) / 2).otherwise(F.col("_before_ha_close") / 2)
    value = {"open": o, "close": close, "high": F.greatest("high", o, close), "low": F.least("low", o, close)}[part]
    return Scan(value, [{"_ha_open": maps}], {"_ha_close": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4}, {"_before_ha_close": "_ha_close"})


def kama(src: str, n: int, fast: int = 2, slow: int = 30) -> Scan:
    """Kaufman's adaptive mean, from the first full window on, starting at its newest value but one."""
    x, last, far, noise, state = f"_src_{src}", f"_before_{src}", f"_far_{src}_{n}", f"_noise_{src}_{n}", f"_kama_{src}_{n}_{fast}_{slow}"
    ratio = F.coalesce(divide(F.abs(F.col(x) - F.col(far)), F.col(noise)), F.lit(0.0))
    speed = F.pow(ratio * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1), F.lit(2.0))
    i = F.col("_n")
    maps = F.when(i <= n, 0.0).otherwise(1 - speed), F.when(i < n, 0.0).when(i == n, F.col(last) + speed * (F.col(x) - F.col(last))).otherwise(speed * F.col(x))
    windows = {far: F.lag(x, n).over(W()), noise: F.sum(F.abs(F.col(x) - F.col(last))).over(W().rowsBetween(-(n - 1), 0))}
    return Scan(since(n, F.col(state)), [{state: maps}], {x: source(src)}, {last: x}, windows, n)


def stochastic_smoothed(n: int, slow: int, mode: str) -> Scan:
    """%K smoothed by an exponential (ema) or Wilder (smma) mean, within 0 to 100."""
    low, high, state = f"_lowest_{n}", f"_highest_{n}", f"_stoch_{n}_{slow}_{mode}"
    raw = F.when(F.col(high) > F.col(low), (F.col("close") - F.col(low)) / (F.col(high) - F.col(low)) * 100).otherwise(0.0)
    frame = W().rowsBetween(-(n - 1), 0)
    maps = mean_maps(raw, slow, n - 1, 1 / slow if mode == "smma" else None)
    value = F.least(F.greatest(F.col(state), F.lit(0.0)), F.lit(100.0))
    return Scan(since(n + slow - 2, value), [{state: maps}], windows={low: F.min("low").over(frame), high: F.max("high").over(frame)}, reach=n - 1)


def with_scans(bars: DataFrame, made: dict[str, Scan], size: int = series.BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """bars with a double column for each named scan; NULL where it is undefined or not finite.

    A bar with a NULL among its prices leaves all states alone and is undefined. Rows that share symbol and time are read
    in an unstated order. Scans that share a state fold it once; all states of a stage are folded in one pass.
    """
    scratch = scratch or Scratch(bars.sparkSession, "scans")
    keys, whole = ["symbol"], F.lit(True)
    for p in PRICES:
        whole = whole & F.col(p).isNotNull()
    merged: Callable[[str], dict] = lambda what: {k: v for s in made.values() for k, v in getattr(s, what).items()}
    kept = bars.where(whole).drop("_n")
    rows = in_time(kept.withColumns(merged("columns")) if merged("columns") else kept, keys)
    if merged("before"):
        rows = series.before(rows, keys, merged("before"), size)
    if merged("windows"):
        rows = series.framed(rows, "symbol", max(s.reach for s in made.values()), lambda b: b.withColumns(merged("windows")), size)
    for depth in range(max(len(s.stages) for s in made.values())):
        maps = {k: v for s in made.values() if depth < len(s.stages) for k, v in s.stages[depth].items()}
        rows = series.affine(rows, keys, maps, scratch, size)
    names = [c for c in bars.columns if c not in made]
    out = rows.select(*names, *[finite(s.value).cast("double").alias(k) for k, s in made.items()])
    return out.unionByName(bars.where(~whole).select(*names, *[F.lit(None).cast("double").alias(k) for k in made]))
