"""Indicators as window expressions: no state beyond a trailing frame.

Every builder takes column names and parameters and returns a Column over bars (symbol, ts_ms, open, high, low, close,
tick_volume). Undefined values are NULL. ``dialect`` is "mt5" (undefined until the window is full) or "sqx" (zero or
expanding there, as noted). One partitioning and order serves all, so Spark sorts once for a whole feature table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.numeric import divide
from ..bars import in_time
from ..series import BLOCK, framed


def W():
    """A symbol's bars in time; one without a time comes last."""
    return Window.partitionBy("symbol").orderBy(F.asc_nulls_last("ts_ms"))


MT5, SQX = "mt5", "sqx"


def frame(n: int, before: int = 0):
    """The last n rows, ending ``before`` rows ago."""
    return W().rowsBetween(-(n - 1) - before, -before)


def full(value: Column, n: int, fill: float | None = None) -> Column:
    """value once n rows are there, ``fill`` before."""
    return F.when(F.row_number().over(W()) >= n, value).otherwise(F.lit(fill).cast("double"))


def in_blocks(bars: DataFrame, reach: int, build: Callable[[DataFrame], DataFrame], size: int = BLOCK) -> DataFrame:
    """build(bars) for window columns of this module that look at most ``reach`` bars back, made by blocks of a symbol's bars."""
    return framed(in_time(bars, ["symbol"]), "symbol", reach, build, size).drop("_n")


def shift(col: Column | str, n: int) -> Column:
    return F.lag(col, n).over(W())


def sma(src: str, n: int) -> Column:
    return full(F.avg(src).over(frame(n)), n)


def wma(src: str, n: int) -> Column:
    """Weights 1 to n, newest n, over the frame's values in their order; a NULL adds nothing but keeps its place."""
    values = F.collect_list(F.struct(F.col(src).alias("v"))).over(frame(n))
    products = F.filter(F.zip_with(values, F.sequence(F.lit(1), F.lit(n)), lambda v, k: v["v"] * k), F.isnotnull)
    total = F.when(F.size(products) > 0, F.aggregate(products, F.lit(0.0), lambda a, x: a + x))
    return full(total / (n * (n + 1) / 2), n)


def stddev(src: str, n: int) -> Column:
    return full(F.stddev_pop(src).over(frame(n)), n)


def highest(src: str, n: int, dialect: str = MT5) -> Column:
    return full(F.max(src).over(frame(n)), n, 0.0 if dialect == SQX else None)


def lowest(src: str, n: int, dialect: str = MT5) -> Column:
    return full(F.min(src).over(frame(n)), n, 0.0 if dialect == SQX else None)


def donchian_high(n: int) -> Column:
    return highest("high", n)


def donchian_low(n: int) -> Column:
    return lowest("low", n)


def zscore(src: str, n: int, dialect: str = MT5) -> Column:
    """(x - mean) / population deviation; a flat window is undefined (mt5) or 0 (sqx, also while filling)."""
    dev = F.stddev_pop(src).over(frame(n))
    value = F.when(dev > 1e-12, (F.col(src) - F.avg(src).over(frame(n))) / dev)
    return full(F.coalesce(value, F.lit(0.0)), n, 0.0) if dialect == SQX else full(value, n)


def percentile_in_range(src: str, n: int) -> Column:
    low, high = F.min(src).over(frame(n)), F.max(src).over(frame(n))
    return full(divide(F.col(src) - low, high - low) * 100, n)


def rate_of_change(src: str, n: int, dialect: str = MT5) -> Column:
    value = (divide(F.col(src), shift(src, n)) - 1) * 100
    return F.coalesce(value, F.lit(0.0)) if dialect == SQX else value


def true_range() -> Column:
    before = shift("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(n: int, tr: str = "true_range") -> Column:
    """Mean true range (mt5) over the column ``tr`` that true_range() made."""
    return full(F.avg(tr).over(frame(n)), n)


def session_range(side: str, hour: int, bars: int, local: str = "local_time") -> Column:
    """Extreme of a local day's first ``bars`` bars at or after ``hour``, from the bar that completes them to the day's end."""
    day = Window.partitionBy("symbol", F.to_date(local)).orderBy("ts_ms")
    inside = F.hour(local) >= hour
    nth = F.sum(inside.cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0))
    pick = F.when(inside & (nth <= bars), F.col(side))
    extreme = (F.max if side == "high" else F.min)(pick).over(day.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(nth >= bars, extreme)


def body_range_ratio() -> Column:
    return divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low"))


def close_location() -> Column:
    return divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))


def swing(side: str, left: int, right: int, delay: int) -> Column:
    """Whether the bar ``delay`` ago is a pivot: at or beyond its left neighbours and strictly beyond its right ones."""
    pivot, out = shift(side, delay), F.row_number().over(W()) > delay + left
    for k in range(1, left + 1):
        other = shift(side, delay + k)
        out = out & ((pivot <= other) if side == "low" else (pivot >= other))
    for k in range(1, right + 1):
        other = shift(side, delay - k)
        out = out & ((pivot < other) if side == "low" else (pivot > other))
    return F.coalesce(out, F.lit(False))


def swing_base_zone(side: str, left: int, right: int, base: int) -> Column:
    """High: max high of the ``base`` bars after a swing low; low: min low after a swing high. Published at confirmation, then carried."""
    delay = max(right, base)
    span = W().rowsBetween(-(delay - 1), -(delay - base))
    extreme = F.max("high").over(span) if side == "high" else F.min("low").over(span)
    return F.last(F.when(swing("low" if side == "high" else "high", left, right, delay), extreme), ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))


def sweep_score(n: int, dialect: str = MT5) -> Column:
    """1: a low beyond the prior extreme with a close back inside; -1 for highs; else 0.

    mt5 takes the extremes of the n bars before (undefined until they are there); sqx the last confirmed n-sided swing.
    """
    if dialect == MT5:
        low, high = F.min("low").over(frame(n, 1)), F.max("high").over(frame(n, 1))
        value = F.when((F.col("low") < low) & (F.col("close") > low), 1.0).when((F.col("high") > high) & (F.col("close") < high), -1.0).otherwise(0.0)
        return full(value, n + 1)
    n = max(n, 2)
    low, high = (last_swing(side, n) for side in ("low", "high"))
    return F.when((low > 0) & (F.col("low") < low) & (F.col("close") > low), 1.0).when((high > 0) & (F.col("high") > high) & (F.col("close") < high), -1.0).otherwise(0.0)


def last_swing(side: str, n: int) -> Column:
    """Price of the last strict n-sided swing, known n bars after it."""
    pivot, strict = shift(side, n), F.row_number().over(W()) > 2 * n
    for k in [*range(n), *range(n + 1, 2 * n + 1)]:
        other = shift(side, k)
        strict = strict & ((pivot < other) if side == "low" else (pivot > other))
    return F.last(F.when(strict, pivot), ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))


def bollinger(src: str, n: int, tenths: int) -> dict[str, Column]:
    mid, dev = sma(src, n), F.stddev_pop(src).over(frame(n)) * (tenths / 10)
    return {"mid": mid, "upper": mid + dev, "lower": mid - dev, "bandwidth": divide(2 * dev, mid) * 100, "width_ratio": divide(2 * dev, mid)}


def midpoint(n: int) -> Column:
    return full((F.max("high").over(frame(n)) + F.min("low").over(frame(n))) / 2, n)


def ichimoku(tenkan: str, kijun: str, span_b: str, displace: int) -> dict[str, Column]:
    """Spans displaced by ``displace`` bars, from columns that midpoint() made."""
    return {"senkou_a": shift((F.col(tenkan) + F.col(kijun)) / 2, displace), "senkou_b": shift(span_b, displace)}


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(n: int, price: Column | None = None) -> Column:
    """Volume-weighted price; a volume of 0 counts as 1."""
    volume = F.when(F.col("tick_volume") > 0, F.col("tick_volume")).otherwise(1).cast("double")
    price = typical() if price is None else price
    return full(F.sum(price * volume).over(frame(n)) / F.sum(volume).over(frame(n)), n)


def cci(typical_col: str, n: int) -> Column:
    """(tp - mean) / (0.015 * mean absolute deviation); undefined where the deviation is zero.

    A deviation of at most 1e-9 of the mean is what rounding leaves of equal prices, and counts as zero.
    """
    mean = F.avg(typical_col).over(frame(n))
    values = F.collect_list(typical_col).over(frame(n))
    deviation = divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)), F.count(typical_col).over(frame(n)))
    return full(F.when(~(deviation <= 1e-9 * F.abs(mean)), (F.col(typical_col) - mean) / (0.015 * deviation)), n)


# -- the additional pack


def average_volume(n: int) -> Column:
    volume = F.when(F.col("real_volume") > 0, F.col("real_volume")).otherwise(F.col("tick_volume"))
    return full(F.avg(volume).over(frame(n)), n)


def relative_volume(n: int) -> Column:
    return full(divide(F.col("tick_volume").cast("double"), F.avg("tick_volume").over(frame(n))), n)


def volume_zscore(n: int) -> Column:
    """Population z-score of tick volume over up to n bars, from the second bar on."""
    dev = F.stddev_pop("tick_volume").over(frame(n))
    return full(F.when(dev > 0, (F.col("tick_volume") - F.avg("tick_volume").over(frame(n))) / dev).otherwise(0.0), 2, 0.0)


def choppiness(n: int, tr: str = "true_range") -> Column:
    spread = F.max("high").over(frame(n)) - F.min("low").over(frame(n))
    ratio = divide(F.sum(tr).over(frame(n)), spread)
    value = 100 * F.log10(F.when(ratio > 0, ratio)) / F.log10(F.lit(float(n)))
    return full(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), n)


def fractal(side: str, width: int) -> Column:
    """The strict centred extreme of the odd window of bars before this one; 0 if there is none, or not yet a window."""
    half = width // 2
    centre, best = shift(side, half + 1), F.max if side == "high" else F.min
    left, right = best(side).over(frame(half, half + 2)), best(side).over(frame(half, 1))
    strict = (centre > left) & (centre > right) if side == "high" else (centre < left) & (centre < right)
    return full(F.when(strict, centre).otherwise(0.0), width + 1, 0.0)


def gann_hilo(n: int) -> dict[str, Column]:
    """Trend from closes against the previous bar's means of highs and lows; the line is the other side's mean."""
    high, low = sma("high", n), sma("low", n)
    return {"mean_high": high, "mean_low": low}


def gann_trend(mean_high: str, mean_low: str) -> Column:
    turn = F.when(F.col("close") > shift(mean_high, 1), 1).when(F.col("close") < shift(mean_low, 1), -1)
    return F.last(turn, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))


def keltner(price: Column, n: int, k: float) -> dict[str, Column]:
    mid, reach = full(F.avg(price).over(frame(n)), n), F.avg(F.col("high") - F.col("low")).over(frame(n)) * k
    return {"mid": mid, "upper": mid + reach, "lower": mid - reach}


def linreg(src: str, at: str, n: int) -> Column:
    """Least-squares fit of ``src`` on the row number in column ``at``, taken at the newest of n bars."""
    slope, mean_y, mean_x = F.regr_slope(src, at).over(frame(n)), F.avg(src).over(frame(n)), F.avg(at).over(frame(n))
    return full(mean_y + slope * (F.col(at) - mean_x), n)


def parkinson(n: int) -> Column:
    ratio = F.log(divide(F.col("high"), F.col("low")))
    return full(F.sqrt(F.avg(ratio * ratio).over(frame(n)) / (4 * F.log(F.lit(2.0)))) * F.col("close"), n)


def premium_discount(n: int) -> dict[str, Column]:
    high, low = F.max("high").over(frame(n)), F.min("low").over(frame(n))
    return {"range_high": full(high, n), "range_low": full(low, n), "equilibrium": full((high + low) / 2, n)}


def true_range_joined() -> Column:
    """max(high, previous close) - min(low, previous close)."""
    before = shift("close", 1)
    return F.greatest("high", before) - F.least("low", before)


def sr_percent_rank(length: int, reach: str) -> Column:
    """Percent of the ``length`` bars before whose range, widened by column ``reach``, holds the close strictly inside."""
    ranges = F.collect_list(F.struct((F.col("low") - F.col(reach)).alias("lo"), (F.col("high") + F.col(reach)).alias("hi"))).over(frame(length, 1))
    inside = F.size(F.filter(ranges, lambda r: (r["lo"] < F.col("close")) & (r["hi"] > F.col("close"))))
    return full(inside * 100 / length, length + 1)


def stochastic(n: int, slow: int) -> tuple[Column, callable]:
    """Raw %K over n bars and, of the column that holds it, the mean of ``slow`` bars, within 0 to 100."""
    low, high = F.min("low").over(frame(n)), F.max("high").over(frame(n))
    raw = full(F.coalesce(divide(F.col("close") - low, high - low) * 100, F.lit(0.0)), n)
    return raw, lambda k: full(F.least(F.greatest(F.avg(k).over(frame(slow)), F.lit(0.0)), F.lit(100.0)), n + slow - 1)


def swing_levels(n: int) -> dict[str, Column]:
    """Last confirmed n-sided swing prices, for crossed()."""
    return {"swing_high": last_swing("high", n), "swing_low": last_swing("low", n)}


def crossed(level_high: str, level_low: str) -> Column:
    """Break of structure: 1 where the close crosses above the swing high, -1 below the swing low, else 0."""
    before = shift("close", 1)
    return F.when((F.col("close") > F.col(level_high)) & (before <= F.col(level_high)), 1).when((F.col("close") < F.col(level_low)) & (before >= F.col(level_low)), -1).otherwise(0)
