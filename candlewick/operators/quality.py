"""Data-quality report of bars: gaps, impossible bars, weekend bars, spikes, score and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numeric import upper_median
from .bars import by_time


def _market_closure(before: Column, after: Column) -> Column:
    """From Friday 18:00 or later to a Monday of the same weekend."""
    return (clock.day_of_week(before) == 5) & (F.hour(before) >= 18) & (clock.day_of_week(after) == 1) & (F.datediff(after, before) <= 3)


def invalid_ohlc() -> Column:
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    odd = prices[0].isNull()
    for p in prices:
        odd = odd | p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    o, h, low, c = prices
    return F.coalesce(odd | (h < low) | (h < F.greatest(o, c)) | (low > F.least(o, c)), F.lit(True))


def gaps(bars: DataFrame, zone: str = "Etc/UTC") -> DataFrame:
    """(symbol, ts_ms, delta_ms, missing): steps beyond 1.5 expected intervals that no weekend explains.

    The expected interval is the upper median of a symbol's positive steps, joined back from a table of one row a symbol.
    """
    before = F.lag("ts_ms").over(by_time())
    steps = bars.select("symbol", "ts_ms", before.alias("before")).where("before < ts_ms").withColumn("delta_ms", F.col("ts_ms") - F.col("before"))
    expected = steps.groupBy("symbol").agg(upper_median("delta_ms").alias("expected"))
    wide = steps.join(expected, "symbol").where(F.col("delta_ms") > 1.5 * F.col("expected"))
    seen = ~_market_closure(clock.local(F.col("before"), zone), clock.local(F.col("ts_ms"), zone))
    return wide.where(seen).select("symbol", "ts_ms", "delta_ms", (F.floor(F.col("delta_ms") / F.col("expected")) - 1).alias("missing"))


def spikes(bars: DataFrame, times: float = 20) -> DataFrame:
    """(symbol, ts_ms, range) of bars wider than ``times`` the upper median of the positive ranges."""
    wide = bars.select("symbol", "ts_ms", (F.col("high") - F.col("low")).alias("range")).where("range > 0")
    usual = wide.groupBy("symbol").agg(upper_median("range").alias("usual"))
    return wide.join(usual, "symbol").where(F.col("range") > times * F.col("usual")).select("symbol", "ts_ms", "range")


def report(bars: DataFrame, zone: str = "Etc/UTC", ingest: DataFrame | None = None, unpriced: bool = True) -> DataFrame:
    """One row per symbol: counts of each check, score (100 less capped penalties, rounded) and grade (pass from 90, warn from 70).

    ``ingest`` tells of each symbol how it was read: source_rows, duplicates (rows removed) and was_sorted; without it
    nothing was removed and all was in order. Bars that lack a finite price are invalid; without ``unpriced`` only those are
    whose prices contradict each other, NaN being above all.
    """
    impossible = invalid_ohlc() if unpriced else F.expr("high < low OR high < open OR high < close OR low > open OR low > close")
    wall = clock.local(F.col("ts_ms"), zone)
    base = bars.groupBy("symbol").agg(
        F.count("*").alias("bars"),
        F.count_if(F.col("high") == F.col("low")).alias("zero_range"),
        F.count_if(impossible).alias("invalid"),
        F.count_if(clock.day_of_week(wall).isin(0, 6)).alias("weekend"),
    )
    holes = gaps(bars, zone).groupBy("symbol").agg(F.count("*").alias("gap_events"), F.sum("missing").cast("long").alias("missing"))
    wide = spikes(bars).groupBy("symbol").agg(F.count("*").alias("spikes"))
    joined = base.join(holes, "symbol", "left").join(wide, "symbol", "left").na.fill(0, ["gap_events", "missing", "spikes"])
    if ingest is None:
        joined = joined.withColumns({"source_rows": F.col("bars"), "duplicates": F.lit(0).cast("long"), "was_sorted": F.lit(True)})
    else:
        told = ingest.select("symbol", "source_rows", "duplicates", "was_sorted")
        joined = joined.join(told, "symbol", "left").withColumns({"source_rows": F.coalesce("source_rows", "bars"), "duplicates": F.coalesce("duplicates", F.lit(0).cast("long")), "was_sorted": F.coalesce("was_sorted", F.lit(True))})
    share = lambda c, of, cap: F.least(F.col(c) / F.greatest(of, F.lit(1)) * 100, F.lit(float(cap)))
    n = F.col("bars")
    lost = share("invalid", n, 50) + share("duplicates", F.col("source_rows"), 10) + share("missing", n + F.col("missing"), 25) + share("zero_range", n, 10) + share("weekend", n, 10) + share("spikes", n, 10)
    lost = lost + F.when(F.col("was_sorted"), 0.0).otherwise(2.0)
    score = F.floor(F.least(F.greatest(F.lit(100.0) - lost, F.lit(0.0)), F.lit(100.0)) + 0.5)
    return joined.withColumn("score", score.cast("long")).withColumn("grade", F.when(F.col("score") >= 90, "pass").when(F.col("score") >= 70, "warn").otherwise("fail"))
