"""Indicators of whole sessions: aggregates by local day or period, joined back to the bars.

A session starts at ``start_minute`` of the local day. The aggregate has one row a symbol and session, so the join back
is small against the bars, and both sides are partitioned by symbol and session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def session_day(local: str, start_minute: int = 0) -> Column:
    """Date of the session that holds a local time."""
    return F.to_date(F.col(local) - F.expr(f"INTERVAL {start_minute} MINUTES"))


def period(local: str, kind: str) -> Column:
    """Start date of the day, week (Monday) or month."""
    return F.to_date(F.date_trunc({"day": "DAY", "week": "WEEK", "month": "MONTH"}[kind], F.col(local)))


def ohlc(bars: DataFrame, key: Column) -> DataFrame:
    return bars.groupBy("symbol", key.alias("session")).agg(
        F.min_by("open", "ts_ms").alias("s_open"), F.max("high").alias("s_high"), F.min("low").alias("s_low"), F.max_by("close", "ts_ms").alias("s_close")
    )


def with_past(bars: DataFrame, key: Column, back: int = 1) -> DataFrame:
    """bars with the s_ prices of the symbol's session ``back`` sessions ago (those that have bars count); NULL if there is none."""
    made = ohlc(bars, key)
    w = Window.partitionBy("symbol").orderBy("session")
    past = made.select("symbol", "session", *[F.lag(c, back).over(w).alias(c) for c in ("s_open", "s_high", "s_low", "s_close")])
    return bars.withColumn("session", key).join(past, ["symbol", "session"], "left")


def pivots() -> dict[str, Column]:
    """Floor pivots from with_past()'s columns."""
    high, low, close = F.col("s_high"), F.col("s_low"), F.col("s_close")
    p, spread = (high + low + close) / 3, high - low
    return {"p": p, "r1": 2 * p - low, "s1": 2 * p - high, "r2": p + spread, "s2": p - spread, "r3": p + 2 * spread, "s3": p - 2 * spread}


def retracement(level: float) -> Column:
    """Price at ``level`` of the past period's range, from its high in a falling and its low in a rising period."""
    spread = F.col("s_high") - F.col("s_low")
    return F.when(F.col("s_close") >= F.col("s_open"), F.col("s_high") - spread * level).otherwise(F.col("s_low") + spread * level)


def opening_range(local: str, start_minute: int, minutes: int) -> dict[str, Column]:
    """High, low and middle of the first ``minutes`` of a session so far, and whether it is complete."""
    day = Window.partitionBy("symbol", session_day(local, start_minute)).orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    into = F.pmod(F.hour(local) * 60 + F.minute(local) - start_minute, F.lit(1440))
    inside = into < minutes
    high, low = F.max(F.when(inside, F.col("high"))).over(day), F.min(F.when(inside, F.col("low"))).over(day)
    return {"or_high": high, "or_low": low, "or_mid": (high + low) / 2, "or_complete": into >= minutes}


def range_extreme(side: str, local: str, start_minute: int, stop_minute: int) -> Column:
    """Extreme of the last completed daily time range [start, stop), carried until the next one is complete."""
    minute = F.hour(local) * 60 + F.minute(local)
    inside = (minute >= start_minute) & (minute < stop_minute)
    day = Window.partitionBy("symbol", F.to_date(local)).orderBy("ts_ms")
    so_far = (F.max if side == "high" else F.min)(F.when(inside, F.col(side))).over(day.rowsBetween(Window.unboundedPreceding, 0))
    return F.last(F.when(minute >= stop_minute, so_far), ignorenulls=True).over(Window.partitionBy("symbol").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0))
