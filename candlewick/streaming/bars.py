"""Bars of an unbounded quote stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import in_turn


def stream_bars(ticks: DataFrame, width: str = "1 minute", late: str = "2 minutes", unique: list[str] | None = None) -> DataFrame:
    """Tumbling bars of (symbol, ts timestamp, price, volume, seq); a bar is final once the watermark passes its end.

    The same aggregates as the batch form, so state is one row a symbol and open bar. Of quotes that repeat the columns
    ``unique`` within the watermark the first counts.
    """
    rows = ticks.withWatermark("ts", late)
    rows = rows.dropDuplicatesWithinWatermark(unique) if unique else rows
    turn = in_turn("seq")
    made = rows.groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", turn).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", turn).alias("close"), F.sum("volume").alias("tick_volume")
    )
    return made.select("symbol", F.unix_millis(F.col("window.start")).alias("ts_ms"), "open", "high", "low", "close", "tick_volume")


def first_wins(rows: DataFrame, keys: list[str], late: str = "2 minutes") -> DataFrame:
    """Drops repeats within the watermark. A stream can't take the last of equals, as the batch form does: the first stays."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
