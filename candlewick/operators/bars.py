"""Shaping of quotes and bars: resampling, gaps, splits, folds and down-sampling.

Bars have symbol, ts_ms (open time, epoch milliseconds, UTC), open, high, low, close, tick_volume, real_volume and
spread_points (NULL if unknown). Windows are partitioned by symbol throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import upper_median
from ..functions.scratch import Scratch
from .series import BLOCK, numbered, running

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
#: Named timeframes in milliseconds.
TIMEFRAMES = {"M1": MINUTE, "M5": 5 * MINUTE, "M15": 15 * MINUTE, "M30": 30 * MINUTE, "H1": HOUR, "H4": 4 * HOUR, "D1": DAY}


def by_time(symbol: str = "symbol") -> Window:
    """A symbol's bars in time; one without a time comes last."""
    return Window.partitionBy(symbol).orderBy(F.asc_nulls_last("ts_ms"))


def in_time(rows: DataFrame, keys: list[str], *tie: str) -> DataFrame:
    """rows with _n, their number from 0 within keys in time (NULLs last); as they are if they have it."""
    return rows if "_n" in rows.columns else numbered(rows, keys, [F.asc_nulls_last("ts_ms"), *tie], Scratch(rows.sparkSession, "series"))


def bucket(ts: Column, interval: int) -> Column:
    """Start of the interval that holds ts; right for times before 1970 too."""
    return ts - F.pmod(ts, F.lit(interval))


def in_turn(*columns: str) -> Column:
    """What orders quotes by columns, an unknown value after all others, as SQL's ORDER BY has it (a struct's NULLs come first)."""
    return F.struct(*[part for c in columns for part in (F.col(c).isNull(), F.col(c))])


def ticks_to_bars(ticks: DataFrame, interval: int = MINUTE, spread: Column | None = None) -> DataFrame:
    """Bars of quotes (symbol, ts_ms, price, volume, seq): open and close in the order of seq; partial aggregation before one shuffle.

    ``spread`` is the first quote's spread in points (NULL if not given).
    """
    points = F.lit(None).cast("int") if spread is None else F.min_by(spread, "seq").cast("int")
    return (
        ticks.groupBy("symbol", bucket(F.col("ts_ms"), interval).alias("bar"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("volume").cast("long").alias("tick_volume"),
            (F.first(points) if spread is None else points).alias("spread_points"),
        )
        .select("symbol", F.col("bar").alias("ts_ms"), "open", "high", "low", "close", "tick_volume", F.lit(0).cast("long").alias("real_volume"), "spread_points")
    )


def mid_price(ask: Column, bid: Column) -> Column:
    return (ask + bid) / 2


def _merged(keys: list, bars: DataFrame) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.min_by("open", "ts_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts_ms").alias("close"),
        F.sum("tick_volume").alias("tick_volume"),
        F.sum("real_volume").alias("real_volume"),
        F.min_by("spread_points", "ts_ms").alias("spread_points"),
    )


def resample(bars: DataFrame, interval: int) -> DataFrame:
    """Coarser bars on the free grid: first open, extremes, last close, summed volumes, first spread; empty intervals are left out."""
    merged = _merged(["symbol", bucket(F.col("ts_ms"), interval).alias("_bar")], bars)
    return merged.withColumnRenamed("_bar", "ts_ms")


def resample_on_grid(bars: DataFrame, grid: DataFrame, interval: int) -> DataFrame:
    """Bars on given opens (grid: symbol, ts_ms): a bar merges the rows in [open, open + interval); empty cells are dropped.

    Each row is looked up in the two buckets an open can lie in, so the range join is an equi-join with no more than
    two candidates a row for opens at least an interval apart.
    """
    opens = grid.select("symbol", F.col("ts_ms").alias("_open")).distinct().withColumn("_key", F.expr(f"_open div {interval}"))
    rows = bars.withColumn("_key", F.explode(F.array(F.expr(f"ts_ms div {interval}"), F.expr(f"ts_ms div {interval}") - 1)))
    hit = rows.join(opens, ["symbol", "_key"]).where((F.col("ts_ms") >= F.col("_open")) & (F.col("ts_ms") < F.col("_open") + interval))
    return _merged(["symbol", "_open"], hit).withColumnRenamed("_open", "ts_ms")


def deltas(bars: DataFrame) -> DataFrame:
    return bars.withColumn("delta_ms", F.col("ts_ms") - F.lag("ts_ms").over(by_time()))


def infer_interval(bars: DataFrame) -> DataFrame:
    """(symbol, interval_ms): upper median of the positive steps between bars."""
    return deltas(bars).where("delta_ms > 0").groupBy("symbol").agg(upper_median("delta_ms").cast("long").alias("interval_ms"))


def fill_spread(bars: DataFrame, size: int = BLOCK) -> DataFrame:
    """Zero or unknown spreads take the last other one, also from blocks before; leading ones stay as they are."""
    rows = in_time(bars, ["symbol"])
    filled = running(rows, ["symbol"], {"_seen": ("last", F.when(F.col("spread_points") != 0, F.col("spread_points")))}, size)
    return filled.withColumn("spread_points", F.coalesce("_seen", "spread_points")).drop("_n", "_seen")


def needs_fill(bars: DataFrame) -> DataFrame:
    """(symbol, fillable): whether a zero or unknown spread follows another one."""
    filled = fill_spread(bars.withColumn("_given", F.col("spread_points")))
    return filled.groupBy("symbol").agg(F.bool_or(~F.col("spread_points").eqNullSafe(F.col("_given"))).alias("fillable"))


def split_chronologically(bars: DataFrame, dev: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Adds segment: the first floor(n * dev) bars of a symbol, then validation, then sealed; each part has a bar at least."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    at = F.row_number().over(by_time()) - 1
    first = F.greatest(F.floor(n * dev), F.lit(1))
    second = first + F.greatest(F.floor(n * validation), F.lit(1))
    return bars.withColumn("segment", F.when(at < first, "dev").when(at < second, "validation").otherwise("sealed"))


def split_bounds(split: DataFrame) -> DataFrame:
    """Per symbol and segment: rows, first and last time, and an order-free checksum of the rows."""
    return split.groupBy("symbol", "segment").agg(F.count("*").alias("bars"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms"))


def content_hash(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(symbol, rows, content_hash): sum of row hashes modulo 2**64 as text; partial sums, independent of the order of rows."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("content_hash"))


def content_root(rows: DataFrame, keys: list[str], order: list, columns: Sequence[str], leaf: int = 1024) -> DataFrame:
    """(keys, rows, root): the root of a hash tree over each key's rows in ``order``, as hex of SHA-256.

    A changed, moved, missing or repeated row changes the root; how rows are partitioned does not. A row's text is that of its
    columns, each led by its length and ~ for a NULL; rows are numbered by ranges, ``leaf`` rows make a leaf and as many nodes the
    next node, so no task holds more; a node that is alone is its own parent. ``columns`` should be whole numbers or text:
    other engines write doubles in another way.
    """
    cell = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    placed = numbered(rows.select(*keys, *{*columns, *(o for o in order if isinstance(o, str))} - set(keys)), keys, order, Scratch(rows.sparkSession, "roots"))
    nodes = placed.select(*keys, F.col("_n").alias("_i"), F.concat_ws(",", *map(cell, columns)).alias("_t"), F.lit(1).cast("long").alias("_rows"))
    most, kind = placed.agg(F.max("_n")).first()[0], "leaf"
    while True:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"])  # ``leaf`` nodes
        joined = F.sha2(F.concat_ws("\n", F.lit(kind), listed), 256)
        made = nodes.groupBy(*keys, F.expr(f"_i div {leaf}").alias("_j")).agg(joined.alias("_h"), F.first("_t").alias("_only"), F.count("*").alias("_k"), F.sum("_rows").alias("_rows"))
        own = F.col("_h") if kind == "leaf" else F.when(F.col("_k") == 1, F.col("_only")).otherwise(F.col("_h"))
        nodes, kind = made.select(*keys, F.col("_j").alias("_i"), own.alias("_t"), "_rows"), "node"
        most = (most or 0) // leaf
        if most == 0:
            return nodes.select(*keys, F.col("_rows").alias("rows"), F.col("_t").alias("root"))


def slice_time(bars: DataFrame, start_ms: int, stop_ms: int, pad_days: int = 0) -> DataFrame:
    """Rows in [start - pad, stop)."""
    return bars.where((F.col("ts_ms") >= start_ms - pad_days * DAY) & (F.col("ts_ms") < stop_ms))


def contiguous_folds(bars: DataFrame, k: int) -> DataFrame:
    """Adds fold f for rows in [n*f div k, n*(f+1) div k)."""
    n, at = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.row_number().over(by_time()) - 1
    guess = F.floor(at * k / n).cast("int")
    after = F.when(at >= F.floor(n * (guess + 1) / k), guess + 1).otherwise(guess)
    return bars.withColumn("fold", F.when(at < F.floor(n * after / k), after - 1).otherwise(after).cast("int"))


def calendar_folds(bars: DataFrame, local_year: Column, least: int = 50) -> DataFrame:
    """(symbol, year, bars, start_ms, last_ms) of local years with at least ``least`` bars."""
    return bars.groupBy("symbol", local_year.alias("year")).agg(F.count("*").alias("bars"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("last_ms")).where(F.col("bars") >= least)


def purged_folds(bars: DataFrame, k: int, purge: int, embargo: int) -> DataFrame:
    """Rows of each fold's context: [0, start - purge) and [start, end) of the symbol's rows, and the embargoed rows after it.

    Columns of the bars and fold, role (context, test or embargo). k is small: each row is repeated once a fold in
    place, without a join.
    """
    n, at = F.count(F.lit(1)).over(Window.partitionBy("symbol")), F.row_number().over(by_time()) - 1
    placed = bars.withColumn("_n", n).withColumn("_at", at).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start, end = F.floor(F.col("_n") * F.col("fold") / k), F.floor(F.col("_n") * (F.col("fold") + 1) / k)
    role = F.when(F.col("_at") < start - purge, "context").when((F.col("_at") >= start) & (F.col("_at") < end), "test").when((F.col("_at") >= end) & (F.col("_at") < end + embargo), "embargo")
    return placed.withColumn("role", role).where("role is not null").drop("_n", "_at")


def thin(rows: DataFrame, keys: list[str], order: str, points: int) -> DataFrame:
    """Of each key's ordered rows those at i * last div (points - 1): a path of at most ``points`` points with both ends."""
    w = Window.partitionBy(*keys)
    at, last = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w) - 1
    placed = rows.withColumn("_at", at).withColumn("_last", last)
    step = F.ceil(F.col("_at") * (points - 1) / F.greatest(F.col("_last"), F.lit(1)))
    return placed.where((F.floor(step * F.col("_last") / (points - 1)) == F.col("_at")) | (F.col("_last") < points)).drop("_at", "_last")


def equity_signature(equity: DataFrame, keys: list[str], chunks: int = 64) -> DataFrame:
    """(keys, signature): mean step of equity in chunks of ceil(n / chunks) steps, at most ``chunks`` of them, settled to 1e-9."""
    w = Window.partitionBy(*keys)
    step = equity.withColumn("_d", F.col("equity") - F.lag("equity").over(w.orderBy("ts_ms"))).where("_d is not null")
    placed = step.withColumn("_at", F.row_number().over(w.orderBy("ts_ms")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    parts = placed.groupBy(*keys, F.floor(F.col("_at") / F.ceil(F.col("_n") / chunks)).alias("_chunk")).agg(F.avg("_d").alias("_mean"))
    value = F.signum("_mean") * F.floor(F.abs("_mean") * 1e9 + 0.5) / 1e9
    listed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", value.alias("v")))).alias("_s"))  # at most ``chunks`` values
    return listed.select(*keys, F.transform("_s", lambda x: x["v"]).alias("signature"))
