"""The engine's tables from the driver's: quotes, bars, trades, deals, equity and signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.scratch import Scratch
from ..operators.bars import DAY, HOUR, bucket, in_time, in_turn, resample, ticks_to_bars
from ..operators.series import numbered, running


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), clock.millis(F.col("ts")).alias("ts_ms"), F.col("value").alias("price"), F.lit(1).cast("long").alias("volume"), in_turn("ts", "event_id").alias("seq"), F.col("event_id"))


def hourly(spark: SparkSession, sf_dir: str, interval: int = HOUR) -> DataFrame:
    """Bars of the events; the spread of a bar is that of its first event, the event's number modulo 4."""
    return ticks_to_bars(ticks(spark, sf_dir), interval, F.col("event_id") % 4)


def indexed_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, idx, profit): trades numbered from 0 in each run; one without a number comes last."""
    rows = numbered(trades(spark, sf_dir).select("run_id", "trade_no", "net_profit"), ["run_id"], [F.asc_nulls_last("trade_no")], Scratch(spark, "trades"))
    return rows.select("run_id", F.col("_n").alias("idx"), F.col("net_profit").alias("profit"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the events were read: rows, rows that repeat a time of their symbol, and whether times rise with the event's number."""
    from pyspark.sql import Window

    t = ticks(spark, sf_dir)
    before = F.lag("ts_ms").over(Window.partitionBy("symbol").orderBy("event_id"))
    return t.withColumn("late", F.col("ts_ms") < before).groupBy("symbol").agg(
        F.count("*").alias("source_rows"), (F.count("*") - F.count_distinct("ts_ms")).alias("duplicates"), (F.count_if("late") == 0).alias("was_sorted")
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily history: line items by return flag, price per piece, volume by quantity."""
    li = load(spark, sf_dir, "lineitem")
    t = li.select(
        F.col("l_returnflag").alias("symbol"),
        clock.millis(F.col("l_shipdate")).alias("ts_ms"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        in_turn("l_orderkey", "l_linenumber").alias("seq"),
    )
    return ticks_to_bars(t, DAY)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades: profit against the priority's mean price, entry on the order date, exit some hours later."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate", "o_orderstatus")
    mean = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    return o.join(mean, "o_orderpriority").select(
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_orderkey").alias("trade_no"),
        F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short").alias("side"),
        clock.millis(F.col("o_orderdate")).alias("entry_ms"),
        (clock.millis(F.col("o_orderdate")) + (F.col("o_orderkey") % 48) * HOUR).alias("exit_ms"),
        (F.col("o_orderkey") % 48).alias("bars_held"),
        F.col("o_totalprice").alias("entry_price"),
        ((F.floor(F.col("o_totalprice") * 100 + 0.5) - F.floor(F.col("mean") * 100 + 0.5)) / 100).alias("net_profit"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("position_id"),
        F.col("l_linenumber").alias("deal_ticket"),
        clock.millis(F.col("l_shipdate")).alias("timestamp_ms"),
        F.when(F.col("l_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("deal_type"),
        F.when(F.col("l_linestatus") == "O", "OUT").otherwise("IN").alias("deal_entry"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("profit"),
        (-F.col("l_tax")).alias("commission"),
        F.lit(0.0).alias("swap"),
        F.lit(0.0).alias("fee"),
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a symbol and hour: ten thousand and the running sum of close minus open, by blocks of hours.

    Steps are summed as decimals of 18 places, so that a long series gathers no error of its additions; one that no such
    decimal can hold (infinite, not a number, or of 1e10 and more, where doubles have six places at most) is added as a double.
    """
    return numbered_equity(spark, sf_dir).drop("_n")


def numbered_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """equity() with _n, the point's number in its symbol; written once, since running values read it twice."""
    step = (F.col("close") - F.col("open")).try_cast("decimal(28,18)")  # a sum has 10 digits more
    rows = in_time(hourly(spark, sf_dir), ["symbol"])
    summed = running(rows, ["symbol"], {"_sum": ("sum", step), "_rest": ("sum", F.when(step.isNull(), F.col("close") - F.col("open")))})
    whole = F.coalesce(F.col("_sum").cast("double") + F.col("_rest"), F.col("_sum").cast("double"), F.col("_rest"))
    return Scratch(spark, "equity").cut(summed.select("symbol", "ts_ms", "_n", (10_000 + whole).alias("equity")))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("cohort"), F.transform("embedding", lambda x: x.cast("double")).alias("signature"))


def four_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(hourly(spark, sf_dir), 4 * HOUR)
