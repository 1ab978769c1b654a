"""Market structure and price zones as window expressions: swings, trends, gaps, blocks, supply and demand.

A zone is set by an event and lives until a breach or the next event of its kind. Events number the stretches of a
symbol, and a breach is a running maximum inside a stretch, so nothing is read row by row and all windows share one
partitioning by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windowed import W, frame, last_swing, shift


def _so_far():
    return W().rowsBetween(Window.unboundedPreceding, 0)


def with_mean_range(bars: DataFrame, n: int) -> DataFrame:
    """bars with _atr: the plain mean of the true ranges of n bars, 0 for the first n bars."""
    before = F.lag("close").over(W())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    mean = F.when(F.row_number().over(W()) > n, F.avg("_tr").over(frame(n))).otherwise(0.0)
    return bars.withColumn("_tr", true_range).withColumn("_atr", mean).drop("_tr")


def with_zone(bars: DataFrame, name: str, event: Column, breach, frozen: Column | None = None) -> DataFrame:
    """bars with <name>_low and <name>_high: 0 where no zone lives. breach(zone) tells whether a bar ends its zone.

    Where ``frozen`` holds, bars neither set nor end a zone.
    """
    held = lambda c: F.when(~frozen, c) if frozen is not None else c
    made = bars.withColumn("_event", held(event))
    made = made.withColumn("_no", F.count("_event").over(_so_far())).withColumn("_zone", F.last("_event", ignorenulls=True).over(_so_far()))
    ended = F.coalesce(held(breach(F.col("_zone"))), F.lit(False)).cast("int")
    stretch = Window.partitionBy("symbol", "_no").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("_gone", F.max(ended).over(stretch))
    edge = lambda e: F.when((F.col("_gone") == 0) & F.col("_zone").isNotNull(), F.col(f"_zone.{e}")).otherwise(0.0)
    return made.withColumn(f"{name}_low", edge("lo")).withColumn(f"{name}_high", edge("hi")).drop("_event", "_no", "_zone", "_gone")


def _span(lo: Column, hi: Column, when: Column) -> Column:
    return F.when(when, F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")))


def fair_value_gaps(bars: DataFrame, k: float = 0.05, n: int = 14) -> DataFrame:
    """Edges of the live bullish and bearish three-bar gaps of at least k mean ranges, and whether one formed on the bar.

    A gap ends when its far edge is touched; both kinds live side by side.
    """
    made = with_mean_range(bars, n).withColumn("_h2", shift("high", 2)).withColumn("_l2", shift("low", 2))
    least = F.col("_atr") * k
    up = (F.col("low") > F.col("_h2")) & (F.col("low") - F.col("_h2") >= least)
    down = (F.col("high") < F.col("_l2")) & (F.col("_l2") - F.col("high") >= least)
    made = made.withColumn("bull_formed", F.coalesce(up, F.lit(False)).cast("double")).withColumn("bear_formed", F.coalesce(down, F.lit(False)).cast("double"))
    made = with_zone(made, "bull", _span(F.col("_h2"), F.col("low"), F.col("bull_formed") > 0), lambda z: F.col("low") <= z["lo"])
    made = with_zone(made, "bear", _span(F.col("high"), F.col("_l2"), F.col("bear_formed") > 0), lambda z: F.col("high") >= z["hi"])
    return made.drop("_atr", "_h2", "_l2")


def order_blocks(bars: DataFrame, k: float = 1.5, n: int = 14, lookback: int = 20) -> DataFrame:
    """High and low of the last opposite candle, at most ``lookback`` bars back, before a body of at least k mean ranges.

    A bullish block ends on a close below its low, a bearish one on a close above its high, the setting bar included.
    """
    made = with_mean_range(bars, n)
    body, candle = F.col("close") - F.col("open"), F.struct(F.col("low").alias("lo"), F.col("high").alias("hi"))
    earlier = frame(lookback, 1)
    fallen, risen = (F.last(F.when(c, candle), ignorenulls=True).over(earlier) for c in (body < 0, body > 0))
    strong = F.abs(body) >= F.col("_atr") * k
    made = made.withColumn("_fallen", F.when(strong & (body > 0), fallen)).withColumn("_risen", F.when(strong & (body < 0), risen))
    made = with_zone(made, "bull", _span(F.col("_fallen.lo"), F.col("_fallen.hi"), F.col("_fallen").isNotNull()), lambda z: F.col("close") < z["lo"])
    made = with_zone(made, "bear", _span(F.col("_risen.lo"), F.col("_risen.hi"), F.col("_risen").isNotNull()), lambda z: F.col("close") > z["hi"])
    return made.drop("_atr", "_fallen", "_risen")


def supply_demand(bars: DataFrame, n: int = 5, atr_n: int = 14, k: float = 0.5) -> DataFrame:
    """Zones of k mean ranges below strict n-sided swing highs (supply) and above swing lows (demand), from the swing's bar on.

    A swing is known n bars later only, so the last n bars of a symbol set and end nothing. A zone ends on a close
    beyond the swing.
    """
    after, prior = W().rowsBetween(1, n), W().rowsBetween(-n, -1)
    made = with_mean_range(bars, atr_n).withColumn("_i", F.row_number().over(W())).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    inside = (F.col("_i") > n) & (F.col("_i") <= F.col("_n") - n)
    top = inside & (F.col("high") > F.max("high").over(prior)) & (F.col("high") > F.max("high").over(after))
    bottom = inside & (F.col("low") < F.min("low").over(prior)) & (F.col("low") < F.min("low").over(after))
    reach = F.col("_atr") * k
    made = made.withColumn("_top", F.coalesce(top, F.lit(False))).withColumn("_bottom", F.coalesce(bottom, F.lit(False)))
    still = ~((F.col("_i") > n) & (F.col("_i") <= F.col("_n") - n))
    made = with_zone(made, "supply", _span(F.col("high") - reach, F.col("high"), F.col("_top")), lambda z: F.col("close") > z["hi"], still)
    made = with_zone(made, "demand", _span(F.col("low"), F.col("low") + reach, F.col("_bottom")), lambda z: F.col("close") < z["lo"], still)
    return made.drop("_atr", "_i", "_n", "_top", "_bottom")


def market_structure(bars: DataFrame, strength: int = 2, lookback: int = 100) -> DataFrame:
    """Of the two last swings of each kind within ``lookback`` bars (20 at least): swing_high and swing_low (0: none), broke and trend.

    A swing is strict among the bars that there are within ``strength`` of it. broke is 1 on a close above the last
    high, -1 below the last low; trend is 1 if both kinds rose from one to the next, -1 if both fell, else 0.
    """
    s, reach = strength, max(lookback, 20)
    made = bars
    for side, best, beats in (("high", F.max, lambda a, b: a > b), ("low", F.min, lambda a, b: a < b)):
        middle = shift(side, s)
        left, right = best(side).over(W().rowsBetween(-2 * s, -s - 1)), best(side).over(W().rowsBetween(-s + 1, 0))
        swing = beats(middle, right) & F.coalesce(beats(middle, left), F.lit(True))
        made = made.withColumn(f"_{side}", F.when(swing, middle)).withColumn(f"_{side}s", F.collect_list(f"_{side}").over(W().rowsBetween(s - reach, 0)))
    last = lambda side, k: F.when(F.size(f"_{side}s") >= k, F.element_at(f"_{side}s", -k))
    high, low = F.coalesce(last("high", 1), F.lit(0.0)), F.coalesce(last("low", 1), F.lit(0.0))
    close = F.col("close")
    broke = F.when((high > 0) & (close > high), 1.0).when((low > 0) & (close < low), -1.0).otherwise(0.0)
    rose = (last("high", 1) > last("high", 2)) & (last("low", 1) > last("low", 2))
    fell = (last("high", 1) < last("high", 2)) & (last("low", 1) < last("low", 2))
    trend = F.when(rose, 1.0).when(fell, -1.0).otherwise(0.0)
    return made.select(*bars.columns, high.alias("swing_high"), low.alias("swing_low"), broke.alias("broke"), trend.alias("trend"))


def change_of_character(bars: DataFrame, n: int = 5) -> DataFrame:
    """change: 1 on the first cross above the last n-sided swing high, or one after a break down, -1 the other way round; structure: the last break.

    A bar may cross both levels; the lower one then counts last.
    """
    made = bars.withColumn("_top", last_swing("high", n)).withColumn("_bottom", last_swing("low", n)).withColumn("_before", shift("close", 1)).withColumn("_at", F.row_number().over(W()))
    late = F.col("_at") > n
    up = F.coalesce(late & (F.col("_top") > 0) & (F.col("close") > F.col("_top")) & (F.col("_before") <= F.col("_top")), F.lit(False))
    down = F.coalesce(late & (F.col("_bottom") > 0) & (F.col("close") < F.col("_bottom")) & (F.col("_before") >= F.col("_bottom")), F.lit(False))
    made = made.withColumn("_up", up).withColumn("_down", down).withColumn("_turn", F.when(F.col("_down"), -1.0).when(F.col("_up"), 1.0))
    made = made.withColumn("_old", F.coalesce(F.last("_turn", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    change = F.when(F.col("_down") & (F.col("_up") | (F.col("_old") >= 0)), -1.0).when(F.col("_up") & (F.col("_old") <= 0), 1.0).otherwise(0.0)
    return made.select(*bars.columns, change.alias("change"), F.coalesce("_turn", "_old").alias("structure"))
