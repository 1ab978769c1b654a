"""Hand-worked values of the rules that other engines state."""

import math

import pytest
from candlewick.operators import joins, metrics, portfolio, quality, studies
from candlewick.operators.indicators import recursive, windowed, zones
from candlewick.operators.replay import Run, Settings
from pyspark.sql import functions as F

BARS = "symbol string, ts_ms long, open double, high double, low double, close double, tick_volume long, real_volume long, spread_points int"
HOUR = 3_600_000


def series(spark, rows, start=0):
    return spark.createDataFrame([("x", start + i * HOUR, *map(float, r), 1, 0, 0) for i, r in enumerate(rows)], BARS)


def column(frame, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in frame.orderBy("ts_ms").collect()]


def test_score_of_impossible_weekend_bars(spark):
    saturday = 2 * 86_400_000  # 3 January 1970
    rows = [(10, 11, 9, 10) if i % 2 else (10, 9.5, 9, 10) for i in range(48)]
    r = quality.report(series(spark, rows, saturday)).first()
    assert (r["invalid"], r["weekend"], r["score"], r["grade"]) == (24, 48, 40, "fail")  # 100 - 50 - 10
    told = spark.createDataFrame([("x", 100, 5, False)], "symbol string, source_rows long, duplicates long, was_sorted boolean")
    weekday = 4 * 86_400_000
    r = quality.report(series(spark, [(10, 11, 9, 10)] * 48, weekday), ingest=told).first()
    assert (r["score"], r["grade"]) == (93, "pass")  # 100 - 5 - 2
    told = spark.createDataFrame([("x", 1000, 84, False)], told.schema)
    assert quality.report(series(spark, [(10, 11, 9, 10)] * 48, weekday), ingest=told).first()["grade"] == "pass"  # 89.6 is 90


def test_evidence_and_recovery(spark):
    one = spark.range(1)
    got = one.select(
        metrics.evidence_score(F.lit(-10.0), F.lit(None).cast("double"), F.lit(-1000.0), F.lit(10), F.lit(20.0), F.lit(0)).alias("missing"),
        metrics.evidence_score(F.lit(-10.0), F.lit(0.0), F.lit(-1000.0), F.lit(10), F.lit(20.0), F.lit(0)).alias("zero"),
        metrics.evidence_score(F.lit(10.0), F.lit(None).cast("double"), F.lit(1000.0), F.lit(200), F.lit(0.0), F.lit(20)).alias("won"),
        metrics.recovery_factor(F.lit(100.0), F.lit(0.0)).alias("free"),
        metrics.recovery_factor(F.lit(-100.0), F.lit(0.0)).alias("lost"),
        metrics.recovery_factor(F.lit(100.0), F.lit(50.0)).alias("usual"),
    ).first()
    low = 100 * math.log(0.9) - 10 + 0.2 - 10
    assert got["missing"] == pytest.approx(low) and got["zero"] == pytest.approx(low)
    assert got["won"] == pytest.approx(100 * math.log(1.1) + 5 * math.log(10) + 2 - 1)
    assert (got["free"], got["lost"], got["usual"]) == (math.inf, -100, 2)


def test_spread_resolution(spark):
    rows = spark.createDataFrame([(0, 9), (0, None), (5, 9), (None, 9)], "own int, seen int")
    pick = lambda fallback: [r[0] for r in rows.select(joins.resolved_spread(F.col("own"), F.col("seen"), fallback)).collect()]
    assert pick(None) == [0, 0, 5, 9] and pick(7) == [9, 7, 5, 9]
    with pytest.raises(Exception, match="no spread is recorded"):
        spark.createDataFrame([(None, None)], "own int, seen int").select(joins.resolved_spread(F.col("own"), F.col("seen"), None)).collect()


def test_parabolic_sar(spark):
    rows = [(10, 11, 9, 10), (10, 12, 9.5, 11), (11, 11.5, 9, 9.5), (9.5, 13, 9.4, 12.8), (12.8, 13.5, 12, 13)]
    got = column(recursive.with_recurrences(series(spark, rows), {"sar": recursive.parabolic_sar()}), "sar")
    # short from 12 with the extreme 9.5; a new low of 9 speeds up to 0.04; the fourth bar turns to the low since the start
    assert got[:4] == pytest.approx([11, 12, 12, 9]) and got[4] == pytest.approx(9.0)


def test_fractals_and_rank(spark):
    rows = [(1, 5, 1, 2), (1, 6, 1, 2), (1, 9, 0.5, 2), (1, 6, 1, 2), (1, 5, 1, 2), (1, 4, 1, 2), (1, 9, 1, 5)]
    b = series(spark, rows)
    assert column(b.withColumn("f", windowed.fractal("high", 5)), "f") == [0, 0, 0, 0, 0, 9, 0]
    tied = series(spark, [(1, 9, 1, 2), *rows[1:]])
    assert column(tied.withColumn("f", windowed.fractal("high", 5)), "f")[5] == 0
    strict = series(spark, [(1, 3, 1, 2), (1, 4, 1, 2), (1, 5, 1, 3)]).withColumn("reach", F.lit(0.0))
    assert column(strict.withColumn("r", windowed.sr_percent_rank(2, "reach")), "r")[2] == 50  # 3 is the edge of the first


def test_gaps_live_side_by_side(spark):
    rows = [(1, 2, 1, 2), (2, 4, 2, 4), (4, 5, 3, 5), (5, 5, 4, 4), (4, 4, 3.5, 3.5), (3, 3, 2.5, 2.5), (2, 2.2, 1.8, 2)]
    got = column(zones.fair_value_gaps(series(spark, rows)), "bull_low", "bull_high", "bear_low", "bear_high", "bull_formed", "bear_formed")
    assert got[2] == (2, 3, 0, 0, 1, 0)
    assert got[5][:4] == (2, 3, 3, 4) and got[5][5] == 1  # both
    assert got[6][:2] == (0, 0) and got[6][2:4] == (2.2, 3.5)


def test_change_of_character_counts_the_first_break(spark):
    rows = [(1, 2, 1, 1.5), (1, 3, 1, 2), (1, 5, 1, 2), (1, 3, 0.9, 2), (1, 2.5, 0.5, 2), (2, 6, 1, 5.5), (5, 6, 4, 5), (5, 5.4, 3, 4)]
    got = column(zones.change_of_character(series(spark, rows), 2), "change", "structure")
    assert got[5] == (1, 1) and got[4] == (0, 0) and all(c == 0 for c, _ in got[6:])


def test_abandons_on_marked_equity():
    base = {"run_id": "r", "spread": 0.0, "long": False, "short": False, "exit_long": False, "exit_short": False, "stop_distance": 50.0, "target_distance": None, "order_distance": None, "day": 1, "hour": 10, "swap_days": 0.0, "tradable": True}
    machine = Run("r", Settings(balance=100.0, risk=50.0, volume_step=1.0, volume_min=1.0, digits=2, warmup=0, abandon_drawdown=10.0))
    for i, close in enumerate((100, 100, 85, 120, 120)):
        b = base | {"ts_ms": i, "open": 100.0, "high": 121.0, "low": 84.0, "close": float(close), "long": i == 1}
        machine.step(b, [b])
    machine.finish()
    assert machine.stopped and [e[3] for e in machine.equity] == [100, 85] and machine.trades[0][4] == 2


def test_null_portfolio_and_sizes():
    rows = [{"id": k, "symbol": s, "cohort": "c", "objective": o, "return_percent": r, "returns": v} for k, s, o, r, v in (("a", "x", 3, 10.0, [0.1, -0.05]), ("b", "y", 2, 8.0, [-0.02, 0.1]), ("c", "x", 1, 50.0, [0.2, 0.3]))]
    best = portfolio.best_portfolio(rows, {}, 3, 1.0, 1.0, 1.0, 0.5)
    assert best["ids"] == ["a", "b", "c"] and best["max_drawdown_percent"] == 0  # every size is tried, the best kept
    assert portfolio.best_portfolio(rows, {("a", "b"): 0.9, ("a", "c"): 0.9}, 3, 0.5, 1.0, 1.0, 0.5) is None
    assert studies.condition_count(None, "and") == 0
