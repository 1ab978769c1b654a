"""Known outcomes of the replay machine."""

from candlewick.operators.replay import INPUT, Run, Settings, replay
from pyspark.sql import types as T


def bars(prices, **more):
    base = {"run_id": "r", "spread": 0.0, "long": False, "short": False, "exit_long": False, "exit_short": False, "stop_distance": 2.0, "target_distance": 4.0, "order_distance": None, "day": 1, "hour": 10, "swap_days": 0.0, "tradable": True}
    out = [base | {"ts_ms": i * 60_000, "open": o, "high": h, "low": low, "close": c} for i, (o, h, low, c) in enumerate(prices)]
    for key, at in more.items():
        for i, v in at.items():
            out[i][key] = v
    return out


def run(rows, **settings):
    machine = Run("r", Settings(**({"balance": 100.0, "risk": 10.0, "volume_step": 1.0, "volume_min": 1.0, "digits": 2, "warmup": 0} | settings)))
    for b in rows:
        machine.step(b, [b])
    machine.finish()
    return machine


FLAT = (100.0, 100.5, 99.5, 100.0)


def test_target():
    m = run(bars([FLAT, FLAT, (100, 105, 100, 104)], long={1: True}))
    t = m.trades[0]
    assert (t[5], t[7], t[15], m.balance) == (100, 5, "TakeProfit", 120)


def test_stop_wins_a_tie():
    m = run(bars([FLAT, (100, 105, 97, 104)], long={1: True}))
    assert m.trades[0][15] == "StopLoss" and m.balance == 90 and m.collisions == 1


def test_commission_counts_in_size():
    m = run(bars([FLAT, FLAT, (100, 105, 100, 104)], long={1: True}), commission=2.0)
    assert (m.trades[0][7], m.trades[0][11], m.balance) == (2, 4, 104)


def test_short_pays_the_spread_at_exit():
    m = run(bars([FLAT, FLAT, (100, 100, 95, 95)], short={1: True}, spread={0: 1.0, 1: 1.0, 2: 1.0}))
    assert (m.trades[0][5], m.trades[0][6], m.balance) == (100, 96, 120)


def test_gap_through_target_fills_at_target_and_through_stop_at_open():
    assert run(bars([FLAT, FLAT, (110, 111, 109, 110)], long={1: True})).balance == 120
    assert run(bars([FLAT, FLAT, (90, 91, 89, 90)], long={1: True})).balance == 50


def test_conflict_rule_exit_time_stop_and_end():
    assert run(bars([FLAT, FLAT], long={1: True}, short={1: True})).conflicts == 1
    assert run(bars([FLAT] * 4, long={1: True}, exit_long={3: True})).trades[0][15] == "Rule"
    assert run(bars([FLAT] * 5, long={1: True}), time_stop=2).trades[0][14] == 2
    assert run(bars([FLAT] * 3, long={1: True})).trades[0][15] == "EndOfData"


def test_day_rules():
    assert run(bars([FLAT] * 4, long={1: True}, hour={3: 21}), flatten_hour=20).trades[0][15] == "EndOfDay"
    assert len(run(bars([FLAT] * 7, long={1: True, 4: True, 5: True}, exit_long={2: True}), one_a_day=True).trades) == 1
    swapped = run(bars([FLAT] * 3, long={1: True}, swap_days={2: 3.0}), swap_long=-2.0, volume_step=1.0, risk=4.0).trades[0]
    assert swapped[12] == -12


def test_break_even_trailing_and_partials():
    rising = [FLAT, FLAT, (100, 102.5, 100, 102), (102, 102.2, 99, 99.5), FLAT]
    assert run(bars(rising, long={1: True}, target_distance={1: None}), break_even_r=1.0).trades[0][13] == 0
    assert run(bars(rising, long={1: True}, target_distance={1: None}), trail_start_r=1.0, trail_r=0.5).trades[0][6] == 101.5
    part = run(bars([FLAT, FLAT, (100, 103, 100, 102), (102, 102.5, 101.5, 102)], long={1: True}, target_distance={1: None}), partials=((1.0, 0.4),))
    assert part.trades[0][10] == 2 * 2 + 3 * 2


def test_pending_orders():
    m = run(bars([FLAT, FLAT, (100, 102, 100, 101.5)], long={1: True}, order_distance={1: 1.0}, target_distance={1: None}), order="stop")
    assert m.trades[0][5] == 101
    m = run(bars([FLAT, FLAT, (98, 99, 97.5, 98.5)], long={1: True}, order_distance={1: 1.0}, target_distance={1: None}), order="limit")
    assert m.trades[0][5] == 98
    assert not run(bars([FLAT] * 6, long={1: True}, order_distance={1: 5.0}), order="stop").trades


def test_spark_runs_are_independent(spark):
    rows = [{**b, "run_id": r} for r in "ab" for b in bars([FLAT, FLAT, (100.0, 105.0, 100.0, 104.0)], long={1: True})]
    kinds = {"run_id": T.StringType(), "ts_ms": T.LongType(), "day": T.IntegerType(), "hour": T.IntegerType()} | {k: T.BooleanType() for k in ("long", "short", "exit_long", "exit_short", "tradable")}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in INPUT])
    floats = [c for c in INPUT if c not in kinds]
    frame = spark.createDataFrame([tuple(None if b[c] is None else float(b[c]) if c in floats else b[c] for c in INPUT) for b in rows], schema)
    settings = Settings(balance=100.0, risk=10.0, volume_step=1.0, volume_min=1.0, digits=2)
    one = sorted((r["run_id"], r["balance"], r["exit_reason"]) for r in replay(frame, settings).collect())
    assert one == [("a", 120.0, "TakeProfit"), ("b", 120.0, "TakeProfit")]
    from pyspark.sql import functions as F

    minutes = F.array(*[F.struct(F.col("ts_ms").alias("ts_ms"), *[F.col(c).alias(c) for c in ("open", "high", "low", "close", "spread")])])
    assert sorted((r["run_id"], r["balance"], r["exit_reason"]) for r in replay(frame.withColumn("minutes", minutes), settings, finer=True).collect()) == one
