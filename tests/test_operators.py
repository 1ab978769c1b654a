"""Rules, joins, search, packing and robustness on small tables."""

import pytest
from candlewick.operators import bars as B
from candlewick.operators import joins as J
from candlewick.operators import metrics as M
from candlewick.operators import parity as P
from candlewick.operators import robustness as Z
from candlewick.operators import rules as R
from candlewick.operators import search as G
from candlewick.operators import stats as S
from candlewick.operators.indicators import recursive as X
from pyspark.sql import functions as F

CLOSE, NONE = R.Value("price", "close"), R.Value("price", "gone")


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, i * B.HOUR, 100 + i % 7, 102.0 + i % 7, 98.0 + i % 7, 101.0 + (i * 5) % 7, 10 + i, 0, None if i % 3 else i % 4) for s in "ab" for i in range(60)]
    return spark.createDataFrame([(a, b, float(o), h, low, c, v, r, sp) for a, b, o, h, low, c, v, r, sp in rows], "symbol string, ts_ms long, open double, high double, low double, close double, tick_volume long, real_volume long, spread_points int")


def test_undefined_is_false_and_its_negation_true(bars):
    b = bars.withColumn("gone", F.lit(None).cast("double"))
    test = R.Test("gt", NONE, CLOSE)
    row = b.select(test.column().alias("t"), R.Junction("not", (test,)).column().alias("n")).distinct().collect()
    assert [(r["t"], r["n"]) for r in row] == [(False, True)]


def test_rule_limits_and_identity():
    a, b = R.Test("gt", CLOSE, R.Value("constant", value=1.0000000001)), R.Test("lt", CLOSE, R.Value("constant", value=2))
    assert R.fingerprint(R.Junction("and", (a, b))) == R.fingerprint(R.Junction("and", (b, R.Test("gt", CLOSE, R.Value("constant", value=1.0)))))
    assert R.fingerprint(R.Junction("and", (a, b))) != R.fingerprint(R.Junction("or", (a, b)))
    assert R.from_json(R.to_json(R.Junction("and", (a, b)))) == R.Junction("and", (a, b))
    with pytest.raises(ValueError):
        R.check(R.Test("gt", R.Value("price", "close", 0), CLOSE))
    with pytest.raises(ValueError):
        R.check(R.Junction("and", (a,)))
    deep = a
    for _ in range(9):
        deep = R.Junction("not", (deep,))
    with pytest.raises(ValueError):
        R.check(deep)


def test_swap_days(spark):
    t = spark.sql("SELECT timestamp_ntz'2024-01-05 22:00:00' AS f, timestamp_ntz'2024-01-08 01:00:00' AS m, timestamp_ntz'2024-01-10 01:00:00' AS w, timestamp_ntz'2024-01-11 00:00:00' AS t")
    r = t.select(J.rollovers(F.col("f"), F.col("m")).alias("weekend"), J.rollovers(F.col("w"), F.col("t")).alias("triple"), J.rollovers(F.col("w"), F.col("w")).alias("none")).first()
    assert tuple(r) == (1.0, 3.0, 0.0)


def test_alignment_uses_each_trade_once(spark):
    kinds = "run_id string, trade_no long, side string, entry_ms long, entry_price double"
    ours = spark.createDataFrame([("r", 1, "long", 1000, 1.0), ("r", 2, "long", 1001, 1.0), ("r", 3, "short", 1000, 1.0)], kinds)
    theirs = spark.createDataFrame([("r", 7, "long", 1001, 1.0), ("r", 8, "long", 90_000_000, 1.0)], kinds)
    got = {(r["ref_no"], r["ext_no"]) for r in J.align_trades(ours, theirs).collect()}
    assert got == {(1, 7), (2, None), (3, None), (None, 8)}


def test_shape_helpers(bars):
    folds = B.contiguous_folds(bars, 7).groupBy("symbol", "fold").count().collect()
    assert sorted(r["count"] for r in folds if r["symbol"] == "a") == sorted((60 * (f + 1) // 7) - 60 * f // 7 for f in range(7))
    kept = [r["ts_ms"] // B.HOUR for r in B.thin(bars.where("symbol = 'a'"), ["symbol"], "ts_ms", 10).orderBy("ts_ms").collect()]
    assert kept == [i * 59 // 9 for i in range(10)]
    eq = bars.select("symbol", "ts_ms", F.col("close").alias("equity"))
    assert all(len(r["signature"]) == 59 for r in B.equity_signature(eq, ["symbol"]).collect())
    assert {r["rows"] for r in B.content_hash(bars, ["ts_ms", "close"]).collect()} == {60}
    assert J.missing_minutes(bars, bars.where("ts_ms > 0"), B.HOUR).count() == 2
    assert J.aggregate_mismatches(bars, bars, B.HOUR, 1e-9).count() == 0


def test_recurrences_restart_with_each_symbol(bars):
    out = X.with_recurrences(bars, {"ema": X.ema("close", 5), "rsi": X.rsi("close", 5, "sqx"), "adx": X.directional(5, "adx")}).collect()
    a, b = ({r["ts_ms"]: (r["ema"], r["rsi"], r["adx"]) for r in out if r["symbol"] == s} for s in "ab")
    assert a == b and a[3 * B.HOUR][0] is None and a[4 * B.HOUR][0] is not None and a[0][1] == 0.0
    assert a[8 * B.HOUR][2] is None and a[9 * B.HOUR][2] is not None


def test_search(bars):
    rule = G.generate(5, 3)
    assert G.generate(5, 3) == rule and R.check(rule)
    assert R.check(G.trim(G.crossover(rule, G.mutate(rule, 1), 2)))
    out = G.signals(bars, {"x": rule, "y": G.generate(6, 2, "trend")})
    assert out.count() == 240 and {r["run_id"] for r in out.select("run_id").distinct().collect()} == {"a|x", "a|y", "b|x", "b|y"}
    e = lambda f, s: {"fingerprint": f, "signature": s, "evidence": 1, "complexity": 1, "trades": 1}
    kept = G.deposit([], [e("a", [1, 2, 3.0]), e("a", [3, 1, 2.0]), e("b", [2, 4, 6.0]), e("c", [1, -1, 1.0]), e("d", [1, 1, 1.0])])
    assert [x["fingerprint"] for x in kept] == ["a", "c", "d"]
    assert G.champion(kept[0] | {"trades": 5}, kept[0])["trades"] == 5 and G.tournament(kept, 3, 0.5, 1) in kept


def test_portfolio_packing():
    c = [{"id": i, "symbol": s, "cohort": k, "objective": o} for i, s, k, o in (("a", "X", 1, 3), ("b", "X", 1, 2), ("c", "Y", 1, 1), ("d", "Z", 2, 0))]
    assert S.pack_portfolio(c, {("a", "c"): 0.9}, 3, 1, 2, 0.5) == ["a", "d"]
    assert S.pack_portfolio(c, {}, 2, 2, 2, 0.5) == ["a", "b"]


def test_predicates(spark):
    t = spark.createDataFrame([(50, 5.0, 10.0, None, 1.0, 2.0), (5, 50.0, -1.0, 0.5, 1.0, 0.1)], "trades int, max_drawdown_percent double, return_percent double, profit_factor double, before double, since double")
    assert [tuple(r) for r in t.select(Z.gate(10, 20, 0, 1.2), Z.oos_pick(0.5)).collect()] == [(True, True), (False, False)]
    assert spark.range(1).select(M.cagr(F.lit(21.0), F.lit(2.0))).first()[0] == pytest.approx(10.0)
    assert spark.range(1).select(S.expected_lucky_sharpe(F.lit(64_000))).first()[0] == pytest.approx(4.18, abs=0.05)
    assert Z.certificate({})["grade"] == "none"
    full = {k: {"passed": True} for k in ("data", "strategy", "broker", "split", "screen", "challenge", "sealed")}
    assert Z.certificate(full)["grade"] == "sealed" and Z.certificate(full | {"incubation": {"passed": True}})["grade"] == "live"


def test_run_comparison(spark):
    a = spark.createDataFrame([("x", 10, 100.0), ("y", 5, 50.0), ("z", 1, 1.0)], "name string, trades int, net double")
    b = spark.createDataFrame([("x", 10, 101.0), ("y", 9, 50.0), ("y", 9, 50.0)], "name string, trades int, net double")
    assert {r["name"]: r["passed"] for r in P.run_diff(a, b.dropDuplicates(), ["name"], {"trades": 5.0, "net": 2.0}).collect()} == {"x": True, "y": False, "z": False}
    assert {r["name"]: r["status"] for r in P.retest_report(a, b, "name", ["trades", "net"], 2.0).collect()} == {"x": "OK", "y": "MISMATCH", "z": "MISSING"}
    eq = a.select("name", F.lit(1).cast("long").alias("ts_ms"), F.col("net").alias("equity"))
    assert {r["max_gap_percent"] for r in P.equity_divergence(eq, eq, ["name"]).collect()} == {0.0}


def test_synthetic_bars_keep_their_shape(bars):
    out = Z.stationary_bars(bars, 2, 5, 1).collect()
    assert len(out) == 240 and all(r["low"] <= min(r["open"], r["close"]) and r["high"] >= max(r["open"], r["close"]) for r in out)


def mixed(x):
    """The published finaliser, in Python's integers."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = (x ^ x >> shift) * factor % 2**32
    return x


def drawn32(lane, trial, k, seed=42):
    return mixed((mixed(mixed((seed + (lane + 1) * 0x9E3779B9) % 2**32) ^ trial) + k + (k >> 32) * 0x9E3779B9) % 2**32)


def drawn(n, trial, k):
    return ((drawn32(0, trial, k) << 30) + (drawn32(1, trial, k) >> 2)) % n


def skipped(trial, k):
    return drawn32(2, trial, k) < round(0.1 * 2**32)


def test_draws_are_the_same_in_every_form_and_uniform(spark):
    import numpy as np
    from candlewick.functions import draws

    ks = [0, 1, 2, 77, 2**31, 2**32 + 5, 2**40]
    made = spark.createDataFrame([(t, k) for t in (0, 3, 999) for k in ks], "t int, k long").select("t", "k", draws.draw32_column(42, draws.SKIP, F.col("t"), F.col("k")).alias("g"), draws.index_column(F.lit(10**12 + 39), 42, F.col("t"), F.col("k")).alias("i")).collect()
    for r in made:
        assert r["g"] == drawn32(2, r["t"], r["k"]) == draws.draw32(42, draws.SKIP, r["t"], np.array([r["k"]]))[0]
        assert r["i"] == drawn(10**12 + 39, r["t"], r["k"]) == draws.index(10**12 + 39, 42, r["t"], np.array([r["k"]]))[0]
    n, each = 300_000, 200
    found = np.concatenate([draws.index(n, 7, t, np.arange(10_000)) for t in range(each)])
    expected = len(found) / 100
    cells = np.bincount(found * 100 // n, minlength=100)
    assert ((cells - expected) ** 2 / expected).sum() < 170  # chi-squared of 99 degrees: beyond this once in 10,000
    pairs = np.bincount(found[:-1] * 10 // n * 10 + found[1:] * 10 // n, minlength=100)
    assert ((pairs - expected) ** 2 / expected).sum() < 170
    assert len(np.unique(found)) > 0.99 * n * (1 - np.exp(-len(found) / n))


def test_bootstrap_reaches_losses_late_in_a_run(spark):
    """40,000 trades whose first 32,772 earn 1 and whose others lose 1,000, and 100,000 whose last tenth loses: all trials show it."""
    t = spark.range(40_000).select(F.lit("r").alias("run_id"), F.col("id").alias("idx"), F.when(F.col("id") < 32_772, 1.0).otherwise(-1000.0).alias("profit"))
    t = t.unionByName(spark.range(100_000).select(F.lit("s").alias("run_id"), F.col("id").alias("idx"), F.when(F.col("id") < 90_000, 1.0).otherwise(-10.0).alias("profit")))
    got = S.block_bootstrap(t, ["run_id"], trials=20).collect()
    nets = {run: [r["net"] for r in got if r["run_id"] == run] for run in "rs"}
    assert all(-9e6 < x < -5.5e6 for x in nets["r"]) and all(abs(x + 10_000) < 15_000 for x in nets["s"])
    assert all(r["max_drawdown_percent"] > 100 for r in got if r["run_id"] == "r")


def test_long_runs_walk_the_same_trials_over_tasks(spark):
    """A run beyond the array's bound, with NULLs and skips, beside a short one: stretches give what the array gives."""
    t = spark.range(70_003).select(F.when(F.col("id") < 70_000, "long").otherwise("short").alias("run_id"), F.when(F.col("id") < 70_000, F.col("id")).otherwise(F.col("id") - 70_000).alias("idx"), F.when(F.col("id") % 13 > 0, F.pmod(F.col("id") * 37, F.lit(101)) - 50.5).alias("profit"))
    arrays, joined = ({(r["run_id"], r["trial"]): (r["net"], r["max_drawdown_percent"]) for r in S.block_bootstrap(t, ["run_id"], trials=6, skip=0.1, long=long).collect()} for long in (S.LONG, 1000))
    assert set(arrays) == set(joined) and len(arrays) == 12
    assert all(joined[k] == pytest.approx(v, rel=1e-9) for k, v in arrays.items())


def test_block_bootstrap_query_draws_from_all_trades(spark):
    from candlewick.plans import registry
    from candlewick.plans import tables as T

    sf_dir, profits = "/root/testdata/sf0.001", {}
    for r in sorted(T.trades(spark, sf_dir).select("run_id", "trade_no", "net_profit").collect()):
        profits.setdefault(r["run_id"], []).append(r["net_profit"])
    got = {(r["run_id"], r["trial"]): (r["net"], r["max_drawdown_percent"]) for r in registry.queries()["block_bootstrap"](spark, sf_dir).collect()}
    assert set(got) == {(run, trial) for run in profits for trial in range(250)}

    for (run, trial), (net, worst) in got.items():
        p, balance, top, down = profits[run], 10_000.0, 10_000.0, 0.0
        for pos in range(len(p)):
            if not skipped(trial, pos):
                balance += p[(pos % 5 + drawn(len(p), trial, pos // 5)) % len(p)]
            top = max(top, balance)
            down = max(down, (top - balance) / top * 100)
        assert abs(net - (balance - 10_000)) < 0.011 and abs(worst - down) < 1e-5


def test_block_bootstrap_of_many_trades(spark):
    """More positions than a 64-bit product of the unreduced state bears; trials go on past the first ten of a row."""
    n, made = 420_000, {}
    t = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("idx"), (F.pmod(F.col("id") * 37, F.lit(101)) - 50).cast("double").alias("profit"))
    got = {r["trial"]: r for r in S.block_bootstrap(t, ["run_id"], trials=12, skip=0.1).collect()}
    assert set(got) == set(range(12))

    for trial in (0, 11):
        balance, top, down = 10_000.0, 10_000.0, 0.0
        for pos in range(n):
            if pos % 5 == 0:
                start = drawn(n, trial, pos // 5)
            if not skipped(trial, pos):
                balance += (start + pos % 5) % n * 37 % 101 - 50
            top = max(top, balance)
            down = max(down, (top - balance) / top * 100)
        made[trial] = balance - 10_000, down
        assert got[trial]["net"] == made[trial][0] and got[trial]["max_drawdown_percent"] == pytest.approx(down, abs=1e-9)


def test_resampling_report_of_many_trades(spark):
    """More trades than the unreduced state bore: the quantiles are those of the trials, which a rising run passes."""
    t = spark.range(420_000).select(F.lit("r").alias("run_id"), F.col("id").alias("idx"), (F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0)).alias("profit"))
    trials = S.block_bootstrap(t, ["run_id"], trials=21, skip=0.1)
    nets = sorted(r["net"] for r in trials.collect())
    own = S.profit_path(t, ["run_id"])
    row = S.resampling_report(trials, ["run_id"], own, drawdown_ratio=1000.0).first()
    assert (row["p05"], row["p50"], row["p80"]) == (nets[1], nets[10], nets[16]) and row["passed"]
    assert own.first()["net"] == 140_000.0


def test_resampling_report_of_cents(spark):
    """Several slabs of trades in cents: the report's figures are those of whole numbers."""
    n, cents = 60_000, lambda i: i * 7_919 % 2_003 - 1_000
    t = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("idx"), ((F.col("id") * 7_919 % 2_003 - 1_000) / 100).alias("profit"))
    row = S.resampling_report(S.block_bootstrap(t, ["run_id"], trials=3, skip=0.1), ["run_id"], S.profit_path(t, ["run_id"])).first()

    nets, downs = [], []
    for trial in range(3):
        balance, top, down = 1_000_000, 1_000_000, 0.0
        for pos in range(n):
            if not skipped(trial, pos):
                balance += cents((drawn(n, trial, pos // 5) + pos % 5) % n)
            top = max(top, balance)
            down = max(down, (top - balance) / top * 100)
        nets.append((balance - 1_000_000) / 100)
        downs.append(down)
    assert [row["p05"], row["p50"], row["worst_drawdown"]] == pytest.approx([min(nets), sorted(nets)[1], max(downs)], rel=1e-12)


def test_block_bootstrap_wants_every_index(spark):
    t = spark.createDataFrame([("r", i, 1.0) for i in (0, 1, 40_000)], "run_id string, idx long, profit double")
    with pytest.raises(Exception, match="idx has to run from 0"):
        S.block_bootstrap(t, ["run_id"], trials=1).collect()


def test_correlation_pairs_meet_across_blocks(spark, monkeypatch):
    """Blocks of two ids: every pair once, against plain sums; over the common length, without NULLs, 0 for a flat path."""
    import math

    monkeypatch.setattr(S, "_BLOCK", 2)
    held = {1: [1.0, 2.0, 4.0, 3.0], 2: [2.0, 1.0, 0.0, 5.0], 3: [7.0, 7.0, 7.0, 7.0], 4: [1.0, 3.0, 2.0], 5: [4.0, None, 1.0, 9.0], 6: [1e6, 1e6 + 1, 1e6 + 3, 1e6 + 2], 7: [3.0, 1.0, 2.0, 2.5]}
    t = spark.createDataFrame([("k", i, v) for i, v in held.items()] + [("l", 9, [1.0, 2.0]), ("l", 8, [2.0, 1.0])], "cohort string, id long, signature array<double>")
    got = {(r["cohort"], r["a"], r["b"]): r["corr"] for r in S.correlation_pairs(t, ["cohort"], "id", "signature").collect()}

    def plain(x, y):
        both = [(u, v) for u, v in zip(x, y, strict=False) if u is not None and v is not None]
        mx, my = (sum(c) / len(both) for c in zip(*both, strict=True))
        cov, vx, vy = sum((u - mx) * (v - my) for u, v in both), sum((u - mx) ** 2 for u, _ in both), sum((v - my) ** 2 for _, v in both)
        return cov / math.sqrt(vx * vy) if vx * vy > 0 else 0.0

    wanted = {("k", i, j): plain(held[i], held[j]) for i in held for j in held if i < j} | {("l", 8, 9): -1.0}
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in wanted.items())


def test_correlation_pairs_hold_no_cohort_in_a_task(spark, monkeypatch):
    """Ids are numbered by ranges, not by a window over their cohort; pieces of few pairs and paths of floats give the same rows."""
    monkeypatch.setattr(S, "_BLOCK", 7)
    rows = [(f"c{i % 2}", i, [float(i * k % 11) for k in range(1, 6)] if i % 5 else None if i % 10 else [2.0, float(i)]) for i in range(1, 41)]
    made = lambda kind: S.correlation_pairs(spark.createDataFrame(rows, f"cohort string, id long, signature array<{kind}>"), ["cohort"], "id", "signature")
    whole = {tuple(r)[:3]: r["corr"] for r in made("double").collect()}
    monkeypatch.setattr(S, "_SIDE", 3, raising=False)
    pieces = made("float")
    assert "Window" not in pieces._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r)[:3]: r["corr"] for r in pieces.collect()}
    assert len(got) == 2 * (20 * 19 // 2) and got.keys() == whole.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in whole.items())


def test_equity_sharpe_counts_every_point(spark):
    """Below zero and from zero on too: returns of 100, -50, 0, 10 from 100 are 0, -1.5, -1 and undefined."""
    t = spark.createDataFrame([("x", i, float(e)) for i, e in enumerate((100, -50, 0, 10))], "symbol string, ts_ms long, equity double")
    row = M.equity_sharpe(t, ["symbol"], 100.0).first()
    r = [0.0, -1.5, -1.0]
    mean = sum(r) / 3
    assert row["returns"] == 4 and row["sharpe"] == pytest.approx(mean / (sum((x - mean) ** 2 for x in r) / 2) ** 0.5 * 2)


def test_equity_gathers_no_error(spark, tmp_path):
    """Ten thousand hours of a step of a tenth end at 11,000 exactly; a step without a bound still shows."""
    from candlewick.plans import tables as T

    t = spark.range(20_000).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, int(id div 2), int(id % 2), 0)").alias("ts"), F.lit("x").alias("event_type"), F.when(F.col("id") % 2 == 1, 0.3).otherwise(0.2).alias("value"))
    t.write.parquet(f"{tmp_path}/events.parquet")
    assert T.equity(spark, str(tmp_path)).orderBy(F.desc("ts_ms")).first()["equity"] == 11_000.0
    t.withColumn("value", F.when(F.col("event_id") == 3, float("inf")).otherwise(F.col("value"))).write.mode("overwrite").parquet(f"{tmp_path}/odd/events.parquet")
    got = [r["equity"] for r in T.equity(spark, f"{tmp_path}/odd").orderBy("ts_ms").limit(3).collect()]
    assert got == [10_000.1, float("inf"), float("inf")]


def test_negative_spreads_are_carried(spark):
    t = spark.createDataFrame([("x", i, s) for i, s in enumerate((0, -2, 0, None, 3, 0))], "symbol string, ts_ms long, spread_points int")
    assert [r["spread_points"] for r in B.fill_spread(t).orderBy("ts_ms").collect()] == [0, -2, -2, -2, 3, 3]


def test_bars_without_a_time_come_last(spark):
    from candlewick.operators.indicators import windowed as I

    rows = [("x", t, c, c, c, c, v, 0, s) for t, c, v, s in ((None, 9.0, 7, 3), (1, 1.0, 1, 0), (2, 2.0, 2, 0))]
    t = spark.createDataFrame(rows, "symbol string, ts_ms long, open double, high double, low double, close double, tick_volume long, real_volume long, spread_points int")
    made = X.with_recurrences(t.withColumns({"roc": I.rate_of_change("close", 1), "volume": I.average_volume(2)}), {"macd": X.macd("close", 1, 2, 1, "main"), "sma": X.ema("close", 2)})
    got = {r["ts_ms"]: (r["roc"], r["volume"], r["sma"]) for r in B.fill_spread(made).collect()}
    assert got == {1: (None, None, None), 2: (100.0, 1.5, 1.5), None: (350.0, 4.5, 6.5)}
    assert {r["ts_ms"]: r["spread_points"] for r in B.fill_spread(t).collect()} == {1: 0, 2: 0, None: 3}
    assert [r["drawdown"] for r in M.drawdown(t.withColumn("equity", -F.col("close")), ["symbol"], 0.0).where("ts_ms = 1").collect()] == [1.0]


def test_settled_values_keep_size_and_nan(spark):
    from candlewick.functions.numeric import settle

    given = [1e18, -1e18, float("inf"), float("-inf"), float("nan"), 0.0000005, -0.0000005, -0.0000006, 2.4999994, -3.25, None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").orderBy("i").select(settle(F.col("x"))).collect()]
    assert got[:4] == given[:4] and got[4] != got[4]
    assert got[5:] == [1e-6, 0.0, -1e-6, 2.499999, -3.25, None] and str(got[6]) == "0.0"


def test_weighted_mean_keeps_places_of_nulls(spark):
    from candlewick.operators.indicators import windowed as I

    t = spark.createDataFrame([("x", i, c) for i, c in enumerate((6.0, None, 12.0, None, None, None))], "symbol string, ts_ms long, close double")
    assert [r[0] for r in t.withColumn("w", I.wma("close", 3)).orderBy("ts_ms").select("w").collect()] == [None, None, 7.0, 4.0, 2.0, None]


def test_report_adds_up_in_the_order_of_the_sql(spark):
    """11 of 40 bars impossible, 14 of 200 rows doubled, unsorted: 27.500000000000004 + 7.000000000000001 + 2 lost, so 63 are left, not 64."""
    from candlewick.operators import quality as Q

    monday = 1_704_672_000_000
    rows = [("x", monday + i * B.HOUR, 10.0, 9.0 if i < 11 else 12.0, 9.5, 10.0, 1, 0, None) for i in range(40)]
    b = spark.createDataFrame(rows, "symbol string, ts_ms long, open double, high double, low double, close double, tick_volume long, real_volume long, spread_points int")
    told = spark.createDataFrame([("x", 200, 14, False)], "symbol string, source_rows long, duplicates long, was_sorted boolean")
    row = Q.report(b, ingest=told).first()
    assert (row["invalid"], row["weekend"], row["spikes"], row["gap_events"]) == (11, 0, 0, 0)
    assert row["score"] == round(100 - (11 / 40 * 100 + 14 / 200 * 100 + 2)) == 63


def test_runs_in_chunks_walk_the_same_trials(spark, monkeypatch):
    """Runs put together from chunks, with NULLs and skips, beside short ones: bit by bit what one array gives, and the run's own path too."""
    n = 5_003
    t = spark.range(n + 12).select(F.when(F.col("id") < n, "long").when(F.col("id") < n + 9, "short").otherwise("none").alias("run_id"), F.when(F.col("id") < n, F.col("id")).when(F.col("id") < n + 9, F.col("id") - n).otherwise(F.col("id") - n - 9).alias("idx"), F.when((F.col("id") % 13 > 0) & (F.col("id") < n + 9), F.pmod(F.col("id") * 37, F.lit(101)) - 50.3).alias("profit"))
    shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
    trials = lambda: shown(S.block_bootstrap(t, ["run_id"], trials=23, skip=0.1))
    whole, path = trials(), shown(S.profit_path(t, ["run_id"]))
    monkeypatch.setattr(S, "_SHORT", 100)
    monkeypatch.setattr(S, "_CHUNK", 64)
    assert trials() == whole and len(whole) == 3 * 23
    assert shown(S.profit_path(t, ["run_id"])) == path and len(path) == 3
    balance = top = 10_000.0
    worst, total = 0.0, 0.0
    for i in range(n):
        total += (i * 37 % 101 - 50.3) if i % 13 else 0.0
        balance = 10_000.0 + total
        top = max(top, balance)
        worst = max(worst, (top - balance) / top * 100)
    assert {r[0]: r[1:] for r in path}["long"] == (total, worst) and {r[0]: r[1:] for r in path}["none"] == (None, None)


def test_runs_in_chunks_want_every_index(spark, monkeypatch):
    monkeypatch.setattr(S, "_SHORT", 2)
    monkeypatch.setattr(S, "_CHUNK", 4)
    for places in ((0, 1, 2, 4, 5), (0, 1, 1, 3, 4), (1, 2, 3, 4, 5), (0, 1, 2, 3, 8)):
        t = spark.createDataFrame([("r", i, 1.0) for i in places], "run_id string, idx long, profit double")
        with pytest.raises(Exception, match="idx has to run from 0"):
            S.block_bootstrap(t, ["run_id"], trials=1).collect()


def test_draws_of_four_million_trades_meet_them_in_a_task(spark):
    """A run of more than 2^22 trades: no row is made for a block drawn, and no window holds the run."""
    import numpy as np
    from candlewick.functions import draws

    n = (1 << 22) + 5
    t = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("idx"), (F.col("id") % 7 - 3).cast("double").alias("profit"))
    trials, own = S.block_bootstrap(t, ["run_id"], trials=2), S.profit_path(t, ["run_id"])
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (trials, own)]
    assert "_start" not in plans[0] and "Window" not in plans[1]
    got = {r["trial"]: r["net"] for r in trials.collect()}
    for trial in range(2):
        at = np.arange(n)
        assert got[trial] == float(((draws.index(n, 42, trial, at // 5) + at % 5) % n % 7 - 3).sum())
    assert own.first()["net"] == float((np.arange(n) % 7 - 3).sum())
