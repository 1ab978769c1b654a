"""Long series in blocks against plain loops: numbering, running values, frames, recurrences; no task holds a whole key."""

import random

import numpy as np
import pytest
from candlewick.functions.scratch import Scratch
from candlewick.operators import series
from pyspark.sql import Window
from pyspark.sql import functions as F

SIZE = 7


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [("a", t, rng.randint(-9, 9) / 4) for t in range(100)] + [("b", t, float(t)) for t in range(SIZE)] + [("c", 0, 1.0)] + [(None, t, None if t % 3 else 2.0) for t in range(20)]
    made += [("d", None, 5.0), ("d", 3, None), ("d", 1, 7.0)]
    rng.shuffle(made)
    return made


@pytest.fixture
def table(spark, rows):
    with Scratch(spark, "series-test") as scratch:
        df = spark.createDataFrame(rows, "key string, t long, x double")
        yield series.numbered(df, ["key"], [F.asc_nulls_last("t")], scratch), scratch


def by_key(rows):
    out = {}
    for k, t, x in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        out.setdefault(k, []).append(x)
    return out


def test_numbers_follow_the_order_within_each_key(table, rows):
    found = {(r["key"], r["_n"]): r["x"] for r in table[0].collect()}
    assert found == {(k, i): x for k, xs in by_key(rows).items() for i, x in enumerate(xs)}


def test_running_values(table, rows):
    kinds = {k: (k, F.col("x")) for k in ("sum", "count", "max", "min", "last")}
    found = {(r["key"], r["_n"]): r for r in series.running(table[0], ["key"], kinds, SIZE).collect()}
    for k, xs in by_key(rows).items():
        for i in range(len(xs)):
            seen = [x for x in xs[: i + 1] if x is not None]
            r = found[k, i]
            assert r["count"] == len(seen)
            assert [r["sum"], r["max"], r["min"], r["last"]] == ([sum(seen), max(seen), min(seen), seen[-1]] if seen else [None] * 4)


def test_running_sum_of_decimals_is_exact_over_blocks(spark):
    with Scratch(spark, "series-test") as scratch:
        df = spark.range(1000).select(F.lit("k").alias("key"), "id", F.lit("0.1").cast("decimal(28,12)").alias("x"))
        out = series.running(series.numbered(df, ["key"], ["id"], scratch), ["key"], {"s": ("sum", F.col("x"))}, 64)
        assert [float(r["s"]) for r in out.orderBy("id").collect()] == [round((i + 1) / 10, 1) for i in range(1000)]


def test_frames_that_reach_over_blocks(table, rows):
    edge = 9  # beyond a block of 7
    w = Window.partitionBy("key").orderBy("_n").rowsBetween(-edge, 0)
    out = series.framed(table[0], "key", edge, lambda d: d.withColumn("s", F.sum("x").over(w)).withColumn("k", F.count("x").over(w)), SIZE)
    assert out.columns == ["key", "t", "x", "_n", "s", "k"]
    found = {(r["key"], r["_n"]): (r["s"], r["k"]) for r in out.collect()}
    for k, xs in by_key(rows).items():
        for i in range(len(xs)):
            seen = [x for x in xs[max(0, i - edge) : i + 1] if x is not None]
            assert found[k, i] == (sum(seen) if seen else None, len(seen))


def test_value_before(table, rows):
    found = {(r["key"], r["_n"]): r["y"] for r in series.before(table[0], ["key"], {"y": "x"}, SIZE).collect()}
    assert found == {(k, i): xs[i - 1] if i else None for k, xs in by_key(rows).items() for i in range(len(xs))}


def test_affine_recurrence(table, rows):
    out = series.affine(table[0], ["key"], {"y": (F.lit(0.9), F.col("x")), "z": (F.when(F.col("_n") % 5 == 0, 0.0).otherwise(1.0), F.coalesce("x", F.lit(0.0)))}, table[1], SIZE)
    assert out.columns == ["key", "t", "x", "_n", "y", "z"]
    found = {(r["key"], r["_n"]): r for r in out.collect()}
    for k, xs in by_key(rows).items():
        y = z = 0.0
        for i, x in enumerate(xs):
            y = y if x is None else 0.9 * y + x
            z = (0.0 if i % 5 == 0 else z) + (x or 0.0)
            assert abs(found[k, i]["y"] - y) < 1e-9
            assert abs(found[k, i]["z"] - z) < 1e-9


def test_prefix_maps():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-1, 1, 300), rng.normal(size=300)
    p, q = series.prefix_maps(a, b)
    y, z = 3.0, 0.0
    for i in range(300):
        y, z = a[i] * y + b[i], a[i] * z + b[i]
        assert abs(p[i] * 3 + q[i] - y) < 1e-9
        assert abs(q[i] - z) < 1e-9


def test_no_task_holds_a_key(spark):
    """One key of 20,000 rows over blocks of 500: the largest task of any stage reads some blocks, not the key."""
    n, size = 20_000, 500
    with Scratch(spark, "series-test") as scratch:
        kept = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            df = spark.range(n, numPartitions=20).select(F.lit("one").alias("key"), "id", (F.col("id") % 10).cast("double").alias("x"))
            rows = series.numbered(df, ["key"], ["id"], scratch)
            out = scratch.cut(series.running(rows, ["key"], {"s": ("sum", F.col("x"))}, size).withColumn("task", F.spark_partition_id()))
            assert out.groupBy("task").count().agg(F.max("count")).first()[0] <= 8 * size
            assert out.groupBy("task").count().count() >= 15
            assert out.where("id = 19999").first()["s"] == 9 * n / 2
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", kept)
            spark.conf.set("spark.sql.adaptive.enabled", "true")


# -- indicators as affine scans, against loops


def loops(rows, n):
    """EMA, Wilder's RSI, expanding ATR, ADX in both dialects, Heiken-Ashi opens and the adaptive mean, bar by bar."""
    out = []
    ema = seed = gain = loss = atr = o = c0 = None
    tr_s = p_s = m_s = tr_x = p_x = m_x = adx = adx_x = 0.0
    closes = []
    kama = None
    for i, (op, hi, lo, cl) in enumerate(rows):
        r = {}
        last = rows[i - 1] if i else None
        closes.append(cl)
        seed = sum(closes[:n]) / n if i == n - 1 else seed
        ema = None if i < n - 1 else seed if i == n - 1 else ema + 2 / (n + 1) * (cl - ema)
        r["ema"] = ema
        tr = hi - lo if last is None else max(hi - lo, abs(hi - last[3]), abs(lo - last[3]))
        atr = tr if i == 0 else ((min(i + 1, n) - 1) * atr + tr) / min(i + 1, n)
        r["atr"] = atr
        if i:
            up, down = max(cl - last[3], 0), max(last[3] - cl, 0)
            gain, loss = ((gain or 0) + up, (loss or 0) + down) if i < n else (((gain or 0) + up) / n, ((loss or 0) + down) / n) if i == n else ((gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n)
        r["rsi"] = None if i < n else (50.0 if gain == 0 else 100.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
        plus = minus = 0.0
        if last:
            u, d = hi - last[1], last[2] - lo
            plus, minus = (u if u > d and u > 0 else 0.0), (d if d > u and d > 0 else 0.0)
            f = 1 if i <= n else (n - 1) / n
            tr_s, p_s, m_s = tr_s * f + tr, p_s * f + plus, m_s * f + minus
        f = 1 if i < n else (n - 1) / n
        tr_x, p_x, m_x = tr_x * f + tr, p_x * f + plus, m_x * f + minus
        dx = 100 * abs(p_s - m_s) / (p_s + m_s) if tr_s and p_s + m_s else 0.0
        if i >= n:
            adx = adx + dx if i < 2 * n - 1 else (adx + dx) / n if i == 2 * n - 1 else (adx * (n - 1) + dx) / n
        r["adx"] = adx if i >= 2 * n - 1 else None
        if i:
            adx_x = 50.0 if tr_x == 0 or p_x + m_x == 0 else ((n - 1) * adx_x + 100 * abs(p_x - m_x) / (p_x + m_x)) / n
        r["adx_sqx"] = adx_x
        o = (op + cl) / 2 if o is None else (o + c0) / 2
        c0 = (op + hi + lo + cl) / 4
        r["ha"] = o
        if i >= n:
            noise = sum(abs(a - b) for a, b in zip(closes[-n:], closes[-n - 1 : -1], strict=True))
            k = ((abs(cl - closes[-n - 1]) / noise if noise else 0.0) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            kama = (closes[-2] if kama is None else kama) + k * (cl - (closes[-2] if kama is None else kama))
        r["kama"] = kama
        out.append(r)
    return out


def test_scans_equal_loops_over_many_blocks(spark):
    from candlewick.operators.indicators import scans as C

    rng = random.Random(8)
    n, data, held = 4, [], {}
    for symbol, bars, step in (("a", 150, 1.0), ("flat", 60, 0.0), ("one", 1, 1.0), (None, 23, 1.0)):
        price, held[symbol] = 50.0, []
        for t in range(bars):
            o, price = price, price + step * rng.choice([-1.5, -0.5, 0.0, 0.25, 2.0])
            bar = (o, max(o, price) + step * rng.random(), min(o, price) - step * rng.random(), price)
            if symbol == "a" and t % 11 == 3:
                data.append((symbol, t * 10 + 5, bar[0], None, bar[2], bar[3], 1))  # leaves all states alone
            data.append((symbol, t * 10, *bar, 1))
            held[symbol].append(bar)
    rng.shuffle(data)
    bars = spark.createDataFrame(data, "symbol string, ts_ms long, open double, high double, low double, close double, tick_volume long")
    made = {"ema": C.ema("close", n), "atr": C.atr_sqx(n), "rsi": C.rsi("close", n), "adx": C.directional(n, "adx"), "adx_sqx": C.directional(n, "adx", "sqx"), "ha": C.heiken_ashi("open"), "kama": C.kama("close", n)}
    got = {(r["symbol"], r["ts_ms"]): r for r in C.with_scans(bars, made, size=16).collect()}
    assert len(got) == len(data)
    for symbol, rows in held.items():
        for t, expected in enumerate(loops(rows, n)):
            for k, v in expected.items():
                assert got[symbol, t * 10][k] == (None if v is None else pytest.approx(v, abs=1e-9)), (symbol, t, k)
    assert {got["a", t * 10 + 5]["ema"] for t in range(150) if t % 11 == 3} == {None}


def test_stationary_bars_against_a_loop(spark):
    """Returns of blocks drawn by counters, over many blocks of rows; the first bar, times, volumes and spreads stay."""
    import math

    from candlewick.functions import draws
    from candlewick.operators.robustness import stationary_bars

    rng = random.Random(6)
    n, mean = 90, 5
    closes = [max(0.5, 20 + 3 * rng.gauss(0, 1)) for _ in range(n)]
    data = [("x", t * 10, c - 0.1, c + 0.5, c - 0.5, c, t, t * 2, t % 4) for t, c in enumerate(closes)] + [("lone", 0, 1.0, 2.0, 0.5, 1.5, 7, 8, None)]
    rng.shuffle(data)
    bars = spark.createDataFrame(data, "symbol string, ts_ms long, open double, high double, low double, close double, tick_volume long, real_volume long, spread_points int")
    got = {(r["symbol"], r["trial"], r["ts_ms"]): r for r in stationary_bars(bars, 2, mean, 11, size=16).collect()}
    assert len(got) == 2 * (n + 1)
    assert tuple(got["lone", 1, 0])[3:] == (1.0, 2.0, 0.5, 1.5, 7, 8, None)
    returns = [math.log(b / a) for a, b in zip(closes, closes[1:], strict=False)]
    lengths = []
    for trial in range(2):
        close, begin = closes[0], None
        assert tuple(got["x", trial, 0])[3:] == (closes[0] - 0.1, closes[0] + 0.5, closes[0] - 0.5, closes[0], 0, 0, 0)
        for i in range(1, n):
            turned = int(draws.draw32(11, draws.TURN, trial, np.array([i]))[0]) < round(2**32 / mean)
            if begin is None or turned or i - begin == 4 * mean:
                lengths.append(0)
                begin, start = i, int(draws.index(n - 1, 11, trial, np.array([i]))[0])
            lengths[-1] += 1
            o, close = close, max(close * math.exp(returns[(start + i - begin) % (n - 1)]), 1e-12)
            r = got["x", trial, i * 10]
            assert [r["open"], r["close"], r["high"], r["low"]] == pytest.approx([o, close, max(o, close) * 1.0001, min(o, close) * 0.9999], rel=1e-9)
            assert (r["tick_volume"], r["real_volume"], r["spread_points"]) == (i, 2 * i, i % 4)
    assert 3 < sum(lengths) / len(lengths) < 8 and max(lengths) <= 4 * mean


# -- order statistics of trailing windows


@pytest.mark.parametrize("length", [1, 2, 7, 50, 500])
def test_trailing_ranks_and_extremes_against_loops(length):
    from candlewick.operators.indicators import ordered

    rng = np.random.default_rng(length)
    values = rng.integers(0, 12, 230) / 4
    values[rng.random(230) < 0.03] = np.nan
    known = rng.random(230) > 0.1
    below, count = ordered.trailing_ranks(values, known, length)
    high, low = (ordered.extreme_age(np.where(np.isnan(values), 1.0, values), known, length, k) for k in ("high", "low"))
    for i in range(230):
        at = [j for j in range(max(0, i - length + 1), i + 1) if known[j]]
        assert count[i] == len(at)
        if known[i]:
            assert below[i] == sum(values[j] <= values[i] or np.isnan(values[i]) for j in at)
        w = [1.0 if np.isnan(values[j]) else values[j] for j in at]
        assert high[i] == (len(w) - 1 - w.index(max(w)) if w else -1)
        assert low[i] == (len(w) - 1 - w.index(min(w)) if w else -1)


def test_a_long_window_costs_little_more_than_a_short_one():
    import time

    from candlewick.operators.indicators import ordered

    values, known = np.random.default_rng(0).random(70_000), np.ones(70_000, dtype=bool)

    def took(length):
        best = float("inf")
        for _ in range(5):
            began = time.perf_counter()
            ordered.trailing_ranks(values, known, length)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(5000) < 2 * took(50)


def test_ordered_columns_over_many_blocks(spark):
    from candlewick.operators.indicators import ordered

    rng = random.Random(3)
    data = {s: [None if rng.random() < 0.1 else float(rng.randint(0, 9)) for _ in range(n)] for s, n in (("a", 80), ("b", 3), (None, 30))}
    rows = spark.createDataFrame([(s, t, x) for s, xs in data.items() for t, x in enumerate(xs)], "symbol string, ts_ms long, x double").repartition(3)
    got = {(r["symbol"], r["ts_ms"]): r for r in ordered.with_ordered(rows, {"p": ("percent", "x", 12), "h": ("high", "x", 5)}, size=8).collect()}
    assert len(got) == 113
    for s, xs in data.items():
        for i, x in enumerate(xs):
            w, v = [y for y in xs[max(0, i - 11) : i + 1] if y is not None], [y for y in xs[max(0, i - 4) : i + 1] if y is not None]
            r = got[s, i]
            assert r["p_count"] == len(w)
            assert r["p"] == (None if x is None else pytest.approx(100 * sum(y <= x for y in w) / len(w)))
            assert r["h"] == (len(v) - 1 - v.index(max(v)) if v else None)


# -- one-to-one matches


def test_alignment_against_the_sequential_choice(spark):
    """Runs with ties of time and price, NULLs, dense and sparse stretches: the same as choosing one trade after the other."""
    from candlewick.operators.joins import align_trades

    rng = random.Random(12)
    day = 86_400_000
    trade = lambda k, step: ("ab"[k % 2], k, rng.choice(["long", "short"]), rng.randint(0, 40) * step, rng.choice([1.0, 2.0, 2.5, None]), float(k))
    ours, theirs = ([trade(k, day // 3) if k < 60 else trade(k, 4 * day) for k in range(100)] for _ in range(2))
    ours += [("a", 500, None, 5, 1.0, 1.0), ("c", 501, "long", None, 1.0, 1.0)]
    theirs += [("a", 600, "long", None, 1.0, 1.0)]
    kinds = "run_id string, trade_no long, side string, entry_ms long, entry_price double, net double"
    used, expected = set(), []
    for run, no, side, at, price, net in sorted(ours, key=lambda t: t[1]):
        near = [(abs(t[3] - at), abs(t[4] - price) if t[4] is not None and price is not None else float("inf"), t[1], t[5]) for t in theirs if t[0] == run and t[2] == side and None not in (at, side, t[3]) and t[1] not in used and abs(t[3] - at) <= day]
        best = min(near, default=None)
        used.add(best[2] if best else None)
        expected.append((run, no, best[2] if best else None, best[3] - net if best else None))
    expected += [(t[0], None, t[1], None) for t in theirs if t[1] not in used]
    got = align_trades(spark.createDataFrame(ours, kinds), spark.createDataFrame(theirs, kinds), deltas=["net"], size=16).collect()
    assert sorted(((r["run_id"], r["ref_no"], r["ext_no"], r["delta_net"]) for r in got), key=repr) == sorted(expected, key=repr)


def test_content_root_sees_order_changes_and_repeats(spark):
    import hashlib

    from candlewick.operators.bars import content_root

    def root(rows, parts=2, leaf=4):
        df = spark.createDataFrame([("k", *r) for r in rows], "key string, t long, x string, y long").repartition(parts)
        r = content_root(df, ["key"], ["t"], ["t", "x", "y"], leaf).first()
        assert r["rows"] == len(rows)
        return r["root"]

    rows = [(t, None if t % 5 == 2 else f"v{t % 3}", t * t) for t in range(41)]
    cell = lambda v: "~" if v is None else f"{len(str(v))}:{v}"
    level, kind = [",".join(map(cell, r)) for r in rows], "leaf"
    while len(level) > 1 or kind == "leaf":
        level = [level[i] if kind == "node" and len(level[i : i + 4]) == 1 else hashlib.sha256("\n".join([kind, *level[i : i + 4]]).encode()).hexdigest() for i in range(0, len(level), 4)]
        kind = "node"
    assert root(rows) == root(rows, 7) == level[0]
    swapped = [(t, *(rows[t ^ 1][1:] if t in (8, 9) else r)) for t, *r in rows]
    changed = [(t, x, y + (t == 30)) for t, x, y in rows]
    assert len({root(rows), root(swapped), root(changed), root(rows[:-1]), root([*rows, rows[-1]]), root(rows[:1])}) == 6


@pytest.mark.parametrize("n", [20_000, 40_000])
def test_matches_of_a_piece_take_few_bytes_a_trade(n):
    """What a piece without gaps needs beyond its own table, for twice as many trades no more a trade."""
    import tracemalloc

    import pyarrow as pa
    from candlewick.operators.joins import _matches

    i = np.arange(n)
    piece = pa.table({"run_id": ["r"] * n, "side": ["long"] * n, "trade_no": i, "entry_ms": i // 2 * 1000, "entry_price": i * 0.5, "_ours": i % 2 == 0, "_piece": i * 0})
    tracemalloc.start()
    made = _matches(piece, 86_400_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.column("ref_no").to_pylist() == [*range(0, n, 2)] and made.column("ext_no").to_pylist() == [*range(1, n, 2)]
    assert peak / n < 80, peak / n


@pytest.mark.parametrize("n", [1000, 4000])
def test_matches_of_one_time_take_few_steps_a_trade(n):
    """All trades of a day share its time: a choice looks prices up instead of passing all that are left, whatever their number."""
    import sys

    import pyarrow as pa
    from candlewick.operators.joins import _matches

    i, calls = np.arange(n), [0]
    piece = pa.table({"run_id": ["r"] * 2 * n, "side": ["long"] * 2 * n, "trade_no": [*i, *i], "entry_ms": i.repeat(2) * 0, "entry_price": [*(i * 7919 % n * 1.0), *(i * 7919 % n + 0.25)], "_ours": [True] * n + [False] * n})

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        made = _matches(piece, 86_400_000)
    finally:
        sys.setprofile(None)
    assert made.num_rows == n and calls[0] / n < 30, calls[0] / n


def test_matches_of_shared_times_and_prices_against_the_sequential_choice():
    """Many trades a moment, before 1970 too; prices equal, missing, infinite, and as far only by rounding."""
    import math

    import pyarrow as pa
    from candlewick.operators.joins import _matches

    rng, day = random.Random(5), 86_400_000
    for at in range(300):
        prices = [[1.0, 2.0, 2.5, None, math.inf, math.nan], [1e17, 1e17 + 16, 1.0, 2.0, 3.0, 1e308, -1e308], [float(k) for k in range(9)]][at % 3]
        sides = [rng.random() < 0.5 for _ in range(rng.randint(1, 60))]
        rows = [(no, (rng.randint(0, 5) - 3) * day // 3, rng.choice(prices), ours) for no, ours in zip(rng.sample(range(99), len(sides)), sides, strict=True)]
        free, expected = {r for r in rows if not r[3]}, []
        for no, time, price, ours in sorted(rows, key=lambda r: r[0]):
            off = lambda r: math.inf if None in (r[2], price) or math.isnan(r[2] - price) else abs(r[2] - price)  # noqa: B023, E731
            near = [(abs(r[1] - time), off(r), r[0], r) for r in free if abs(r[1] - time) <= day]
            if ours and near:
                free.remove(min(near, key=lambda r: r[:3])[3])
                expected.append((no, min(near, key=lambda r: r[:3])[2]))
        no, time, price, ours = zip(*rows, strict=True)
        made = _matches(pa.table({"run_id": ["r"] * len(rows), "trade_no": no, "entry_ms": time, "entry_price": pa.array(price, pa.float64()), "_ours": ours}), day)
        assert [*zip(made["ref_no"].to_pylist(), made["ext_no"].to_pylist(), strict=True)] == expected


def test_alignment_is_cut_between_stretches_of_a_day(spark):
    """Times around 1970 a day or a millisecond more apart: a cut falls on longer gaps only."""
    from candlewick.operators.joins import align_trades

    day, kinds = 86_400_000, "run_id string, trade_no long, side string, entry_ms long, entry_price double"
    ours = [("r", k, "long", t, 1.0) for k, t in enumerate((-3 * day, -day, 0, day + 1, 3 * day, -1))]
    theirs = [("r", 10 + k, "long", t, 1.0) for k, t in enumerate((-2 * day, 1, 2 * day + 2, 4 * day, -2 * day - 1))]
    got = {(r["ref_no"], r["ext_no"]) for r in align_trades(spark.createDataFrame(ours, kinds), spark.createDataFrame(theirs, kinds), size=2).collect()}
    left, expected = list(theirs), set()
    for _, no, _, at, _ in ours:
        found = min(((abs(x[3] - at), x[1], x) for x in left if abs(x[3] - at) <= day), default=(0, None, None))
        expected.add((no, found[1]))
        left = [x for x in left if x is not found[2]]
    assert got == expected | {(None, x[1]) for x in left}
