"""Streams in append mode: early, late and repeated events, and a restart in mid-stream, against the batch form."""

import random

import pytest
from candlewick.operators import bars as B
from candlewick.streaming import bars as stream_bars
from candlewick.streaming import ordered
from pyspark.sql import functions as F

KIND = "symbol string, ts_ms long, price double, volume long, seq long, spread_points int, ts timestamp"
LATE = 120_000


def arrivals():
    """Three files of disordered quotes with repeats; the last holds some that are later than the watermark."""
    rng = random.Random(1)
    files, seq, horizon = [], 0, None
    for part in range(3):
        rows = []
        for _ in range(120):
            seq += 1
            t = part * 1_800_000 + rng.randint(0, 1_799) * 1000
            rows.append((rng.choice("XY"), t, float(rng.randint(1, 50)), 1, seq, rng.choice([0, 0, 3, 5])))
        rows += rng.sample(rows, 10)
        horizon = horizon or max(r[1] for r in rows)
        late = [("X", horizon - LATE - 60_000 * k, 99.0, 1, 10_000 + k, 1) for k in range(1, 4)] if part == 2 else []
        files.append((rows, late))
    return files


@pytest.fixture
def run(spark, tmp_path):
    def go(make, files, restart_after):
        source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
        for i, (rows, late) in enumerate(files):
            spark.createDataFrame([(*r, None) for r in rows + late], KIND).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(source)
            if i + 1 in (restart_after, len(files)):  # the query ends here, and later starts anew from its checkpoint
                stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
                q = make(stream).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).start()
                q.awaitTermination(240)
                assert q.exception() is None
        return spark.read.parquet(out)

    return go


def accepted(files):
    return {r[4]: r for rows, _ in files for r in rows}.values()


@pytest.mark.parametrize("restart_after", [1, 2])
def test_filled_stream_equals_the_sorted_batch(spark, run, restart_after):
    files = arrivals()
    got = run(lambda s: ordered.stream_filled(s, 5, "2 minutes"), files, restart_after).collect()
    passed = max(r[1] for r in accepted(files)) - LATE
    expected = {}
    for symbol in "XY":
        spread, prices = 0, []
        for _, t, price, _, seq, own in sorted((r for r in accepted(files) if r[0] == symbol), key=lambda r: (r[1], r[4])):
            spread, prices = own or spread, [*prices, price][-5:]
            if t < passed:
                expected[seq] = (symbol, t, price, spread, sum(prices) / 5 if len(prices) == 5 else None)
    mine = {r["seq"]: (r["symbol"], r["ts_ms"], r["price"], r["spread_points"], r["mean"]) for r in got if r["ts_ms"] < passed}
    assert mine == expected and len(got) == len({r["seq"] for r in got})


def test_bars_are_final_once_and_late_quotes_are_dropped(spark, run):
    files = arrivals()
    got = run(lambda s: stream_bars.stream_bars(s, unique=["symbol", "seq"]), files, 2).collect()
    batch = B.ticks_to_bars(spark.createDataFrame([(*r, None) for r in accepted(files)], KIND).drop("ts")).collect()
    passed = max(r[1] for r in accepted(files)) - LATE
    columns = ("symbol", "ts_ms", "open", "high", "low", "close", "tick_volume")
    row = lambda r: tuple(r[c] for c in columns)
    assert sorted(map(row, got)) == sorted(row(r) for r in batch if r["ts_ms"] + 60_000 <= passed)


def test_sessions(spark, run):
    files = [(rows, []) for rows, _ in arrivals()]
    got = run(lambda s: ordered.stream_sessions(s, "1 minute"), files, 1).collect()
    made = []
    every = [r for rows, _ in files for r in rows]
    for symbol in "XY":
        for t, price in sorted((r[1], r[2]) for r in every if r[0] == symbol):
            if made and made[-1][0] == symbol and t <= made[-1][2]:
                made[-1] = (symbol, made[-1][1], t + 60_000, made[-1][3] + 1, min(made[-1][4], price), max(made[-1][5], price))
            else:
                made.append((symbol, t, t + 60_000, 1, price, price))
    passed = max(r[1] for r in every) - LATE
    mine = sorted(map(tuple, got))
    assert set(mine) <= set(made) and {m for m in made if m[2] < passed} <= set(mine) and len(mine) == len(set(mine))


def test_rows_that_wait_take_few_bytes_in_a_task(tmp_path):
    """200,000 rows of one symbol in one batch: the processor alone, with its state on disk, holds less than 150 bytes of each."""
    import pickle
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    class OnDisk:
        def __init__(self):
            self.files, self.value = 0, None

        def appendList(self, rows):  # noqa: N802
            (tmp_path / str(self.files)).write_bytes(pickle.dumps(rows))
            self.files += 1

        def appendValue(self, row):  # noqa: N802
            self.appendList([row])

        def get(self):
            return self.value or (r for i in range(self.files) for r in pickle.loads((tmp_path / str(i)).read_bytes()))

        def exists(self):
            return bool(self.files or self.value)

        def clear(self):
            self.files = 0

        def update(self, value):
            self.value = value

    held, past, timers = OnDisk(), OnDisk(), []
    processor = ordered.InOrder(20)
    processor.init(SimpleNamespace(getListState=lambda *_: held, getValueState=lambda *_: past, registerTimer=timers.append))
    n, size = 200_000, 10_000
    made = lambda i: pd.DataFrame({"ts_ms": np.arange(i, i + size)[::-1] + 1, "seq": np.arange(i, i + size), "price": np.arange(i, i + size) * 0.1, "spread_points": np.arange(i, i + size) % 4})
    tracemalloc.start()
    list(processor.handleInputRows(("X",), (made(i) for i in range(0, n, size)), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    seen = sum(len(f) for f in processor.handleExpiredTimer(("X",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2 * n), None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and min(timers) == 1
    assert peak / n < 150, peak / n
