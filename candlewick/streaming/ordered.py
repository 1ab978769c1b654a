"""Running features of an unbounded, disordered quote stream: rows wait until the watermark has passed them, then go in order of time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "symbol string, ts_ms long, seq long, price double, spread_points int, mean double"


#: Rows that come out in one frame.
FRAME = 65_536
ROW = np.dtype([("ts_ms", "<i8"), ("seq", "<i8"), ("price", "<f8"), ("spread", "<i4")])


class InOrder(StatefulProcessor):
    """Per symbol: rows not yet passed by the watermark, the last spread that is not zero, and the last n prices.

    Rows that wait are kept as packed bytes, one value for each frame they came in: 28 bytes a row in the state and in the task.
    """

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.past = handle.getValueState("past", "spread int, recent string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            frame = frame[frame["ts_ms"] >= passed]
            if not len(frame):
                continue
            new = np.empty(len(frame), ROW)
            new["ts_ms"], new["seq"], new["price"], new["spread"] = frame["ts_ms"], frame["seq"], frame["price"], frame["spread_points"].fillna(0)
            self.held.appendValue((new.tobytes(),))
            first = min(int(new["ts_ms"].min()), first) if first is not None else int(new["ts_ms"].min())
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for (part,) in self.held.get() if self.held.exists() else ():
            part = np.frombuffer(part, ROW)
            out = part["ts_ms"] <= passed
            ready.append(part[out])
            if not out.all():
                rest.append(part[~out])
        if rest:
            self.held.put([(part.tobytes(),) for part in rest])
            self.handle.registerTimer(min(int(part["ts_ms"].min()) for part in rest))
        else:
            self.held.clear()
        ready = np.concatenate([*ready, np.empty(0, ROW)])
        if not len(ready):
            return
        order = np.lexsort((ready["price"], ready["seq"], ready["ts_ms"]))
        spread, recent = tuple(self.past.get()) if self.past.exists() else (0, "[]")
        recent = json.loads(recent)
        for at in range(0, len(order), FRAME):
            own = ready[order[at : at + FRAME]]
            last = np.maximum.accumulate(np.where(own["spread"] != 0, np.arange(len(own)), -1))
            filled = np.where(last >= 0, own["spread"][last], spread)
            prices = np.concatenate([np.array(recent[-(self.n - 1) :] if self.n > 1 else [], float), own["price"]])
            total = np.zeros(max(len(prices) - self.n + 1, 0))
            for k in range(self.n if len(total) else 0):  # each from its oldest price on
                total += prices[k : k + len(total)]
            mean = np.full(len(own), np.nan)  # comes out as NULL
            if len(total):
                mean[-len(total) :] = total[-len(own) :] / self.n
            spread, recent = int(filled[-1]), prices[-self.n :].tolist()
            yield pd.DataFrame({"symbol": key[0], "ts_ms": own["ts_ms"], "seq": own["seq"], "price": own["price"], "spread_points": filled.astype("int32"), "mean": mean})
        self.past.update((spread, json.dumps(recent)))

    def close(self) -> None:
        pass


def stream_filled(ticks: DataFrame, n: int = 20, late: str = "2 minutes") -> DataFrame:
    """Quotes (symbol, ts timestamp, seq, price, spread_points) with zero spreads filled from the last other one, and the mean of the last n prices.

    Append mode: a row comes out once the watermark has passed its time, in the order of time and seq within its symbol, so
    early and disordered rows give what a sorted batch gives; rows later than the watermark and repeats of seq within it are
    dropped. State is what the watermark has not passed, one spread and n prices a symbol; it is in the checkpoint (RocksDB).
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = ticks.select("symbol", "ts", F.unix_millis("ts").alias("ts_ms"), "seq", "price", "spread_points").withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "seq"])
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=InOrder(n), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def stream_sessions(ticks: DataFrame, gap: str = "5 minutes", late: str = "2 minutes") -> DataFrame:
    """(symbol, start_ms, end_ms, quotes, low, high) of stretches of quotes without a pause of ``gap``; final once the watermark passes their end."""
    made = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("quotes"), F.min("price").alias("low"), F.max("price").alias("high"))
    return made.select("symbol", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "quotes", "low", "high")
