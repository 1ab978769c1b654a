"""Market files, clocks and artifacts."""

import pytest
from candlewick.functions import clock
from candlewick.operators import bars as B
from candlewick.sources import artifacts, text
from candlewick.streaming.bars import stream_bars
from pyspark.sql import functions as F


def test_bars_round_trip(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n2024.01.08\t00:15:00\t1.1\t1.2\t1.0\t1.15\t5\t0\t7\n2024.01.08\t00:00:00\t1\t2\t0.5\t1.5\t3\t0\t\n2024.01.08\t00:15:00\t9\t9\t9\t9\t1\t0\t2\nbad\t00:30:00\t1\t1\t1\t1\t1\t1\t1\n2024.01.08\t00:45:00\tnan\t1\t1\t1\t1\t1\t1\n")
    bars, rejects = text.read_bars(spark, str(p), "EURUSD")
    rows = sorted(map(tuple, bars.select("ts_ms", "open", "close", "tick_volume", "spread_points").collect()))
    assert rows == [(1704672000000, 1.0, 1.5, 3, None), (1704672900000, 9.0, 9.0, 1, 2)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["price", "time"]
    text.write_bars(bars, str(tmp_path / "out"))
    again, none = text.read_bars(spark, str(tmp_path / "out"), "EURUSD")
    assert again.count() == 2 and none.count() == 0
    with pytest.raises(Exception):
        text.write_bars(bars, str(tmp_path / "out"))


def test_delimiters_headers_kinds():
    assert [text.delimiter(x) for x in ("a\tb,c\td", "a,b;c", "x")] == ["\t", ";", ";"]
    assert text.header_name(" <Tick-Vol> ") == "TICK_VOL"
    assert [text.classify(x) for x in ("time,ask,bid", "RTYPE,PUBLISHER_ID,open,high,low,close", "DATE;TIME;OPEN;HIGH;LOW;CLOSE", "2024.01.02,00:00,1,1,1,1", "zzz")] == ["tick", "unsupported", "bars", "headerless", "unknown"]


def test_daylight_saving(spark):
    rows = [("2024-03-10 02:30:00",), ("2024-11-03 01:30:00",), ("2024-06-01 12:00:00",)]
    t = spark.createDataFrame(rows, "w string").select(F.col("w").cast("timestamp_ntz").alias("w"))
    strict = [r[0] for r in t.select(clock.to_utc(F.col("w"), "America/New_York")).collect()]
    assert strict[:2] == [None, None] and strict[2] == 1717257600000
    mapped = [r[0] for r in t.select(clock.to_utc_mapped(F.col("w"), "America/New_York")).collect()]
    assert mapped == [1710055800000, 1730611800000, 1717257600000]
    shown = spark.range(1).select(clock.shown(clock.local(F.lit(1717257600000), clock.NEW_YORK_CLOSE))).first()[0]
    assert shown == "2024.06.01 19:00:00"


def test_ticks_headerless_and_folder(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "t.csv").write_text("time,ask,bid\n2024-01-02 00:00:01,1.2,1.0\n2024-01-02 00:00:59,1.4,1.2\n2024-01-02 00:01:00,x,1\n")
    (d / "sub" / "h.csv").write_text("2024.01.02,00:00,1,2,0.5,1.5,7\n2024.01.02,00:01,1,2,0.5,1.5,7\n")
    bars = B.ticks_to_bars(text.read_ticks(spark, str(d / "t.csv"), "X").drop("volume").withColumn("volume", F.lit(1))).collect()
    assert [(b["open"], b["close"], b["tick_volume"]) for b in bars] == [(1.1, pytest.approx(1.3), 2)]
    assert text.read_headerless(spark, str(d / "sub" / "h.csv"), "X").count() == 2
    assert sorted(r["kind"] for r in text.scan_folder(spark, str(d)).collect()) == ["headerless", "tick"]


def test_deals_properties_reports(spark, tmp_path):
    (tmp_path / "d.csv").write_text("deal_ticket,position_id,timestamp_ms,deal_type,deal_entry,price,volume,profit,commission,swap,fee\n2,1,20,SELL,OUT,2,1,1,0,0,0\n1,1,10,BUY,IN,1,1,0,-0.1,0,0\n")
    assert [r["deal_ticket"] for r in text.read_deals(spark, str(tmp_path / "d.csv")).collect()] == [1, 2]
    (tmp_path / "m.csv").write_text("property,value\nbar_count,2\ntimeframe,M15\n")
    assert text.read_properties(spark, str(tmp_path / "m.csv")) == {"bar_count": "2", "timeframe": "M15"}
    pages = spark.createDataFrame([("p", "<tr><td>Total Net Profit:</td><td><b>1 234.50</b></td></tr>")], "path string, text string")
    assert text.report_fields(pages, ["Total Net Profit:"]).first()[1] == 1234.5


def test_artifacts(tmp_path):
    artifacts.write_new(tmp_path / "a.json", {"x": 1})
    with pytest.raises(FileExistsError):
        artifacts.write_new(tmp_path / "a.json", {})
    assert artifacts.write_versioned(tmp_path / "a.json", {"x": 2}).exists()
    artifacts.write_folder(tmp_path / "f", {"in/b.txt": "hi"})
    assert (tmp_path / "f/in/b.txt").read_text() == "hi"
    with pytest.raises(ValueError):
        artifacts.write_folder(tmp_path / "g", {"../b": ""})
    vault = artifacts.Vault(tmp_path / "v", openings=1)
    vault.open_sealed("p", "a")
    with pytest.raises(PermissionError):
        vault.open_sealed("p", "b")
    assert artifacts.identity({"a": 1, "b": 2}) == artifacts.identity({"b": 2, "a": 1})


def test_stream_equals_batch(spark, tmp_path):
    rows = [("X", i * 7000, float(i % 13), 1, i) for i in range(100)]
    batch = spark.createDataFrame(rows, "symbol string, ts_ms long, price double, volume long, seq long")
    batch.withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("symbol string, ts_ms long, price double, volume long, seq long, ts timestamp").parquet(str(tmp_path / "in"))
    q = stream_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    columns = ["symbol", "ts_ms", "open", "high", "low", "close", "tick_volume"]
    assert sorted(map(tuple, spark.table("bars_out").select(columns).collect())) == sorted(map(tuple, B.ticks_to_bars(batch).select(columns).collect()))
