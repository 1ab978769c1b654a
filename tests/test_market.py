"""A folder of market files in mixed dialects and encodings, with rejects that can be found again."""

import zipfile

from candlewick.sources import market
from pyspark.sql import functions as F

HEAD = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<SPREAD>"


def test_mixed_folder(spark, tmp_path):
    d = tmp_path / "in"
    (d / "EUR").mkdir(parents=True)
    (d / "USD").mkdir()
    (d / "EUR" / "a.tsv").write_text(f"{HEAD}\n2024.01.08\t00:00:00\t1\t2\t0.5\t1.5\t3\t7\n\n2024.01.08\t00:15:00\t1\tx\t0.5\t1.5\t3\t7\n2024.01.99\t00:15:00\t1\t2\t0.5\t1.5\t3\t7\n2024.01.08\t00:30:00\t1\t2\t0.5\t1.5\tmany\t7\n")
    (d / "EUR" / "b.csv").write_bytes("﻿close,open,high,low,timestamp,volume\r\n9,8,10,7,1704672000,4\r\n1,1,1,1,1704675600000,\r\n".encode())
    (d / "USD" / "c.txt").write_bytes("DATETIME;OPEN;HIGH;LOW;CLOSE\n2024-01-08 00:00:00;1;2;0.5;1.5\n2024-01-08 01:00:00;1;2;bad;1.5\n".encode("utf-16"))
    (d / "USD" / "d.csv").write_text("2024.01.09,00:00,1,2,0.5,1.5,7\n20240109 ,00:01,1,2,0.5,1.5,7\n")
    (d / "USD" / "t.csv").write_text("time,ask,bid\n2024-01-02 00:00:01,1.2,1.0\n")
    (d / "USD" / "u.csv").write_text("rtype,publisher_id,open,high,low,close\n1,1,1,1,1,1\n")
    with zipfile.ZipFile(d / "USD" / "z.zip", "w") as z:
        z.writestr("in/e.csv", "date,time,open,high,low,close\n2024-01-10,00:00:00,5,6,4,5\n2024-01-10,00:01:00,5,6,4,?\n")
        z.writestr("f.csv", "zzz\n")
    bars, rejects, files = market.read_folder(spark, str(d), F.regexp_extract("file", "/(EUR|USD)/", 1))
    got = {(r["symbol"], r["ts_ms"]): (r["open"], r["close"], r["tick_volume"], r["real_volume"], r["spread_points"]) for r in bars.collect()}
    day = 86_400_000
    t0 = 1_704_672_000_000
    assert got == {
        ("EUR", t0): (8.0, 9.0, 0, 4, None), ("EUR", t0 + 3_600_000): (1.0, 1.0, 0, 0, None),
        ("USD", t0): (1.0, 1.5, 0, 0, None), ("USD", t0 + day): (1.0, 1.5, 7, 0, None), ("USD", t0 + day + 60_000): (1.0, 1.5, 7, 0, None),
        ("USD", t0 + 2 * day): (5.0, 5.0, 0, 0, None),
    }
    where = lambda f: f.split("/in/", 1)[1]
    assert sorted((where(r["file"]), r["line"], r["reason"]) for r in rejects.collect()) == [("EUR/a.tsv", 4, "price"), ("EUR/a.tsv", 5, "time"), ("EUR/a.tsv", 6, "volume"), ("USD/c.txt", 3, "price"), ("USD/z.zip!in/e.csv", 3, "price")]
    assert {where(r["file"]): (r["kind"], r["lines"], r["taken"], r["rejected"]) for r in files.collect()} == {
        "EUR/a.tsv": ("bars", 4, 1, 3), "EUR/b.csv": ("bars", 2, 2, 0), "USD/c.txt": ("bars", 2, 1, 1), "USD/d.csv": ("headerless", 2, 2, 0),
        "USD/t.csv": ("tick", 0, 0, 0), "USD/u.csv": ("unsupported", 0, 0, 0), "USD/z.zip!in/e.csv": ("bars", 2, 1, 1), "USD/z.zip!f.csv": ("unknown", 0, 0, 0),
    }


def test_line_numbers_over_splits_of_a_file(spark, tmp_path):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = ["date,time,open,high,low,close", *[f"2024.01.{1 + i // 1440:02d},{i // 60 % 24:02d}:{i % 60:02d},{'x' if i % 97 == 5 else i},1,1,1" for i in range(1500)]]
        (tmp_path / "long.csv").write_text("\n".join(lines) + "\n")
        _, rejects, files = market.read_folder(spark, str(tmp_path), F.lit("L"))
        assert sorted(r["line"] for r in rejects.collect()) == [i + 2 for i in range(1500) if i % 97 == 5]
        assert files.first()["taken"] == 1500 - sum(i % 97 == 5 for i in range(1500))
        assert market.folder_lines(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
