"""Delimited market files as DataFrames: delimiter and header are settled once on the driver, all rows by Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock

#: Column names that mean the same, and formats of local times.
ALIASES = {
    "STAMP": ("DATETIME", "TIMESTAMP", "DATE_TIME"),
    "TICK_VOLUME": ("TICKVOL", "TICK_VOLUME", "TICKVOLUME"),
    "REAL_VOLUME": ("VOL", "VOLUME", "REAL_VOLUME", "REALVOLUME"),
    "SPREAD": ("SPREAD", "SPREAD_POINTS"),
}
FORMATS = ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss")


def first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return rows[0]["value"].lstrip("﻿") if rows else ""


def delimiter(line: str) -> str:
    """The most frequent of tab, comma and semicolon; the later one of equals."""
    return max(enumerate("\t,;"), key=lambda x: (line.count(x[1]), x[0]))[1]


def header_name(name: str) -> str:
    return re.sub(r"[ -]", "_", name.strip().strip("<>").strip()).upper()


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings under normalised names."""
    line = first_line(spark, path)
    sep = delimiter(line)
    names = [header_name(x) for x in line.split(sep)]
    return spark.read.csv(path, sep=sep, header=True, schema=", ".join(f"`{n}` string" for n in names), enforceSchema=True)


def number(col: Column, kind: str = "double") -> Column:
    """Strict and finite, else NULL."""
    value = F.trim(col).try_cast(kind)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value) if kind == "double" else value


def stamp(text: Column, zone: str, mapped: bool = False) -> Column:
    """Epoch milliseconds of epoch seconds (below 1e10) or milliseconds, RFC 3339, or local times in FORMATS; NULL if none fits, or if the local time does not exist just once."""
    text = F.trim(text)
    epoch = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    local = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in FORMATS])
    aware = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$"), F.unix_millis(F.try_to_timestamp(text)))
    there = (clock.to_utc_mapped if mapped else clock.to_utc)(local, zone)
    return F.coalesce(F.when(epoch < 10_000_000_000, epoch * 1000).otherwise(epoch), aware, there)


def _pick(names: list[str], key: str) -> Column:
    found = [n for n in ALIASES[key] if n in names]
    return F.col(found[0]) if found else F.lit(None).cast("string")


def read_bars(spark: SparkSession, path: str, symbol: str, zone: str = "Etc/UTC") -> tuple[DataFrame, DataFrame]:
    """(bars, rejects): the last of rows with one time wins; rows that do not parse are rejects with their line and reason.

    Volumes default to 0 and the spread to NULL. The line number follows Spark's order of the file's rows.
    """
    raw = read_raw(spark, path).withColumn("_line", F.monotonically_increasing_id())
    names = raw.columns
    when = _pick(names, "STAMP") if not {"DATE", "TIME"} <= set(names) else F.concat_ws(" ", F.trim("DATE"), F.trim("TIME"))
    parsed = raw.select(
        F.lit(symbol).alias("symbol"), stamp(when, zone).alias("ts_ms"), *[number(F.col(c)).alias(c.lower()) for c in ("OPEN", "HIGH", "LOW", "CLOSE")],
        F.coalesce(number(_pick(names, "TICK_VOLUME"), "long"), F.lit(0).cast("long")).alias("tick_volume"), F.coalesce(number(_pick(names, "REAL_VOLUME"), "long"), F.lit(0).cast("long")).alias("real_volume"),
        number(_pick(names, "SPREAD"), "int").alias("spread_points"), "_line",
    )
    whole = F.col("ts_ms").isNotNull() & F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    rejects = parsed.where(~whole).select(F.col("_line").alias("line"), F.when(F.col("ts_ms").isNull(), "time").otherwise("price").alias("reason"))
    return last_wins(parsed.where(whole), ["symbol", "ts_ms"], "_line"), rejects


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last in ``order``: a partial maximum, not a window."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def read_ticks(spark: SparkSession, path: str, symbol: str, zone: str = "Etc/UTC") -> DataFrame:
    """Quotes of a file with ASK and BID; rows with a local time that does not exist once are skipped, volume is 1 by default."""
    raw = read_raw(spark, path)
    if not {"ASK", "BID"} <= set(raw.columns):
        raise ValueError("a tick file has ASK and BID columns")
    names = raw.columns
    when = F.concat_ws(" ", F.trim("DATE"), F.trim("TIME")) if "DATE" in names else F.col("TIME") if "TIME" in names else _pick(names, "STAMP")
    volume = F.coalesce(number(F.col("VOLUME")), F.lit(1.0)) if "VOLUME" in names else F.lit(1.0)
    out = raw.select(F.lit(symbol).alias("symbol"), stamp(when, zone).alias("ts_ms"), number(F.col("ASK")).alias("ask"), number(F.col("BID")).alias("bid"), volume.alias("volume"), F.monotonically_increasing_id().alias("seq"))
    return out.where("ts_ms is not null and ask is not null and bid is not null").withColumn("price", (F.col("ask") + F.col("bid")) / 2)


def read_headerless(spark: SparkSession, path: str, symbol: str, zone: str = "Etc/UTC") -> DataFrame:
    """Bars of date, time, open, high, low, close and perhaps volume, without a header."""
    line = first_line(spark, path)
    sep = delimiter(line)
    names = ["DATE", "TIME", "OPEN", "HIGH", "LOW", "CLOSE", "VOLUME"][: max(6, min(7, len(line.split(sep))))]
    raw = spark.read.csv(path, sep=sep, schema=", ".join(f"{n} string" for n in names))
    volume = F.coalesce(number(F.col("VOLUME"), "long"), F.lit(0).cast("long")) if "VOLUME" in names else F.lit(0).cast("long")
    rows = raw.select(F.lit(symbol).alias("symbol"), stamp(F.concat_ws(" ", "DATE", "TIME"), zone).alias("ts_ms"), *[number(F.col(c)).alias(c.lower()) for c in ("OPEN", "HIGH", "LOW", "CLOSE")], volume.alias("tick_volume"), F.monotonically_increasing_id().alias("_line"))
    return last_wins(rows.where("ts_ms is not null and open is not null and close is not null"), ["symbol", "ts_ms"], "_line")


def classify(line: str) -> str:
    """Kind of a market file by its first line: unsupported, tick, bars, headerless or unknown."""
    names = {header_name(x) for x in line.split(delimiter(line))}
    if {"RTYPE", "PUBLISHER_ID"} <= names:
        return "unsupported"
    if {"ASK", "BID"} <= names:
        return "tick"
    if {"OPEN", "HIGH", "LOW", "CLOSE"} <= names:
        return "bars"
    return "headerless" if re.match(r"^\d{4}[.\-/]?\d\d[.\-/]?\d\d[\t,; ]", line) else "unknown"


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of every file below a folder, by its first line; one small row a file."""
    first = spark.read.option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("n"), "value").where(F.trim("value") != "")
    lines = first.groupBy("path").agg(F.min_by("value", "n").alias("line"))
    kind = F.udf(classify)  # one call a file
    return lines.select("path", kind("line").alias("kind"))


def read_properties(spark: SparkSession, path: str) -> dict[str, str]:
    """A property,value file as a map; a property that comes twice is an error."""
    rows = read_raw(spark, path).select(F.trim("PROPERTY").alias("k"), F.trim("VALUE").alias("v")).collect()
    out = {r["k"]: r["v"] for r in rows}
    if len(out) != len(rows):
        raise ValueError("a property comes twice")
    return out


def validate_metadata(properties: dict[str, str], bars: DataFrame, interval_ms: int | None) -> list[str]:
    """What of bar count and timeframe does not fit the bars."""
    from ..operators.bars import TIMEFRAMES

    found = []
    if "bar_count" in properties and int(properties["bar_count"]) != bars.count():
        found.append("bar_count")
    if "timeframe" in properties and interval_ms is not None and TIMEFRAMES.get(properties["timeframe"].removeprefix("PERIOD_")) != interval_ms:
        found.append("timeframe")
    return found


_DEALS = {"deal_ticket": "long", "position_id": "long", "timestamp_ms": "long", "deal_type": "string", "deal_entry": "string", "price": "double", "volume": "double", "profit": "double", "commission": "double", "swap": "double", "fee": "double"}
_EQUITY = {"timestamp_ms": "long", "balance": "double", "equity": "double"}


def _typed(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    raw = read_raw(spark, path)
    return raw.select(*[(F.trim(n.upper()) if k == "string" else F.coalesce(number(F.col(n.upper()), k), F.lit(None).cast(k))).alias(n) if n.upper() in raw.columns else F.lit(0.0).alias(n) for n, k in kinds.items()])


def read_deals(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, _DEALS).orderBy("timestamp_ms", "deal_ticket")


def read_equity(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, _EQUITY).orderBy("timestamp_ms")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Indicator reference rows: numbers where a column holds numbers, strings for what describes the run."""
    raw = read_raw(spark, path)
    text = {"SERVER_TIME", "TERMINAL_BUILD", "BROKER", "SERVER", "SYMBOL", "TIMEFRAME"}
    return raw.select(*[(F.trim(c) if c in text else number(F.col(c), "long" if c == "TIMESTAMP_MS" else "double")).alias(c.lower()) for c in raw.columns])


def write_bars(bars: DataFrame, path: str, zone: str = "Etc/UTC", mode: str = "errorifexists") -> None:
    """Canonical nine columns in local time, tab separated; an unknown spread is written as 0."""
    wall = clock.local(F.col("ts_ms"), zone)
    columns = [F.date_format(wall, "yyyy.MM.dd").alias("<DATE>"), F.date_format(wall, "HH:mm:ss").alias("<TIME>"), *[F.col(c.lower()).alias(f"<{c}>") for c in ("OPEN", "HIGH", "LOW", "CLOSE")]]
    columns += [F.col("tick_volume").alias("<TICKVOL>"), F.col("real_volume").alias("<VOL>"), F.coalesce("spread_points", F.lit(0)).alias("<SPREAD>")]
    bars.repartitionByRange("ts_ms").sortWithinPartitions("ts_ms").select(*columns).write.csv(path, sep="\t", header=True, mode=mode)


def report_fields(pages: DataFrame, labels: list[str], text: str = "text") -> DataFrame:
    """Numbers beside labels in tables of HTML reports: the first number after each label's cell."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"<[^>]*>", "\u0001"), r"\u0001+\s*\u0001*", "\u0001")
    pick = lambda label: F.regexp_replace(F.regexp_extract(plain, re.escape(label) + "\u0001([-0-9 .,]+)", 1), r"[ , ]", "").try_cast("double")
    return pages.select("path", *[pick(label).alias(re.sub(r"\W+", "_", label).strip("_").lower()) for label in labels])
