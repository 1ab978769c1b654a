"""Import of a folder of market files in mixed dialects, as one distributed scan.

Lines carry their file and exact number (splits of a file are counted, and what comes before a split is added), so that a
reject can be found again. A file's first line settles its dialect in a table of one row a file; every line is then cut
and parsed by column expressions with its file's dialect. UTF-16 files and members of zip files are read as whole files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import lookup
from .text import ALIASES, last_wins, number, stamp

_LINES = "file string, line long, text string"


def folder_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of all files below a folder, blank lines left out; lines count from 1. Members of zip files are file!member."""
    named = spark.read.option("recursiveFileLookup", "true")
    raw = named.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    zipped = F.lower("file").endswith(".zip")
    splits = raw.where(~zipped).groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_lines"), F.min_by("value", "_at").alias("_head"))  # one row a split
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumn("_shift", before - F.col("_first") + 1)
    utf16 = starts.where((F.col("_block") == 0) & F.substring(F.hex("_head"), 1, 4).isin("FFFE", "FEFF")).select("file").distinct()
    marked = lookup(raw.where(~zipped), starts.select("file", "_block", "_shift"), ["file", "_block"])
    plain = marked.join(utf16, "file", "left_anti").select("file", (F.col("_at") + F.col("_shift")).alias("line"), F.col("value").alias("text"))
    whole = named.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    decoded = whole.join(utf16, "file", "left_semi").select("file", F.posexplode(F.split(F.decode("content", "UTF-16"), "\r?\n")).alias("_i", "text")).select("file", (F.col("_i") + 1).cast("long").alias("line"), "text")
    members = whole.where(F.lower("file").endswith(".zip")).mapInArrow(_members, _LINES)
    tidy = F.regexp_replace("text", "^﻿|\r$", "")
    return plain.unionByName(decoded).unionByName(members).select("file", "line", tidy.alias("text")).where(F.trim("text") != "")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in sorted(m for m in archive.namelist() if not m.endswith("/")):
                    with archive.open(member) as f:
                        encoding = "utf-16" if f.peek(2)[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"
                        lines, held = io.TextIOWrapper(f, encoding, errors="replace"), []
                        for number_, text in enumerate(lines, 1):
                            held.append((f"{file}!{member}", number_, text.rstrip("\n")))
                            if len(held) == 4096:
                                yield pa.RecordBatch.from_pylist([dict(zip(("file", "line", "text"), h, strict=True)) for h in held])
                                held = []
                        if held:
                            yield pa.RecordBatch.from_pylist([dict(zip(("file", "line", "text"), h, strict=True)) for h in held])


def dialects(lines: DataFrame) -> DataFrame:
    """(file, head_line, kind, separator, names) by each file's first line: unsupported, tick, bars, headerless or unknown.

    The separator is the most frequent of tab, comma and semicolon, the later one of equals; names are normalised.
    """
    heads = lines.groupBy("file").agg(F.min("line").alias("head_line"), F.min_by("text", "line").alias("head"))
    counts = [F.struct(F.char_length("head") - F.char_length(F.replace("head", F.lit(s))), F.lit(i), F.lit(s).alias("s")) for i, s in enumerate("\t,;")]
    cut = heads.withColumn("separator", F.greatest(*counts)["s"])
    clean = lambda n: F.upper(F.regexp_replace(F.regexp_replace(F.trim(n), "^<+|>+$", ""), "[ -]", "_"))
    named = cut.withColumn("names", F.transform(F.split("head", F.concat(F.lit("["), F.col("separator"), F.lit("]"))), clean))
    has = lambda *n: reduce(lambda a, b: a & b, [F.array_contains("names", x) for x in n])
    kind = F.when(has("RTYPE", "PUBLISHER_ID"), "unsupported").when(has("ASK", "BID"), "tick").when(has("OPEN", "HIGH", "LOW", "CLOSE"), "bars")
    headerless = F.col("head").rlike(r"^\d{4}[.\-/]?\d\d[.\-/]?\d\d[\t,; ]")
    implied = F.array(*[F.lit(x) for x in ("DATE", "TIME", "OPEN", "HIGH", "LOW", "CLOSE", "TICK_VOLUME")])
    return named.select("file", "head_line", kind.when(headerless, "headerless").otherwise("unknown").alias("kind"), "separator", F.when(kind.isNull() & headerless, implied).otherwise(F.col("names")).alias("names"))


def read_folder(spark: SparkSession, path: str, symbol: Column, zone: str = "Etc/UTC") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, rejects, files) of all bar files below a folder, with or without a header; ``symbol`` is made of the column file.

    Of lines of one symbol and time the last wins, by file and line. Volumes default to 0 and the spread to NULL; what is
    there and does not parse makes the line a reject. rejects have file, line, reason (time, price or volume) and text; files have
    file, kind, lines read, lines taken and rejected. Files of other kinds are in ``files`` only.
    """
    lines = folder_lines(spark, path)
    known = dialects(lines)
    told = lookup(lines, known, ["file"])
    body = told.where(F.col("kind").isin("bars", "headerless") & ((F.col("line") > F.col("head_line")) | (F.col("kind") == "headerless")))
    cells = body.withColumn("_cells", F.split("text", F.concat(F.lit("["), F.col("separator"), F.lit("]"))))

    def cell(*names: str) -> Column:
        at = [F.nullif(F.array_position("names", n), F.lit(0)) for n in names]
        return F.trim(F.get(F.col("_cells"), (F.coalesce(*at) - 1).cast("int")))

    given = lambda c: c.isNotNull() & (c != "")
    when = F.when(given(cell("DATE")) & given(cell("TIME")), F.concat_ws(" ", cell("DATE"), cell("TIME"))).otherwise(F.coalesce(cell(*ALIASES["STAMP"]), cell("TIME"), cell("DATE")))
    optional = {"tick_volume": ("TICK_VOLUME", "long"), "real_volume": ("REAL_VOLUME", "long"), "spread_points": ("SPREAD", "int")}
    made = cells.select("file", "line", "text", symbol.alias("symbol"), F.element_at(F.transform(F.array(F.regexp_replace(when, r"^(\d{4})(\d\d)(\d\d)( |$)", "$1.$2.$3$4")), lambda t: stamp(t, zone)), 1).alias("ts_ms"), *[number(cell(c)).alias(c.lower()) for c in ("OPEN", "HIGH", "LOW", "CLOSE")],
        *[number(cell(*ALIASES[a]), k).alias(n) for n, (a, k) in optional.items()], *[given(cell(*ALIASES[a])).alias(f"_{n}") for n, (a, _) in optional.items()])
    priced = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("open", "high", "low", "close")])
    sound = reduce(lambda a, b: a & b, [F.col(n).isNotNull() | ~F.coalesce(F.col(f"_{n}"), F.lit(False)) for n in optional])
    reason = F.when(F.col("ts_ms").isNull(), "time").when(~priced, "price").when(~sound, "volume")
    judged = made.withColumn("reason", reason)
    taken = judged.where("reason is null").withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("tick_volume", "real_volume")})
    bars = last_wins(taken.select("symbol", "ts_ms", "open", "high", "low", "close", *optional, F.struct("file", "line").alias("_order")), ["symbol", "ts_ms"], "_order")
    counts = judged.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("taken"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    files = lookup(known.select("file", "kind"), counts, ["file"]).na.fill(0, ["lines", "taken", "rejected"])
    return bars, judged.where("reason is not null").select("file", "line", "reason", "text"), files


#: Dialects that write_dialects() deals symbols to: separator, header or not, and whether times are in one column.
DIALECTS = (("\t", True, "yyyy.MM.dd"), (",", True, None), (";", True, "yyyy/MM/dd"), (",", False, "yyyy.MM.dd"))


def write_dialects(bars: DataFrame, path: str) -> None:
    """Bars as text files in all of DIALECTS below a folder, each symbol in one of them, in folders symbol=<symbol>; columns are text already if they shall not parse."""
    wall = F.timestamp_millis(F.col("ts_ms")).cast("timestamp_ntz")
    for i, (separator, header, day) in enumerate(DIALECTS):
        when = [F.date_format(wall, "yyyy-MM-dd HH:mm:ss").alias("DateTime")] if day is None else [F.date_format(wall, day).alias("<DATE>"), F.date_format(wall, "HH:mm:ss").alias("<TIME>")]
        prices = [F.col(c).alias(f"<{c.upper()}>" if i == 0 else c.title()) for c in ("open", "high", "low", "close")]
        volume = F.col("tick_volume").alias("<TICKVOL>" if i == 0 else "Tick Volume")
        mine = bars.where(F.pmod(F.crc32("symbol"), F.lit(len(DIALECTS))) == i)
        mine.select("symbol", *([*when, *prices] if i != 1 else [*prices, *when]), volume).write.partitionBy("symbol").csv(f"{path}/dialect{i}", sep=separator, header=header, mode="overwrite")
