"""Long series in blocks: numbering, running values, trailing frames and linear recurrences of keys of any length.

A window over one key puts all of its rows into one task. Here rows are range-sorted and written once with their place,
which numbers them within their key by a table of one row a range and key; blocks of equal numbers of rows are then
scanned each on its own, and what a block takes over from those before it comes from a table of one row a block. A
task holds a block (and the edge that a trailing frame needs), however long a series is. NULL keys are keys of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import Scratch

#: Rows of a block.
BLOCK = 65_536
#: Rows of a table of ranges or blocks that is broadcast at most; a larger one is joined by key and block.
SMALL = 100_000


def lookup(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of ``small`` (one row for each value of keys), broadcast only if counted to be small."""
    few = small.limit(SMALL + 1).count() <= SMALL
    right = small.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return rows.join(F.broadcast(right) if few else right, on, "left").drop(*[f"_right_{k}" for k in keys])


def numbered(rows: DataFrame, keys: list[str], order: list, scratch: Scratch) -> DataFrame:
    """rows with _n: their number from 0 within keys, in ``order`` (columns or sort expressions).

    One range shuffle, whatever the keys' sizes; equal rows are numbered in any order. The sorted rows are written
    once, so that all who read them see the same numbers.
    """
    sorts = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    placed = scratch.cut(rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()))
    ranges = placed.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.cut(ranges.select(*keys, "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")))
    return lookup(placed, starts, [*keys, "_range"]).withColumn("_n", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def running(rows: DataFrame, keys: list[str], made: dict[str, tuple[str, Column]], size: int = BLOCK) -> DataFrame:
    """Numbered rows with running values up to and with each row: name -> (sum, count, max, min or last, column).

    NULLs do not count, as in SQL; ``last`` is the latest value that is there. Sums of decimals and longs are exact; sums of
    doubles add a block's own sum to that of the blocks before it.
    """
    block = F.expr(f"_n div {size}")
    temp = {name: f"_v{i}" for i, name in enumerate(made)}
    held = rows.withColumns({temp[n]: c for n, (_, c) in made.items()}).withColumn("_block", block)
    plain = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    whole = lambda kind, c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_n"))) if kind == "last" else plain[kind](c)
    blocks = held.groupBy(*keys, "_block").agg(*[whole(kind, temp[n]).alias(temp[n]) for n, (kind, _) in made.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    over = lambda kind, c, w: F.last(c, ignorenulls=True).over(w) if kind == "last" else plain["sum" if kind == "count" else kind](c).over(w)
    carried = blocks.select(*keys, "_block", *[over(kind, temp[n], earlier).alias(f"{temp[n]}c") for n, (kind, _) in made.items()])
    inside = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    scanned = lookup(held, carried, [*keys, "_block"])

    def value(name: str, kind: str) -> Column:
        local = plain["count"](temp[name]).over(inside) if kind == "count" else over(kind, temp[name], inside)
        carry = F.col(f"{temp[name]}c")
        if kind in ("sum", "count"):
            return F.coalesce(carry + local, local, carry)
        return F.coalesce(local, carry) if kind == "last" else (F.greatest if kind == "max" else F.least)(local, carry)

    out = scanned.withColumns({n: value(n, kind) for n, (kind, _) in made.items()})
    return out.drop("_block", *temp.values(), *[f"{t}c" for t in temp.values()])


def framed(rows: DataFrame, key: str, edge: int, build: Callable[[DataFrame], DataFrame], size: int = BLOCK) -> DataFrame:
    """What ``build`` makes of numbered rows with window columns over ``key`` that look at most ``edge`` rows back.

    build sees frames in which ``key`` also tells the block, each block led by the ``edge`` rows before it, and returns
    them with more columns; so window expressions over ``key`` serve here as they are. Rows of the lead are left out again.
    """
    size = max(size, edge, 1)
    own = F.expr(f"_n div {size}")
    leads = F.col("_n") % size >= size - edge
    dealt = rows.withColumn("_block", F.explode(F.when(leads, F.array(own, own + 1)).otherwise(F.array(own))))
    made = build(dealt.withColumn("_key", F.col(key)).withColumn(key, F.struct(F.col(key).alias("key"), F.col("_block").alias("block"))))
    return made.where(F.col("_block") == F.expr(f"_n div {size}")).withColumn(key, F.col("_key")).drop("_key", "_block")


def before(rows: DataFrame, keys: list[str], made: dict[str, str], size: int = BLOCK) -> DataFrame:
    """Numbered rows with the value that a column had one row before: name -> column; NULL in a key's first row."""
    own = F.expr(f"_n div {size}")
    last = rows.where(F.col("_n") % size == size - 1).select(*keys, (own + 1).alias("_block"), *[F.col(c).alias(f"_last_{n}") for n, c in made.items()])  # one row a block
    inside = Window.partitionBy(*keys, "_block").orderBy("_n")
    led = lookup(rows.withColumn("_block", own), last, [*keys, "_block"])
    first = F.col("_n") % size == 0
    return led.withColumns({n: F.when(first, F.col(f"_last_{n}")).otherwise(F.lag(c).over(inside)) for n, c in made.items()}).drop("_block", *[f"_last_{n}" for n in made])


def prefix_maps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For maps y -> a*y + b applied one after the other: factor and offset of the first i together.

    Offsets are added row by row, so that from 0 on they are bit by bit what a loop gives.
    """
    y, q = 0.0, []
    for factor, offset in zip(a.tolist(), b.tolist(), strict=True):
        y = factor * y + offset
        q.append(y)
    return np.multiply.accumulate(a), np.array(q)


def affine(rows: DataFrame, keys: list[str], made: dict[str, tuple[Column, Column]], scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """Numbered rows with y = a*y + b carried from row to row: name -> (a, b); y is 0 before a key's first row.

    A NULL among a and b leaves y as it is. Maps compose associatively: one pass makes each block's prefix maps as arrays
    and writes them; the last of each block, composed in order of the blocks, is what the next ones start from.
    A key's first block is bit by bit what a row-by-row loop gives; later ones differ from it in their last digits only.
    """
    names = list(made)
    known = {n: a.isNotNull() & b.isNotNull() for n, (a, b) in made.items()}
    maps = {f"_a{i}": F.when(known[n], made[n][0]).otherwise(1.0).cast("double") for i, n in enumerate(names)} | {f"_b{i}": F.when(known[n], made[n][1]).otherwise(0.0).cast("double") for i, n in enumerate(names)}
    held = rows.withColumns(maps).withColumn("_block", F.expr(f"_n div {size}"))
    schema = held.schema
    at = held.columns.index

    def fold(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_n")  # one block: ``size`` rows at most
        for i in range(len(names)):
            a, b = (table.column(f"_{c}{i}").to_numpy() for c in "ab")
            with np.errstate(all="ignore"):
                p, q = prefix_maps(a.astype(float), b.astype(float))
            table = table.set_column(at(f"_a{i}"), f"_a{i}", pa.array(p)).set_column(at(f"_b{i}"), f"_b{i}", pa.array(q))
        return table

    folded = scratch.cut(held.groupBy(*keys, "_block").applyInArrow(fold, schema))
    ends = folded.groupBy(*keys, "_block").agg(F.max_by(F.struct(*maps), "_n").alias("_m"))
    listed = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", "_m"))).alias("_l"))  # one entry a block

    def starts(i: int) -> Column:
        grow = lambda acc, e: F.struct((e["_m"][f"_a{i}"] * acc["y"] + e["_m"][f"_b{i}"]).alias("y"), F.concat(acc["out"], F.array(acc["y"])).alias("out"))
        return F.aggregate("_l", F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("out")), grow, lambda acc: acc["out"])

    zipped = listed.select(*keys, "_l", *[starts(i).alias(f"_y{i}") for i in range(len(names))]).select(*keys, F.posexplode("_l").alias("_i", "_e"), *[f"_y{i}" for i in range(len(names))])
    carried = scratch.cut(zipped.select(*keys, F.col("_e._block").alias("_block"), *[F.get(F.col(f"_y{i}"), F.col("_i")).alias(f"_c{i}") for i in range(len(names))]))
    joined = lookup(folded, carried, [*keys, "_block"])
    return joined.withColumns({n: F.col(f"_a{i}") * F.col(f"_c{i}") + F.col(f"_b{i}") for i, n in enumerate(names)}).drop("_block", *maps, *[f"_c{i}" for i in range(len(names))])
