"""Joins of time series: intervals, windows of the week, as-of, and one-to-one nearest matches."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch
from .series import BLOCK, before, lookup, numbered, running

#: Partitions of one-to-one matches at least.
_PIECES = 256


def interval_join(decisions: DataFrame, minutes: DataFrame, interval: int) -> DataFrame:
    """Each decision bar (open time on any grid) with the finer rows in [ts, ts + interval); finer columns get the prefix m_.

    An equi-join on the interval's number: a finer row is looked up in its own and the one before, and then compared.
    """
    left = decisions.withColumn("_key", F.expr(f"ts_ms div {interval}"))
    fine = minutes.select(F.col("symbol"), *[F.col(c).alias(f"m_{c}") for c in minutes.columns if c != "symbol"])
    right = fine.withColumn("_key", F.explode(F.array(F.expr(f"m_ts_ms div {interval}"), F.expr(f"m_ts_ms div {interval}") - 1)))
    return left.join(right, ["symbol", "_key"]).where((F.col("m_ts_ms") >= F.col("ts_ms")) & (F.col("m_ts_ms") < F.col("ts_ms") + interval)).drop("_key")


def missing_minutes(decisions: DataFrame, minutes: DataFrame, interval: int) -> DataFrame:
    """Decision bars without any finer row: a replay on both would be an error."""
    return decisions.join(interval_join(decisions, minutes, interval).select("symbol", "ts_ms").distinct(), ["symbol", "ts_ms"], "left_anti")


def aggregate_mismatches(decisions: DataFrame, minutes: DataFrame, interval: int, tolerance: float) -> DataFrame:
    """Decision bars that their finer rows do not add up to, within ``tolerance``."""
    joined = interval_join(decisions, minutes, interval)
    made = joined.groupBy("symbol", "ts_ms", "open", "high", "low", "close").agg(
        F.min_by("m_open", "m_ts_ms").alias("_o"), F.max("m_high").alias("_h"), F.min("m_low").alias("_l"), F.max_by("m_close", "m_ts_ms").alias("_c")
    )
    off = reduce(lambda a, b: a | b, [F.abs(F.col(a) - F.col(b)) > tolerance for a, b in (("open", "_o"), ("high", "_h"), ("low", "_l"), ("close", "_c"))])
    return made.where(off).select("symbol", "ts_ms")


def window_lookup(local: Column, windows: list[tuple[int, int, int, int]]) -> Column:
    """Value of the first window (day, open minute, close minute, value) that holds the local time; NULL if none does.

    Windows are a broker's settings, some dozens at most, so they are constants of the plan and no join.
    """
    day, minute = F.dayofweek(local) - 1, F.hour(local) * 60 + F.minute(local)
    return F.coalesce(*[F.when((day == d) & (minute >= a) & (minute < b), F.lit(v)) for d, a, b, v in windows], F.lit(None).cast("int"))


def resolved_spread(recorded: Column, window: Column, fallback: int | None) -> Column:
    """Recorded if positive, or in any case without a fallback; else the window's, the fallback, the recorded 0; an error if nothing is known."""
    own = recorded if fallback is None else F.when(recorded > 0, recorded)
    unknown = F.raise_error(F.lit("no spread is recorded, and neither window nor fallback gives one")).cast("int")
    return F.coalesce(own, window, F.lit(fallback).cast("int"), recorded, unknown)


def swap_multiplier(day: Column, listed: dict[int, float] | None, triple: int = 3) -> Column:
    """Multiplier of a weekday (0 Sunday): a listed one, else 0 at weekends, 3 on the triple day, 1 otherwise."""
    usual = F.when(day.isin(0, 6), 0.0).when(day == triple, 3.0).otherwise(1.0)
    if not listed:
        return usual
    return F.coalesce(*[F.when(day == d, F.lit(float(m))) for d, m in sorted(listed.items())], F.lit(0.0) if len(listed) == 7 else usual)


def rollovers(before: Column, after: Column, listed: dict[int, float] | None = None, triple: int = 3) -> Column:
    """Sum of the multipliers of the local midnights crossed between two local times; Saturday's and Sunday's are those of the weekend."""
    days = F.when(F.to_date(after) > F.to_date(before), F.sequence(F.to_date(before), F.date_sub(F.to_date(after), 1))).otherwise(F.array().cast("array<date>"))
    return F.aggregate(days, F.lit(0.0), lambda a, d: a + swap_multiplier(F.dayofweek(d) - 1, listed, triple))


def as_of(left: DataFrame, right: DataFrame, value: str, size: int = BLOCK) -> DataFrame:
    """Left rows with the latest ``value`` of the right at or before their time: union, one sort by symbol and time, no pairs; by blocks."""
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(f"asof_{value}")).unionByName(
        right.select("symbol", "ts_ms", F.lit(0).alias("_side"), F.col(value).alias(f"asof_{value}")), allowMissingColumns=True
    )
    rows = numbered(both, ["symbol"], [F.asc("ts_ms"), F.asc("_side")], Scratch(left.sparkSession, "as-of"))
    return running(rows, ["symbol"], {f"asof_{value}": ("last", F.col(f"asof_{value}"))}, size).where("_side = 1").drop("_side", "_n")


def align_trades(reference: DataFrame, external: DataFrame, within_ms: int = 86_400_000, deltas: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """One-to-one matches of trades (run_id, trade_no, side, entry_ms, entry_price) in the reference's order: ref_no and ext_no.

    Each reference trade, by number, takes the unused external one of its run and side nearest in entry time (within
    ``within_ms``), ties by entry price, then number. Leftovers of both sides, and trades without a run, side or time, are kept
    with NULLs. For each of the ``deltas``, columns of both sides, external less reference is added as delta_<column>.

    A run and side is cut wherever the merged times leave more than ``within_ms``: no match reaches over such a gap, so the
    pieces are chosen from independently. Such a gap lies between two stretches of ``within_ms``, never inside one, so it is
    found in a table of one row a stretch that holds trades. A task holds one piece.
    """
    columns = ["run_id", "side", "trade_no", "entry_ms", "entry_price"]
    both = reference.select(*columns, F.lit(True).alias("_ours")).unionByName(external.select(*columns, F.lit(False).alias("_ours"))).dropna(subset=["run_id", "side", "trade_no", "entry_ms"])
    keys = ["run_id", "side"]
    scratch = Scratch(reference.sparkSession, "align")
    wide = max(within_ms, 1)
    placed = both.withColumn("_stretch", F.expr(f"(entry_ms - pmod(entry_ms, {wide}L)) div {wide}L"))
    stretches = placed.groupBy(*keys, "_stretch").agg(F.min("entry_ms").alias("_from"), F.max("entry_ms").alias("_to"))
    led = scratch.cut(before(numbered(stretches, keys, [F.asc("_stretch")], scratch), keys, {"_last": "_to"}, size))
    pieces = running(led, keys, {"_piece": ("sum", F.when(F.col("_from") - F.col("_last") > within_ms, 1).otherwise(0))}, size)
    parted = lookup(placed, scratch.cut(pieces.select(*keys, "_stretch", "_piece")), [*keys, "_stretch"])
    run, number = both.schema["run_id"].dataType.simpleString(), both.schema["trade_no"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [], None
        for batch in batches:
            first = batch.select(["run_id"]).slice(0, 1) if first is None else first
            held.append(batch.select(["trade_no", "entry_ms", "entry_price", "_ours"]))
        piece = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        for made in _chosen(piece, within_ms).to_batches(BLOCK):
            own = first.column("run_id").take(pa.array(np.zeros(len(made), np.int32)))
            yield pa.RecordBatch.from_arrays([own, *made.columns], names=["run_id", "ref_no", "ext_no"])

    parts = max(_PIECES, int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few large pieces shall not share a task
    apart = parted.select(*columns, "_ours", "_piece").repartition(parts, *keys, "_piece")
    matched = apart.groupBy(*keys, "_piece").applyInArrow(choose, f"run_id {run}, ref_no {number}, ext_no {number}")
    own = lambda t, name, prefix: t.select("run_id", F.col("trade_no").alias(name), *[F.col(c).alias(f"{prefix}{c}") for c in deltas])
    joined = own(reference, "ref_no", "_r_").join(matched, ["run_id", "ref_no"], "left").join(own(external, "ext_no", "_x_"), ["run_id", "ext_no"], "full")
    return joined.select("run_id", "ext_no", "ref_no", *[(F.col(f"_x_{c}") - F.col(f"_r_{c}")).alias(f"delta_{c}") for c in deltas])


def _matches(piece: pa.Table, within: int) -> pa.Table:
    """run_id, ref_no and ext_no of one piece's matches."""
    made = _chosen(piece, within)
    own = piece.column("run_id").slice(0, 1).combine_chunks()
    return made.add_column(0, "run_id", own.take(pa.array(np.zeros(len(made), np.int32))) if len(made) else own.slice(0, 0))


def _seek(links: memoryview, i: int) -> int:
    """Where a chain of links ends; links on the way are halved."""
    while (j := links[i]) != i:
        links[i] = i = links[j]
    return i


def _chosen(piece: pa.Table, within: int) -> pa.Table:
    """ref_no and ext_no of the greedy matches of one piece.

    External trades lie in order of time, price and number. Moments that have unused ones are found from a time outwards, and
    within a moment unused ones from a price outwards, past runs of used ones; so a choice costs steps by the logarithm of
    the trades, however many share a time or a price. Columns are numpy arrays that the loop reads through memoryviews,
    links are 32-bit: some bytes a trade beyond the piece itself.
    """
    column = lambda name: piece.column(name).to_numpy()
    mine = np.asarray(column("_ours"), bool)
    ours, theirs = np.flatnonzero(mine).astype(np.int32), np.flatnonzero(~mine).astype(np.int32)
    at, number, price = column("entry_ms"), column("trade_no"), np.asarray(column("entry_price"), float)
    ours = ours[np.argsort(number[ours], kind="stable")]
    for key in (number, np.where(np.isfinite(price), price, np.inf), at):
        theirs = theirs[np.argsort(key[theirs], kind="stable")]
    asked, offered = price[ours], price[theirs]
    offered[~np.isfinite(offered)] = np.inf
    wanted, times = (at[side].astype(np.int64) for side in (ours, theirs))
    numbers, owners, n = number[theirs], number[ours], len(theirs)
    del at, number, price, mine, ours, theirs
    first = np.flatnonzero(np.diff(times, prepend=times[:1] - 1))
    moments = times[first]
    del times
    middle = np.searchsorted(moments, wanted).astype(np.int32)
    turn = np.argsort(numbers, kind="stable").astype(np.int32)  # by number within each moment
    turn = turn[np.argsort(np.searchsorted(first, turn, "right").astype(np.int32), kind="stable")]
    g = len(moments)
    ends = memoryview(np.append(first, n).astype(np.int32))
    low, high = (memoryview(np.arange(g + 1, dtype=np.int32)) for _ in range(2))  # moments: i - 1 or the last before it, i or the next, with unused trades
    left, right = (memoryview(np.arange(n + 1, dtype=np.int32)) for _ in range(2))  # trades alike
    rest, after = memoryview(np.diff(np.asarray(ends))), memoryview(first.astype(np.int32))  # unused trades of a moment, and where its least unused number is at the earliest
    used, chosen = bytearray(n), memoryview(np.full(len(owners), -1, np.int32))
    asked, offered, wanted, moments, middle, turn, number_of = map(memoryview, (asked, offered, wanted, moments, middle, turn, numbers))

    def least(i: int, begin: int) -> int:
        """The unused trade of the least number among those of a moment with the price of i, an unused one."""
        if i == begin or offered[i - 1] != offered[i]:
            return i
        return _seek(right, bisect_left(offered, offered[i], begin, i))

    def nearest(moment: int, price: float) -> tuple[float, int, int]:
        """(distance, number, place) of a moment's unused trade nearest in price; of equals the lower number. A missing price is infinitely far."""
        begin, end = ends[moment], ends[moment + 1]
        if price - price == 0:
            middle = bisect_left(offered, price, begin, end)
            i, j = _seek(right, middle), _seek(left, middle) - 1
            above, below = offered[i] - price if i < end else math.inf, price - offered[j] if j >= begin else math.inf
            off = min(above, below)
            if off < math.inf:
                best = -1
                while i < end and offered[i] - price == off:  # another price as far only by rounding
                    best = i if best < 0 or number_of[i] < number_of[best] else best
                    after_i = _seek(right, i + 1)
                    i = _seek(right, bisect_right(offered, offered[i], i, end)) if after_i < end and offered[after_i] == offered[i] else after_i
                while j >= begin and price - offered[j] == off:
                    i = least(j, begin)
                    best = i if best < 0 or number_of[i] < number_of[best] else best
                    j = _seek(left, i) - 1
                return off, number_of[best], best
        k = after[moment]
        while used[turn[k]]:
            k += 1
        after[moment] = k
        return math.inf, number_of[turn[k]], turn[k]

    for k, at in enumerate(wanted):
        up = middle[k]
        down = _seek(low, up) - 1
        up = _seek(high, up)
        before, behind = at - moments[down] if down >= 0 else within + 1, moments[up] - at if up < g else within + 1
        if min(before, behind) > within:
            continue
        if before == behind:
            one, other = nearest(down, asked[k]), nearest(up, asked[k])
            moment, best = (down, one[2]) if one <= other else (up, other[2])
        else:
            moment = down if before < behind else up
            best = nearest(moment, asked[k])[2]
        used[best], left[best + 1], right[best], chosen[k] = 1, best, best + 1, best
        rest[moment] -= 1
        if not rest[moment]:
            low[moment + 1], high[moment] = moment, moment + 1
    chosen = np.asarray(chosen)
    taken, kind = chosen >= 0, piece.schema.field("trade_no").type
    return pa.Table.from_arrays([pa.array(owners[taken], kind), pa.array(numbers[chosen[taken]], kind)], names=["ref_no", "ext_no"])
