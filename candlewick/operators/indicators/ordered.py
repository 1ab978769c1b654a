"""Order statistics of trailing windows: the share of a window at or below its newest value, and how old its extreme is.

Blocks of a symbol's bars (led by the bars a window reaches back) are arrays in a task. Ranks within a window come from
a wavelet matrix: values are split bit by bit of their rank, and every bar's window is carried through all splits at once,
so a bar costs as many steps as a rank has bits, however long the window is. Extremes come from doubling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..bars import in_time
from ..series import BLOCK


def trailing_ranks(values: np.ndarray, known: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place: how many of the known values among the last ``length`` are at most the one there, and how many are known."""
    n = len(values)
    seen = np.concatenate([[0], np.cumsum(known)])
    start = np.maximum(np.arange(n) + 1 - length, 0)
    count = seen[1:] - seen[start]
    if not n:
        return count, count
    distinct, ranks = np.unique(values[known], return_inverse=True)  # NaN is the largest
    below = np.full(n, len(distinct), dtype=np.int64)  # unknown values are beyond all bounds
    below[known] = ranks
    bound = np.minimum(below + 1, len(distinct))  # count what is less than this
    low, high, found, layer = start.copy(), np.arange(n) + 1, np.zeros(n, dtype=np.int64), below
    for bit in reversed(range(max(len(distinct), 1).bit_length())):
        ones = (layer >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        up = (bound >> bit & 1).astype(bool)
        found += np.where(up, zeros[high] - zeros[low], 0)
        low, high = (np.where(up, zeros[-1] + at - zeros[at], zeros[at]) for at in (low, high))
        layer = np.concatenate([layer[~ones], layer[ones]])
    return np.where(known, found, 0), count


def extreme_age(values: np.ndarray, known: np.ndarray, length: int, kind: str) -> np.ndarray:
    """For every place: how many known values of the last ``length`` are younger than the oldest extreme of them; -1 if none is known."""
    n = len(values)
    score = np.where(known, values if kind == "high" else -values, -np.inf)
    best, reach = np.arange(n), 1  # the extreme of the ``reach`` places up to each

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of places a (older) and b: b only if it is beyond a; a known place before an unknown one."""
        beyond = (score[b] > score[a]) | (np.isnan(score[b]) & ~np.isnan(score[a]) & (kind == "high")) | (known[b] & ~known[a])
        return np.where(beyond, b, a)

    back = lambda k: np.maximum(np.arange(n) - k, 0)
    while 2 * reach <= length:
        best, reach = better(best[back(reach)], best), 2 * reach
    best = better(best[back(length - reach)], best)
    seen = np.cumsum(known)
    return np.where(known[best], seen - seen[best], -1) if n else best


def with_ordered(bars: DataFrame, made: dict[str, tuple[str, str, int]], size: int = BLOCK) -> DataFrame:
    """bars with, for name -> (kind, column, length), statistics of the last ``length`` bars of a symbol, and _n.

    kind ``percent``: percent of the window's values at or below the newest one, and with the suffix _count how many values the
    window has; NULL where the newest is. kind ``high`` or ``low``: bars since the oldest extreme, NULL without any value.
    NULLs are left out of windows. Windows at a symbol's beginning are shorter.
    """
    reach = max(length for *_, length in made.values()) - 1
    size = max(size, reach, 1)
    own = F.expr(f"_n div {size}")
    rows = in_time(bars, ["symbol"])
    dealt = rows.withColumn("_block", F.explode(F.when(F.col("_n") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))))
    new = [f for name, (kind, *_) in made.items() for f in ([StructField(name, DoubleType()), StructField(f"{name}_count", LongType())] if kind == "percent" else [StructField(name, LongType())])]
    schema = StructType([*rows.schema.fields, *new])

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_n")  # a block and its lead
        mine = table.column("_n").to_numpy() // size == table.column("_block")[0].as_py() if len(table) else np.zeros(0, bool)
        columns = {}
        for name, (kind, column, length) in made.items():
            given = table.column(column).combine_chunks().cast(pa.float64())
            known, values = given.is_valid().to_numpy(zero_copy_only=False), given.fill_null(0.0).to_numpy(zero_copy_only=False)
            if kind == "percent":
                below, count = trailing_ranks(values, known, length)
                columns[name] = pa.array(below * 100 / np.maximum(count, 1), mask=~known)
                columns[f"{name}_count"] = pa.array(count.astype(np.int64))
            else:
                age = extreme_age(values, known, length, kind).astype(np.int64)
                columns[name] = pa.array(age, mask=age < 0)
        for name, values in columns.items():
            table = table.append_column(name, values)
        return table.filter(pa.array(mine)).select([f.name for f in schema])

    return dealt.groupBy("symbol", "_block").applyInArrow(work, schema)


def percentile_mt5(ranked: str, length: int) -> Column:
    """Percent at or below the newest, from a full window on."""
    return F.when(F.col("_n") >= length - 1, F.col(ranked))


def percentile_sqx(ranked: str, column: str) -> Column:
    """Percent at or below the newest; 0 with less than two values or none above zero."""
    return F.when((F.col(f"{ranked}_count") >= 2) & (F.col(column) > 0), F.col(ranked)).otherwise(0.0)


def aroon(age: str, n: int) -> Column:
    return F.when(F.col("_n") >= n - 1, 100 - F.col(age) * 100 / n)
