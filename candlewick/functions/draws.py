"""Random draws by counter: a number for every (seed, lane, trial, counter), the same in numpy, in Spark columns and in SQL.

A draw mixes 32 bits twice, with shifts and products only. Index draws take 62 bits of two lanes modulo n, so every place of a
series of up to 2^40 rows is reached, and no place is likelier than another by more than n / 2^62.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published 32-bit finaliser "lowbias32" (shifts and odd factors), and 2^32 over the golden ratio, which parts lanes.
_SHIFTS, _FACTORS, _GOLDEN = (16, 15, 16), (0x7FEB352D, 0x846CA68B), 0x9E3779B9
MASK = (1 << 32) - 1
#: Lanes: what a draw is for.
HIGH, LOW, SKIP, TURN = range(4)


def _mix_int(x: int) -> int:
    for shift, factor in zip(_SHIFTS, (*_FACTORS, 1), strict=True):
        x = ((x ^ (x >> shift)) * factor) & MASK
    return x


def lane_key(seed: int, lane: int) -> int:
    return _mix_int((seed + (lane + 1) * _GOLDEN) & MASK)


def trial_key(seed: int, lane: int, trial: int) -> int:
    return _mix_int(lane_key(seed, lane) ^ (trial & MASK))


# -- numpy


def draw32(seed: int, lane: int, trial: int, counters: np.ndarray) -> np.ndarray:
    """32-bit draws of a lane and trial at non-negative counters."""
    k = counters.astype(np.uint64)
    x = (np.uint64(trial_key(seed, lane, trial)) + k + (k >> np.uint64(32)) * np.uint64(_GOLDEN)).astype(np.uint32)
    for shift, factor in zip(_SHIFTS, (*_FACTORS, 1), strict=True):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x


def index(n: int, seed: int, trial: int, counters: np.ndarray) -> np.ndarray:
    """Places from 0 to n - 1."""
    high, low = (draw32(seed, lane, trial, counters).astype(np.uint64) for lane in (HIGH, LOW))
    return (((high << np.uint64(30)) + (low >> np.uint64(2))) % np.uint64(n)).astype(np.int64)


# -- columns


def _product(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32 for x below 2^32, by halves, so that nothing leaves 63 bits."""
    low, high = x.bitwiseAND(0xFFFF), F.shiftright(x, 16)
    return (low * F.lit(factor) + F.shiftleft((high * F.lit(factor)).bitwiseAND(0xFFFF), 16)).bitwiseAND(F.lit(MASK))


def _mix(x: Column) -> Column:
    for shift, factor in zip(_SHIFTS, (*_FACTORS, 1), strict=True):
        x = F.element_at(F.transform(F.array(x), lambda v: _product(v.bitwiseXOR(F.shiftright(v, shift)), factor)), 1)  # noqa: B023 - x is computed once, at once
    return x


def draw32_column(seed: int, lane: int, trial: Column, counter: Column) -> Column:
    k = counter.cast("long")
    key = _mix(F.lit(lane_key(seed, lane)).bitwiseXOR(trial.cast("long").bitwiseAND(F.lit(MASK))))
    return _mix((key + k.bitwiseAND(F.lit(MASK)) + _product(F.shiftright(k, 32), _GOLDEN)).bitwiseAND(F.lit(MASK)))


def index_column(n: Column, seed: int, trial: Column, counter: Column) -> Column:
    high, low = (draw32_column(seed, lane, trial, counter) for lane in (HIGH, LOW))
    return (F.shiftleft(high, 30) + F.shiftright(low, 2)) % n


# -- SQL


def mixed_sql(table: str, columns: list[str]) -> str:
    """A table expression in DuckDB's SQL: ``table`` with the named unsigned columns (below 2^32) mixed."""
    for shift, factor in zip(_SHIFTS, (*_FACTORS, 1), strict=True):
        table = f"(SELECT * REPLACE ({', '.join(f'(xor({c}, {c} >> {shift}) * {factor}::UBIGINT) & {MASK}::UBIGINT AS {c}' for c in columns)}) FROM {table})"
    return table


def trial_keys_sql(seed: int, lanes: dict[str, int], trial: str = "trial") -> str:
    """Columns to be mixed into the keys of lanes (name -> lane)."""
    return ", ".join(f"xor({lane_key(seed, lane)}::UBIGINT, {trial}::UBIGINT) AS {name}" for name, lane in lanes.items())


def counted_sql(name: str, counter: str) -> str:
    """A key and a counter below 2^32, to be mixed into a draw."""
    return f"({name} + ({counter})::UBIGINT) & {MASK}::UBIGINT AS {name}"


def index_sql(n: str, high: str = "a", low: str = "b") -> str:
    return f"((({high} << 30) + ({low} >> 2)) % ({n})::UBIGINT)::BIGINT"
