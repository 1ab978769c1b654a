"""Portfolios of strategies by their return paths: drawdown, stress by resampling, and the best of greedy choices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nearest_rank
from .stats import block_bootstrap, pack_portfolio


def path(returns: Column) -> Column:
    """Additive equity from 1 after each return of an array; for arrays of bounded length."""
    grown = lambda a, r: F.struct((a["at"] + r).alias("at"), F.concat(a["out"], F.array(a["at"] + r)).alias("out"))
    return F.aggregate(returns, F.struct(F.lit(1.0).alias("at"), F.array().cast("array<double>").alias("out")), grown, lambda a: a["out"])


def path_drawdown(returns: Column) -> Column:
    """Largest percent below the peak of the additive equity; 0 of an empty array."""
    begin = F.struct(F.lit(1.0).alias("at"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(a, r):
        at = a["at"] + r
        peak = F.greatest(a["peak"], at)
        return F.struct(at.alias("at"), peak.alias("peak"), F.greatest(a["worst"], F.when(peak > 0, (peak - at) / peak * 100).otherwise(0.0)).alias("worst"))

    return F.aggregate(returns, begin, step, lambda a: a["worst"])


def signature_sharpe(returns: Column) -> Column:
    """Mean over sample deviation of an array, times the root of its size; NULL below two values or without deviation."""
    n = F.size(returns)
    mean = F.aggregate(returns, F.lit(0.0), lambda a, r: a + r) / n
    deviation = F.sqrt(F.aggregate(returns, F.lit(0.0), lambda a, r: a + (r - mean) * (r - mean)) / (n - 1))
    return F.when(n >= 2, F.when(deviation > 1e-12, mean / deviation * F.sqrt(n)))


def stress(returns: DataFrame, keys: list[str], trials: int = 1000, block: int = 5, seed: int = 42) -> DataFrame:
    """(keys, trial, return_percent, max_drawdown_percent) of circular block draws of each key's returns (idx from 0, value): additive equity from 1."""
    made = block_bootstrap(returns.select(*keys, "idx", F.col("value").alias("profit")), keys, trials, block, seed, initial=1.0)
    return made.select(*keys, "trial", (F.col("net") * 100).alias("return_percent"), "max_drawdown_percent")


def stress_report(trial: DataFrame, keys: list[str], tail: float = 0.05) -> DataFrame:
    """(keys, trials, p05_return, cvar_return, p95_drawdown); the trials bound the arrays."""
    listed = trial.groupBy(*keys).agg(F.sort_array(F.collect_list("return_percent")).alias("r"), F.sort_array(F.collect_list("max_drawdown_percent")).alias("d"))
    n = F.greatest(F.ceil(F.size("r") * tail), F.lit(1)).cast("int")
    lowest = F.aggregate(F.slice("r", F.lit(1), n), F.lit(0.0), lambda a, v: a + v) / n
    return listed.select(*keys, F.size("r").alias("trials"), nearest_rank(F.col("r"), 0.05).alias("p05_return"), lowest.alias("cvar_return"), nearest_rank(F.col("d"), 0.95).alias("p95_drawdown"))


def best_portfolio(candidates: list[dict], corr: dict[tuple, float], most: int, weight_cap: float, symbol_cap: float, cohort_cap: float, corr_cap: float, least_return: float = 0.0) -> dict | None:
    """The best of the greedy choices of every size from 1 / weight_cap to ``most``: by return over drawdown, then size, then ids.

    candidates have id, symbol, cohort, return_percent and returns (equal lengths); weights are equal. Order-dependent
    by definition: runs on the driver over a shortlist of some hundreds. None if no size satisfies the caps.
    """
    best = None
    for size in range(min(most, len(candidates)), max(1, math.ceil(1 / weight_cap - 1e-12)) - 1, -1):
        chosen = pack_portfolio(candidates, corr, size, math.floor(symbol_cap * size + 1e-9), math.floor(cohort_cap * size + 1e-9), corr_cap)
        if len(chosen) != size:
            continue
        own = [c for c in candidates if c["id"] in chosen]
        at, peak, worst = 1.0, 1.0, 0.0
        for values in zip(*(c["returns"] for c in own), strict=True):
            at += sum(values) / size
            peak = max(peak, at)
            worst = max(worst, (peak - at) / peak * 100 if peak > 0 else 0.0)
        expected = sum(c["return_percent"] for c in own) / size
        if expected < least_return:
            continue
        made = {"ids": sorted(chosen), "size": size, "expected_return": expected, "max_drawdown_percent": worst, "objective": expected / max(worst, 0.01)}
        if best is None or (made["objective"], made["size"], [*map(str, best["ids"])]) > (best["objective"], best["size"], [*map(str, made["ids"])]):
            best = made
    return best
