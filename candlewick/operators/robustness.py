"""Robustness: variants of costs and parameters, acceptance rules, synthetic series, and certification grades."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.scratch import Scratch
from .bars import in_time
from .series import BLOCK, before, lookup, running

#: No close is taken to be lower.
LEAST_PRICE = 1e-12


def cost_shocks(signals: DataFrame, multipliers: list[float], point: float) -> DataFrame:
    """Signals once for each multiplier, spread ceil(points * m) * point; run_id gets the multiplier. Costs a lot scale in the settings."""
    shocked = signals.withColumn("multiplier", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    spread = F.ceil(F.col("spread") / point * F.col("multiplier") - 1e-9) * point
    return shocked.withColumn("spread", spread.cast("double")).withColumn("run_id", F.concat_ws("|x", "run_id", F.col("multiplier").cast("string")))


def neighbours(params: dict[str, float], n: int, reach: float, seed: int, whole: tuple[str, ...] = ()) -> list[dict[str, float]]:
    """Random variants within a fraction ``reach`` of every parameter."""
    rng = random.Random(seed)
    made = [{k: v * (1 + rng.uniform(-reach, reach)) for k, v in params.items()} for _ in range(n)]
    return [{k: float(max(2, round(v))) if k in whole else v for k, v in m.items()} for m in made]


def axis_steps(params: dict[str, float], reach: float) -> list[tuple[str, dict[str, float]]]:
    """Each parameter a step down and up, the others as they are."""
    return [(k, params | {k: v * f}) for k, v in params.items() for f in (1 - reach, 1 + reach)]


def survives(prefix: str = "base_", least_return: float = 0.0, ratio: float = 0.5, dd_times: float = 1.5, dd_cap: float = 30.0) -> Column:
    """A neighbour that keeps half the return and trades, and at most 1.5 times the drawdown, within a cap.

    A baseline without drawdown leaves the cap alone as the limit; none survives a baseline without trades.
    """
    base = lambda c: F.col(prefix + c)
    limit = F.when(base("max_drawdown_percent") > 0, F.least(dd_times * base("max_drawdown_percent"), F.lit(dd_cap))).otherwise(dd_cap)
    kept = (F.col("return_percent") > least_return) & (F.col("return_percent") >= ratio * base("return_percent")) & (F.col("max_drawdown_percent") <= limit)
    return F.coalesce(kept & (base("trades") > 0) & (F.col("trades") >= ratio * base("trades")), F.lit(False))


def retained(prefix: str = "base_", ratio: float = 0.8) -> Column:
    base = lambda c: F.col(prefix + c)
    return (F.col("return_percent") >= ratio * base("return_percent")) & (F.col("trades") >= 0.8 * base("trades")) & (F.col("max_drawdown_percent") < 1.3 * base("max_drawdown_percent"))


def gate(trades: int, drawdown: float, ret: float, pf: float, recovery: float | None = None) -> Column:
    """Metrics that pass: a missing profit factor counts as beyond any limit."""
    ok = (F.col("trades") >= trades) & (F.col("max_drawdown_percent") <= drawdown) & (F.col("return_percent") > ret) & (F.coalesce(F.col("profit_factor"), F.lit(float("inf"))) >= pf)
    return ok if recovery is None else ok & (F.coalesce(F.col("recovery_factor"), F.lit(float("inf"))) >= recovery)


def oos_pick(ratio: float) -> Column:
    """Both expectancies positive, and the later one at least ``ratio`` of the earlier."""
    return F.coalesce((F.col("before") > 0) & (F.col("since") > 0) & (F.col("since") >= ratio * F.col("before")), F.lit(False))


def ambiguous(trades: DataFrame, keys: list[str], share: float = 0.25) -> DataFrame:
    """Runs whose share of trades that end on their entry bar is too high."""
    return trades.groupBy(*keys).agg((F.count_if(F.col("bars_held") == 0) / F.count("*")).alias("same_bar")).withColumn("rejected", F.col("same_bar") >= share)


def p80_rule(p80: Column, baseline: Column) -> Column:
    return (baseline > 0) & (p80 >= 0.6 * baseline)


def stationary_bars(bars: DataFrame, trials: int, mean_block: int, seed: int, size: int = BLOCK) -> DataFrame:
    """Synthetic series per symbol and trial by a stationary bootstrap of the log returns between closes.

    Blocks of returns begin anywhere, wrap around, and end after each return with probability 1 / mean_block, after four times
    that at most. The first bar stays as it is; a later one opens at the synthetic close before it, closes after its
    return (at 1e-12 or more), and spans 0.01 % around both. Times, volumes and spreads stay. A return next to a bar without a
    close is zero. Adds trial.

    Draws go by counters, so where a block begins is a running maximum of where draws end one, and closes are running
    sums: all by blocks of a series, with one equi-join that fetches the drawn returns.
    """
    scratch = Scratch(bars.sparkSession, "stationary")
    mean, most = max(mean_block, 1), 4 * max(mean_block, 1)
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(LEAST_PRICE)))
    own = before(in_time(bars.drop("_n"), ["symbol"]), ["symbol"], {"_last": "close"}, size)
    rows = scratch.cut(own.withColumn("_r", F.coalesce(log("close") - log("_last"), F.lit(0.0))))
    many = rows.groupBy("symbol").agg((F.count("*") - 1).alias("_m"), F.min_by(log("close"), "_n").alias("_begin"))  # one row a symbol
    keys, n = ["symbol", "trial"], F.col("_n")
    each = lookup(rows.drop("_r", "_last"), many, ["symbol"]).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    ends = (n == 1) | (draws.draw32_column(seed, draws.TURN, F.col("trial"), n) < F.lit(round((1 << 32) / mean)))
    placed = running(each, keys, {"_s": ("max", F.when(ends & (n >= 1), n))}, size)
    begun = placed.withColumn("_b", F.col("_s") + F.floor((n - F.col("_s")) / most) * most)
    drawn = begun.withColumn("_from", F.when(n >= 1, 1 + (draws.index_column(F.greatest("_m", F.lit(1)), seed, F.col("trial"), F.col("_b")) + n - F.col("_b")) % F.greatest("_m", F.lit(1))))
    returns = rows.select(F.col("symbol").alias("_symbol"), F.col("_n").alias("_from2"), "_r")
    met = scratch.cut(drawn.join(returns, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_from") == F.col("_from2")), "left").drop("_symbol", "_from", "_from2", "_s", "_b"))
    summed = scratch.cut(running(met, keys, {"_sum": ("sum", F.coalesce("_r", F.lit(0.0)))}, size).withColumn("_y", F.col("_begin") + F.col("_sum")))
    # a path that is held at the least price is lifted by how far it has been below it so far
    held = running(summed, keys, {"_low": ("min", F.col("_y"))}, size)
    floor = F.log(F.lit(LEAST_PRICE))
    closed = scratch.cut(held.withColumn("_c", F.exp(F.col("_y") + F.greatest(floor - F.col("_low"), F.lit(0.0)))))
    made = before(closed, keys, {"_o": "_c"}, size)
    later, o, c = n >= 1, F.col("_o"), F.col("_c")
    return made.withColumns({
        "open": F.when(later, o).otherwise(F.col("open")), "high": F.when(later, F.greatest(o, c) * 1.0001).otherwise(F.col("high")),
        "low": F.when(later, F.least(o, c) * 0.9999).otherwise(F.col("low")), "close": F.when(later, c).otherwise(F.col("close")),
    }).select("symbol", "trial", *[x for x in bars.columns if x not in ("symbol", "trial", "_n")])


#: Blockers of a certificate, and the grade that none of them leaves.
GRADES = (("live", ("sealed", "incubation")), ("sealed", ("sealed",)), ("challenged", ("challenge",)), ("screened", ()))


def certificate(evidence: dict) -> dict:
    """Grade and blockers of the assembled evidence: each kind is absent, stale (other hashes), or failed."""
    blockers = []
    for kind in ("data", "strategy", "broker", "split", "screen", "challenge", "sealed", "incubation"):
        part = evidence.get(kind)
        if part is None:
            blockers.append(f"{kind}_missing")
        elif part.get("strategy_hash", evidence.get("strategy_hash")) != evidence.get("strategy_hash"):
            blockers.append(f"{kind}_stale")
        elif not part.get("passed", True):
            blockers.append(f"{kind}_failed")
    hashes = [p["artifact_hash"] for p in evidence.values() if isinstance(p, dict) and "artifact_hash" in p]
    if len(set(hashes)) < len(hashes):
        blockers.append("artifact_reused")
    kinds = {b.rsplit("_", 1)[0] for b in blockers}
    grade = "none" if kinds & {"data", "strategy", "broker", "split", "screen", "artifact"} else next(g for g, need in GRADES if not kinds & {*need, *(("challenge",) if g in ("live", "sealed") else ())})
    return {"grade": grade, "blockers": blockers}


def incubation_breaks(ledger: DataFrame) -> DataFrame:
    """Days whose date does not follow the one before, or whose starting balance is not its last one."""
    from pyspark.sql import Window

    w = Window.partitionBy("strategy").orderBy("date")
    checked = ledger.withColumn("_d", F.lag("date").over(w)).withColumn("_b", F.lag("ending_balance").over(w))
    return checked.where((F.col("_d") == F.col("date")) | (F.abs(F.col("_b") - F.col("starting_balance")) > 1e-6)).select("strategy", "date")


def funnel(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(reason).agg(F.count("*").alias("count"))
