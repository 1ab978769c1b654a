"""Studies over many rules: factor cells, bake-offs, contrasts, symbol screens, walk-forward, challenges, archives and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nearest_rank
from ..functions.scratch import Scratch
from .metrics import longest_idle, trade_metrics
from .series import numbered


def median(value: Column) -> Column:
    """The middle value, or the mean of the two; NULL of none."""
    return F.median(value)


# -- factor grids


def factor_cells(draws: DataFrame) -> DataFrame:
    """Per (entry_conditions, exit_conditions, recipe): draws, screened, pass rate out of sample, medians of what was screened; best cells first.

    draws have screened and picked (booleans), retention, oos_expectancy and complexity. place orders by pass rate,
    then median retention (missing last).
    """
    keys = ["entry_conditions", "exit_conditions", "recipe"]
    on = F.col("screened")
    of = lambda c: median(F.when(on, F.col(c)))
    made = draws.groupBy(*keys).agg(
        F.count("*").alias("draws"),
        F.count_if(on).alias("n_screened"),
        F.coalesce(F.count_if(on & F.col("picked")) / F.nullif(F.count_if(on), F.lit(0)), F.lit(0.0)).alias("pass_rate"),
        of("retention").alias("median_retention"),
        of("oos_expectancy").alias("median_oos"),
        of("complexity").alias("median_complexity"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("pass_rate"), F.desc_nulls_last("median_retention"), *keys)  # as many rows as cells
    return made.withColumn("place", F.row_number().over(order))


def bake_off(members: DataFrame, risk: float = 100.0) -> DataFrame:
    """Per number of entry conditions: medians in units of risk, pass rate, and which arm is recommended.

    members have entry_conditions, is_expectancy, oos_expectancy and picked. Arms order by median retention, median
    out-of-sample expectancy, then fewer conditions; the first with ten tested, half passed, 0.7 retained and a
    positive expectancy is recommended.
    """
    kept = F.when(F.col("is_expectancy") > 0, F.col("oos_expectancy") / F.col("is_expectancy"))
    zero = F.lit(0.0)
    rows = members.groupBy("entry_conditions").agg(
        F.coalesce(median(F.col("is_expectancy") / risk), zero).alias("median_is"),
        F.coalesce(median(F.col("oos_expectancy") / risk), zero).alias("median_oos"),
        F.coalesce(median(kept), zero).alias("median_retention"),
        (F.count_if("picked") / F.count("*")).alias("pass_rate"),
        F.count("*").alias("tested"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("median_retention"), F.desc("median_oos"), "entry_conditions")  # one row an arm
    fit = (F.col("tested") >= 10) & (F.col("pass_rate") >= 0.5) & (F.col("median_retention") >= 0.7) & (F.col("median_oos") > 0)
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("fit", fit)
    return placed.withColumn("recommended", F.col("fit") & (F.col("place") == F.min(F.when(F.col("fit"), F.col("place"))).over(Window.partitionBy(F.lit(0))))).drop("fit")


def tercile(value: str, tie: str, keys: list[str]) -> Column:
    """0, 1 or 2 by rank within keys: thirds of the rows, the first ones taking what is left over."""
    return F.ntile(3).over(Window.partitionBy(*keys).orderBy(value, tie)) - 1


def contrasts(draws: DataFrame, baseline: str) -> DataFrame:
    """Per recipe other than ``baseline``: medians of retention and pass rates of both, for mann_whitney() and false_discovery()."""
    on = draws.where("screened and retention is not null")
    per = on.groupBy("recipe").agg(F.count("*").alias("n"), median(F.col("retention")).alias("median_retention"), (F.count_if("picked") / F.count("*")).alias("pass_rate"))
    all_rows = Window.partitionBy(F.lit(0))  # one row a recipe
    base = [F.max(F.when(F.col("recipe") == baseline, F.col(c))).over(all_rows).alias(f"base_{c}") for c in ("n", "median_retention", "pass_rate")]
    return per.select("*", *base).where(F.col("recipe") != baseline)


# -- screens and batteries


def symbol_screen(trades: DataFrame, gate: Column, primary: str, initial: float = 10_000.0) -> DataFrame:
    """(strategy, symbol) metrics with passed, and per strategy how many symbols pass and the pooled profit of those.

    The primary symbol's trades are pooled only if it passes, like any other's.
    """
    rows = trade_metrics(trades, ["strategy", "symbol"], initial).withColumn("return_percent", F.col("net_profit") / initial * 100).withColumn("passed", F.coalesce(gate, F.lit(False)))
    w = Window.partitionBy("strategy")
    pooled = F.when(F.col("passed"), F.col("net_profit"))
    return rows.withColumn("is_primary", F.col("symbol") == primary).withColumn("passing", F.count_if("passed").over(w)).withColumn("pooled_profit", F.coalesce(F.sum(pooled).over(w), F.lit(0.0)))


def fold_signals(signals: DataFrame, folds: int, purge: int = 20, context: int = 320) -> DataFrame:
    """Signals of purged folds: each fold's rows with ``context`` bars before the purge as warm-up, entries only from the fold's start.

    Folds cut every run's rows (run_id, ts_ms) into equal parts; run_id gets the fold's number.
    """
    w = Window.partitionBy("run_id")
    at, n = F.row_number().over(w.orderBy("ts_ms")) - 1, F.count(F.lit(1)).over(w)
    numbered = signals.withColumn("_i", at).withColumn("_n", n)
    dealt = numbered.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start, end = F.floor(F.col("_n") * F.col("_fold") / folds), F.floor(F.col("_n") * (F.col("_fold") + 1) / folds)
    near = dealt.withColumn("_start", start).where((F.col("_i") < end) & (F.col("_i") >= F.col("_start") - purge - context) & ~F.col("_i").between(F.col("_start") - purge, F.col("_start") - 1))
    named = F.concat_ws("|f", "run_id", F.col("_fold").cast("string"))
    return near.withColumn("tradable", F.col("tradable") & (F.col("_i") >= F.col("_start"))).withColumn("run_id", named).drop("_i", "_n", "_fold", "_start")


def passing(trades: int, drawdown: float, ret: float, pf: float) -> Column:
    """Trades, return, drawdown and profit factor within limits; a missing profit factor counts as unbounded with a win, else as 0."""
    factor = F.coalesce(F.col("profit_factor"), F.when((F.col("net_profit") > 0) & (F.col("wins") > 0), float("inf")).otherwise(0.0))
    return (F.col("trades") >= trades) & (F.col("return_percent") > ret) & (factor >= pf) & (F.col("max_drawdown_percent") <= drawdown)


def survival(metrics: DataFrame, keys: list[str], variants: int, test: Column, name: str) -> DataFrame:
    """(keys, <name>): the share of ``variants`` whose metrics pass; variants without a trade have no row and fail."""
    return metrics.groupBy(*keys).agg((F.count_if(F.coalesce(test, F.lit(False))) / variants).alias(name))


def challenge(baseline: DataFrame, folds: DataFrame, shocks: DataFrame, neighbours: DataFrame, resampled: DataFrame, tried: int, least_sharpe: float | None = None) -> DataFrame:
    """Per run the blockers of the battery, in the order of its tests, and whether there are none.

    baseline: trade_metrics() with return_percent; folds, shocks, neighbours: survival() shares; resampled: resampling_report().
    """
    from .stats import deflated_sharpe

    joined = baseline.join(folds, "run_id", "left").join(shocks, "run_id", "left").join(neighbours, "run_id", "left").join(resampled.select("run_id", F.col("passed").alias("resampled")), "run_id", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    factor = F.coalesce(F.col("profit_factor"), F.when((F.col("net_profit") > 0) & (F.col("wins") > 0), float("inf")).otherwise(0.0))
    sharpe = deflated_sharpe(F.coalesce("trade_sharpe", F.lit(0.0)), F.lit(tried))
    tests = {
        "baseline_trades": F.col("trades") < 20,
        "baseline_return": F.col("return_percent") <= 0,
        "baseline_profit_factor": factor < 1,
        "baseline_drawdown": F.col("max_drawdown_percent") > 30,
        "fold_stability": share("folds") < 0.6,
        "cost_survival": share("shocks") < 0.75,
        "resampling": ~F.coalesce("resampled", F.lit(False)),
        "neighbourhood": share("neighbours") < 0.7,
    }
    if least_sharpe is not None:
        tests["deflated_sharpe"] = sharpe < least_sharpe
    blockers = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda b: b.isNotNull())
    return joined.select("run_id", "trades", "net_profit", sharpe.alias("deflated_sharpe"), blockers.alias("blockers"), (F.size(blockers) == 0).alias("passed"))


def null_of_best(trades: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """95th percentiles, over trials, of the metrics of each trial's most profitable run; trades have trial and run_id."""
    per = trade_metrics(trades, ["trial", "run_id"], initial)
    ratio = F.when(F.col("max_drawdown_percent") > 0, F.col("net_profit") / initial * 100 / F.col("max_drawdown_percent"))
    rows = per.withColumn("return_drawdown", F.coalesce(ratio, F.lit(0.0)))
    of = lambda c: F.max_by(F.coalesce(c, F.lit(0.0)), F.struct("net_profit", "run_id")).alias(c)
    best = rows.groupBy("trial").agg(*[of(c) for c in ("profit_factor", "return_drawdown", "expectancy", "trade_sharpe")])
    listed = best.agg(F.count("*").alias("trials"), *[F.sort_array(F.collect_list(c)).alias(c) for c in best.columns[1:]])  # as many rows as trials
    return listed.select("trials", *[nearest_rank(F.col(c), 0.95).alias(f"p95_{c}") for c in best.columns[1:]])


# -- archives


def qd_score(elites: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the positive evidence of the elites."""
    return elites.groupBy(*keys).agg(F.count("*").alias("elites"), F.sum(F.greatest("evidence", F.lit(0.0))).alias("qd_score"))


#: Sort orders of an elite table; evidence breaks the ties of those that name it.
ELITE_SORTS = {
    "evidence": ["-evidence"], "novelty": ["-novelty"], "trades": ["-trades"], "drawdown": ["drawdown"], "recoveryFactor": ["-recovery_factor", "-evidence"],
    "sharpe": ["-sharpe", "-evidence"], "entryConditions": ["entry_conditions", "exit_conditions", "-evidence"], "grade": ["grade", "-evidence"],
}


def elites(table: DataFrame, sort: str = "evidence", text: str = "", conditions: int | None = None) -> DataFrame:
    """matching() elites in a named order (missing last; ties by id)."""
    return matching(table, text, conditions).orderBy(*[F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k) for k in ELITE_SORTS[sort]], "id")


def matching(table: DataFrame, text: str = "", conditions: int | None = None) -> DataFrame:
    """Elites whose id or fingerprint holds ``text`` in any case, with that many entry conditions."""
    needle = text.strip().lower()
    kept = table if conditions is None else table.where(F.col("entry_conditions") == conditions)
    if needle:
        kept = kept.where(F.contains(F.lower("id"), F.lit(needle)) | F.contains(F.lower("fingerprint"), F.lit(needle)))
    return kept


def places(table: DataFrame) -> DataFrame:
    """(sort, place, id) of elites in every named order, from 1: one range sort numbers all orders at once.

    A falling key is sorted by its negative; keys of text come first, as only the order by grade has one.
    """
    widest = max(map(len, ELITE_SORTS.values()))

    def keys(names: list[str]) -> list[Column]:
        text = [F.col(k) for k in names if k == "grade"]
        rest = [(-F.col(k[1:]) if k.startswith("-") else F.col(k)).cast("double") for k in names if k != "grade"]
        rest += [F.lit(None).cast("double")] * (widest - len(rest))
        return [(text or [F.lit(None).cast("string")])[0].alias("_text"), *[c.alias(f"_k{i}") for i, c in enumerate(rest)]]

    each = table.select("id", F.inline(F.array(*[F.struct(F.lit(sort).alias("sort"), *keys(names)) for sort, names in ELITE_SORTS.items()])))
    order = [F.asc_nulls_last(c) for c in ("_text", *[f"_k{i}" for i in range(widest)])]
    ranked = numbered(each, ["sort"], [*order, F.asc("id")], Scratch(table.sparkSession, "elites"))
    return ranked.select("sort", (F.col("_n") + 1).cast("int").alias("place"), "id")


def first_trades(trades: DataFrame, keys: list[str], most: int = 2000) -> DataFrame:
    """The first ``most`` trades of each run, as its list shows them."""
    return trades.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("trade_no"))).where(F.col("_k") <= most).drop("_k")


def tally(decisions: DataFrame, kinds: tuple[str, ...], keys: list[str]) -> DataFrame:
    """One count column per kind of decision."""
    return decisions.groupBy(*keys).agg(*[F.count_if(F.col("decision") == k).alias(k) for k in kinds])


def histogram(values: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """(bucket, low, n): how many values lie in [0, e1), [e1, e2), ..., and from the last edge on; empty buckets too."""
    at = sum(((F.col(col) >= e).cast("int") for e in edges), F.lit(0))
    counted = values.where(F.col(col) >= 0).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    lows = values.sparkSession.range(0, len(edges) + 1, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.element_at(F.array(*[F.lit(float(x)) for x in (0.0, *edges)]), F.col("id").cast("int") + 1).alias("low"))
    return lows.join(counted, "bucket", "left").na.fill(0, ["n"])


def config_groups(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Strategies that share all settings of ``keys`` (missing ones are a value of their own): how many, and the first name."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(name).alias("first"))


#: Hints that name a rule family, by family.
FAMILY_HINTS = {
    "trend_pullback": ("trend", "trend_pullback"), "momentum_burst": ("momentum", "momentum_burst"), "donchian_breakout": ("breakout", "donchian_breakout"), "mean_reversion_band": ("mean_reversion", "mean_reversion_band"),
    "zscore_reversion": ("zscore_reversion", "z_score_reversion"), "session_orb": ("session_orb",), "impulse_candle": ("impulse_candle",), "vol_squeeze_break": ("vol_squeeze_break",),
    "supply_demand_reclaim": ("supply_demand_reclaim",), "sweep_reclaim": ("sweep_reclaim",), "universal": ("universal", "universal_grammar"),
}


def family(hint: Column, otherwise: Column | None = None) -> Column:
    """A rule's family by its hint, else what ``otherwise`` says of its expression, else trend_pullback."""
    named = F.coalesce(*[F.when(hint.isin(*hints), F.lit(k)) for k, hints in FAMILY_HINTS.items()], F.lit(None).cast("string"))
    return F.coalesce(named, otherwise if otherwise is not None else F.lit(None).cast("string"), F.lit("trend_pullback"))


def condition_count(rule, kind: str) -> int:
    """Children of a rule whose top is a junction of that kind (entries: and, exits: or); 1 of any other rule, 0 of none."""
    if rule is None:
        return 0
    return len(rule.parts) if getattr(rule, "op", None) == kind else 1


# -- equity and ledgers


def shown_equity(equity: DataFrame, keys: list[str], target: int, bounds: list[int]) -> DataFrame:
    """Some ``target`` points of each curve: both ends, the last point before each bound, and every step between."""
    w = Window.partitionBy(*keys)
    numbered = equity.withColumn("_i", F.row_number().over(w.orderBy("ts_ms")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest((F.col("_n") - 1) / float(max(target - 1, 1)), F.lit(1.0))
    # point i is a step's if some k has floor(k * step) = i; i / step may round up past that k
    k = F.ceil(F.col("_i") / step)
    hit = (F.floor(k * step) == F.col("_i")) | (F.floor((k - 1) * step) == F.col("_i"))
    keep = (F.col("_n") <= target) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | hit
    for b in bounds:
        first = F.min(F.when(F.col("ts_ms") >= b, F.col("_i"))).over(w)
        keep = keep | F.coalesce(F.col("_i") == F.greatest(first - 1, F.lit(0)), F.lit(False))
    return numbered.withColumn("_keep", keep).where("_keep").drop("_i", "_n", "_keep")


def append_segments(*segments: DataFrame) -> DataFrame:
    """Bars of following segments as one series; columns go by name."""
    out = segments[0]
    for s in segments[1:]:
        out = out.unionByName(s)
    return out


def incubation(days: DataFrame, initial: float, least_days: int, daily_loss: float, drawdown: float, least_trades: int, idle: int) -> DataFrame:
    """Per strategy of a daily ledger (strategy, day, starting_balance, ending_balance, trade_count, max_drawdown_percent): sums and blockers."""
    loss = (F.col("ending_balance") - F.col("starting_balance")) / F.col("starting_balance") * 100
    made = days.groupBy("strategy").agg(
        F.count("*").alias("days"),
        F.max_by("ending_balance", "day").alias("ending_balance"),
        F.sum("trade_count").alias("trades"),
        F.greatest(F.max("max_drawdown_percent"), F.lit(0.0)).alias("max_drawdown_percent"),
        F.max(loss < -daily_loss).alias("_loss"),
    )
    joined = made.join(longest_idle(days.select("strategy", "day", "trade_count"), ["strategy"]), "strategy")
    tests = {
        "observation_days": F.col("days") < least_days, "daily_loss": F.col("_loss"), "total_drawdown": F.col("max_drawdown_percent") > drawdown,
        "total_trades": F.col("trades") < least_trades, "trade_frequency": F.col("idle_streak") > idle,
    }
    blockers = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda b: b.isNotNull())
    net = F.col("ending_balance") - initial
    return joined.withColumns({"net_profit": net, "return_percent": net / initial * 100, "blockers": F.array_join(blockers, ","), "passed": F.size(blockers) == 0}).drop("_loss")


def unique_settings(column: Column) -> Column:
    """A list of settings before it is hashed: each once, in order."""
    return F.array_sort(F.array_distinct(column))
