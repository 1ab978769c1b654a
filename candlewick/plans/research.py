"""Registered queries of costs, portfolios and studies, and the same in DuckDB's SQL; registry.py adds them to its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.numeric import settle
from ..operators import costs as C
from ..operators import metrics as M
from ..operators import portfolio as O
from ..operators import replay as Y
from ..operators import robustness as Z
from ..operators import stats as S
from ..operators import studies as D
from . import tables as T
from .registry import _RUN, BARS, TRADES, _decisions, _REPLAY, query, s6, values

# -- costs

_BROKER = {"point": 0.001, "tick_size": 0.001, "tick_value": 0.7, "contract_size": 1000.0, "account": "EUR", "profit": "JPY", "base": "EUR", "margin": "EUR", "swap_long": -2.5, "swap_short": 1.25}
_RATE = "CASE WHEN side = 'long' THEN -2.5 ELSE 1.25 END"
_CASH = {
    "disabled": "0", "points": f"{_RATE} * 0.7", "deposit_currency": _RATE, "profit_currency": f"{_RATE} * (0.7 / (0.001 * 1000))", "symbol_currency": _RATE, "margin_currency": _RATE,
    "interest_current": f"{_RATE} / 100 / 360 * 1000 * price * (0.7 / (0.001 * 1000))", "interest_open": f"{_RATE} / 100 / 360 * 1000 * entry_price * (0.7 / (0.001 * 1000))",
}


@query(f"WITH {TRADES}, x AS (SELECT *, entry_price * 1.01 AS price, bars_held // 24 AS days FROM trades) SELECT trade_no, " + ", ".join(f"{s6(f'{v} * 0.1 * days')} AS {k}" for k, v in _CASH.items()) + " FROM x")
def swap_modes(spark, sf_dir):
    t = T.trades(spark, sf_dir).withColumns({"price": F.col("entry_price") * 1.01, "days": F.floor(F.col("bars_held") / 24)})
    made = {m: C.swap_cash(F.col("side"), F.lit(0.1), F.col("entry_price"), F.col("price"), F.col("days"), _BROKER | {"swap_mode": m}) for m in C.SWAP_MODES}
    return values(t, ["trade_no"], made)


@query(f"WITH {TRADES} SELECT trade_no, {s6('CASE WHEN entry_price > 0 THEN 1 / entry_price ELSE 0.7 END')} AS by_price, {s6('entry_price * 0.01 * CASE side WHEN $$long$$ THEN 1 ELSE -1 END * 1000 / (entry_price * 1.01) * 0.1')} AS gross FROM trades")
def currency_conversion(spark, sf_dir):
    t, price = T.trades(spark, sf_dir), F.col("entry_price")
    return values(t, ["trade_no"], {"by_price": C.profit_to_account(price, _BROKER), "gross": C.gross_profit(F.col("side"), price, price * 1.01, F.lit(0.1), _BROKER)})


# -- portfolios

_SIG = "g AS (SELECT vec_id AS id, label AS cohort, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT id, cohort, unnest(v) / 100 AS x, generate_subscripts(v, 1) - 1 AS idx FROM g)"


@query(f"WITH {_SIG}, c AS (SELECT *, 1 + sum(x) OVER (PARTITION BY id ORDER BY idx) AS e FROM u), p AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY id ORDER BY idx)) AS top FROM c) SELECT id, {s6('max((top - e) / top * 100)')} AS drawdown, {s6('max(e) FILTER (idx = 4)')} AS fifth, {s6('avg(x) / stddev_samp(x) * sqrt(count(*))')} AS sharpe FROM p GROUP BY 1")
def path_drawdown(spark, sf_dir):
    e = T.signatures(spark, sf_dir).withColumn("r", F.transform("signature", lambda x: x / 100))
    return values(e, ["id"], {"drawdown": O.path_drawdown(F.col("r")), "fifth": F.element_at(O.path(F.col("r")), 5), "sharpe": O.signature_sharpe(F.col("r"))})


_STRESS = f"""{_SIG}, m AS (SELECT cohort, idx, avg(x) AS value FROM u GROUP BY 1, 2), c AS (SELECT cohort, count(*) AS n FROM m GROUP BY 1),
q0 AS (SELECT *, {draws.trial_keys_sql(42, {"a": draws.HIGH, "b": draws.LOW})} FROM (SELECT cohort, n, unnest(range(0, 1000)) AS trial FROM c)), q AS (SELECT *, unnest(range(0, n)) AS pos FROM {draws.mixed_sql("q0", ["a", "b"])}),
p0 AS (SELECT cohort, n, trial, pos, {draws.counted_sql("a", "pos // 5")}, {draws.counted_sql("b", "pos // 5")} FROM q), d AS (SELECT cohort, trial, pos, ({draws.index_sql("n")} + pos % 5) % n AS idx FROM {draws.mixed_sql("p0", ["a", "b"])}),
j AS (SELECT d.cohort, trial, pos, value FROM d JOIN m USING (cohort, idx)),
e AS (SELECT *, 1 + sum(value) OVER (PARTITION BY cohort, trial ORDER BY pos) AS e FROM j), h AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY cohort, trial ORDER BY pos)) AS top FROM e),
k AS (SELECT cohort, trial, sum(value) * 100 AS ret, max((top - e) / top * 100) AS dd FROM h GROUP BY 1, 2), l AS (SELECT cohort, list_sort(list(ret)) AS r, list_sort(list(dd)) AS d FROM k GROUP BY 1)"""


@query(f"WITH {_STRESS} SELECT cohort, len(r)::INT AS trials, {s6('r[51]')} AS p05_return, {s6('list_sum(r[1:50]) / 50')} AS cvar_return, {s6('d[950]')} AS p95_drawdown FROM l")
def portfolio_stress(spark, sf_dir):
    """Equal-weight portfolios of each cohort, a thousand resampled paths."""
    e = T.signatures(spark, sf_dir).select("cohort", F.posexplode("signature").alias("idx", "x"))
    mean = e.groupBy("cohort", F.col("idx").cast("long").alias("idx")).agg(F.avg(F.col("x") / 100).alias("value"))
    return values(O.stress_report(O.stress(mean, ["cohort"]), ["cohort"]), ["cohort", "trials"], {c: c for c in ("p05_return", "cvar_return", "p95_drawdown")})


@query("SELECT c_custkey AS n, " + s6("c_acctbal / 1000 - CASE WHEN c_custkey > 1 THEN sqrt(2 * ln(c_custkey)) - (ln(ln(c_custkey)) + ln(4 * pi())) / (2 * sqrt(2 * ln(c_custkey))) ELSE 0 END") + " AS deflated FROM customer")
def deflated_sharpe(spark, sf_dir):
    n = F.col("c_custkey")
    return T.load(spark, sf_dir, "customer").select(n.alias("n"), settle(S.deflated_sharpe(F.col("c_acctbal") / 1000, n)).alias("deflated"))


# -- factor grids

_DRAWS = """dr AS (SELECT o_orderkey % 3 + 2 AS entry_conditions, o_custkey % 2 + 1 AS exit_conditions, o_orderpriority AS recipe, o_totalprice > 100000 AS screened, o_orderkey % 7 > 2 AS picked, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / 200000 END AS retention, o_totalprice / 1000 - 100 AS oos_expectancy, o_custkey % 11 AS complexity, o_totalprice / 1000 AS is_expectancy FROM orders)"""


def _draws(spark, sf_dir):
    o = T.load(spark, sf_dir, "orders")
    price, cust, key = F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderkey")
    return o.select(
        (key % 3 + 2).alias("entry_conditions"), (cust % 2 + 1).alias("exit_conditions"), F.col("o_orderpriority").alias("recipe"), (price > 100_000).alias("screened"), (key % 7 > 2).alias("picked"),
        F.when(cust % 5 > 0, price / 200_000).alias("retention"), (price / 1000 - 100).alias("oos_expectancy"), (cust % 11).alias("complexity"), (price / 1000).alias("is_expectancy"),
    )


@query(
    f"WITH {_DRAWS}, c AS (SELECT entry_conditions, exit_conditions, recipe, count(*) AS draws, count(*) FILTER (screened) AS n_screened, coalesce(count(*) FILTER (screened AND picked) / nullif(count(*) FILTER (screened), 0), 0) AS pr, median(retention) FILTER (screened) AS mr, median(oos_expectancy) FILTER (screened) AS mo, median(complexity) FILTER (screened) AS mc FROM dr GROUP BY 1, 2, 3) SELECT entry_conditions, exit_conditions, recipe, draws, n_screened, {s6('pr')} AS pass_rate, {s6('mr')} AS median_retention, {s6('mo')} AS median_oos, {s6('mc')} AS median_complexity, row_number() OVER (ORDER BY pr DESC, mr DESC NULLS LAST, entry_conditions, exit_conditions, recipe)::INT AS place FROM c"
)
def factor_cells(spark, sf_dir):
    return values(D.factor_cells(_draws(spark, sf_dir)), ["entry_conditions", "exit_conditions", "recipe", "draws", "n_screened", "place"], {c: c for c in ("pass_rate", "median_retention", "median_oos", "median_complexity")})


@query(
    f"WITH {_DRAWS}, b AS (SELECT entry_conditions, median(is_expectancy / 100) AS mi, median(oos_expectancy / 100) AS mo, median(CASE WHEN is_expectancy > 0 THEN oos_expectancy / is_expectancy END) AS mr, count(*) FILTER (picked) / count(*) AS pr, count(*) AS tested FROM dr WHERE screened GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY mr DESC, mo DESC, entry_conditions)::INT AS place, tested >= 10 AND pr >= 0.5 AND mr >= 0.7 AND mo > 0 AS fit FROM b) SELECT entry_conditions, {s6('mi')} AS median_is, {s6('mo')} AS median_oos, {s6('mr')} AS median_retention, {s6('pr')} AS pass_rate, tested, place, fit AND place = (SELECT min(place) FROM p WHERE fit) AS recommended FROM p"
)
def bake_off(spark, sf_dir):
    return values(D.bake_off(_draws(spark, sf_dir).where("screened")), ["entry_conditions", "tested", "place", "recommended"], {c: c for c in ("median_is", "median_oos", "median_retention", "pass_rate")})


@query(
    f"WITH {_DRAWS}, r AS (SELECT recipe, count(*) AS n, median(retention) AS m, count(*) FILTER (picked) / count(*) AS p FROM dr WHERE screened AND retention IS NOT NULL GROUP BY 1) SELECT a.recipe, a.n, {s6('a.m')} AS median_retention, {s6('a.p')} AS pass_rate, b.n AS base_n, {s6('b.m')} AS base_median_retention, {s6('b.p')} AS base_pass_rate FROM r a, r b WHERE a.recipe <> '1-URGENT' AND b.recipe = '1-URGENT'"
)
def factor_contrasts(spark, sf_dir):
    return values(D.contrasts(_draws(spark, sf_dir), "1-URGENT"), ["recipe", "n", "base_n"], {c: c for c in ("median_retention", "pass_rate", "base_median_retention", "base_pass_rate")})


# -- screens and batteries

_GATE = (20, 60.0, 0.0, 1.0)


@query(
    f"""WITH {TRADES}, k AS (SELECT run_id AS strategy, CASE trade_no % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS symbol, * FROM trades), b AS (SELECT *, 10000 + sum(net_profit) OVER (PARTITION BY strategy, symbol ORDER BY exit_ms, trade_no ROWS UNBOUNDED PRECEDING) AS bal FROM k),
t AS (SELECT *, greatest(10000, max(bal) OVER (PARTITION BY strategy, symbol ORDER BY exit_ms, trade_no ROWS UNBOUNDED PRECEDING)) AS top FROM b),
sm AS (SELECT strategy, symbol, count(*) AS trades, sum(net_profit) AS net, sum(net_profit) FILTER (net_profit > 0) / -sum(net_profit) FILTER (net_profit < 0) AS pf, max((top - bal) / top * 100) AS dd FROM t GROUP BY 1, 2),
g AS (SELECT *, trades >= 20 AND net > 0 AND dd <= 60 AND coalesce(pf, CASE WHEN net > 0 THEN 1e9 ELSE 0 END) >= 1 AS passed FROM sm)
SELECT strategy, symbol, symbol = 'A' AS is_primary, trades, passed, count(*) FILTER (passed) OVER (PARTITION BY strategy) AS passing, floor(coalesce(sum(net) FILTER (passed) OVER (PARTITION BY strategy), 0) * 100 + 0.5) / 100 AS pooled_profit FROM g"""
)
def symbol_screen(spark, sf_dir):
    n = F.col("trade_no") % 3
    t = T.trades(spark, sf_dir).withColumn("strategy", F.col("run_id")).withColumn("symbol", F.when(n == 0, "A").when(n == 1, "B").otherwise("C"))
    r = D.symbol_screen(t, D.passing(*_GATE), "A")
    return r.select("strategy", "symbol", "is_primary", "trades", "passed", "passing", settle(F.col("pooled_profit"), 100.0).alias("pooled_profit"))


def _measured(trades, keys):
    return M.trade_metrics(trades, keys).withColumn("return_percent", F.col("net_profit") / 100)


_FOLDS = 5


def _folded(spark, sf_dir):
    trades = Y.replay(D.fold_signals(_decisions(spark, sf_dir), _FOLDS, 20, 60), _REPLAY)
    run, fold = F.regexp_extract("run_id", r"^(.*)\|f\d+$", 1), F.regexp_extract("run_id", r"\|f(\d+)$", 1).cast("int")
    return trades.withColumn("fold", fold).withColumn("run_id", run)


@query()
def walk_forward(spark, sf_dir):
    """Metrics of each run in each purged fold; entries only from the fold's start."""
    m = _measured(_folded(spark, sf_dir), ["run_id", "fold"])
    return m.select("run_id", "fold", "trades", settle(F.col("net_profit")).alias("net_profit"), settle(F.col("max_drawdown_percent")).alias("max_drawdown_percent"), F.coalesce(D.passing(3, 30.0, 0.0, 1.0), F.lit(False)).alias("passed"))


@query()
def challenge_battery(spark, sf_dir):
    """Blockers of each run's battery: baseline, purged folds, cost shocks, wider and narrower stops, resampling."""
    decided = _decisions(spark, sf_dir)
    trades = Y.replay(decided, _REPLAY)
    base = _measured(trades, ["run_id"])
    fits = D.passing(3, 30.0, 0.0, 1.0)
    folds = D.survival(_measured(_folded(spark, sf_dir), ["run_id", "fold"]), ["run_id"], _FOLDS, fits, "folds")
    original, variant = F.regexp_extract("run_id", r"^(.*)\|[^|]*$", 1), F.regexp_extract("run_id", r"\|([^|]*)$", 1)
    shocked = Y.replay(Z.cost_shocks(decided, [1.0, 1.25, 1.5, 2.0], 0.01), _REPLAY).withColumn("variant", variant).withColumn("run_id", original)
    shocks = D.survival(_measured(shocked, ["run_id", "variant"]), ["run_id"], 4, fits, "shocks")
    steps = F.explode(F.array(*[F.lit(x) for x in (0.9, 0.95, 1.05, 1.1)]))
    moved = decided.withColumn("_k", steps).withColumn("stop_distance", F.col("stop_distance") * F.col("_k")).withColumn("target_distance", F.col("target_distance") * F.col("_k")).withColumn("run_id", F.concat_ws("|n", "run_id", F.col("_k").cast("string"))).drop("_k")
    near = Y.replay(moved, _REPLAY).withColumn("variant", variant).withColumn("run_id", original)
    joined = _measured(near, ["run_id", "variant"]).join(base.select("run_id", *[F.col(c).alias(f"base_{c}") for c in ("return_percent", "max_drawdown_percent", "trades")]), "run_id")
    neighbours = D.survival(joined, ["run_id"], 4, Z.survives(), "neighbours")
    idx = (F.row_number().over(Window.partitionBy("run_id").orderBy("trade_no")) - 1).cast("long")
    profits = trades.select("run_id", idx.alias("idx"), F.col("net_profit").alias("profit"))
    resampled = S.resampling_report(S.block_bootstrap(profits, ["run_id"]), ["run_id"], S.profit_path(profits, ["run_id"]))
    made = D.challenge(base, folds, shocks, neighbours, resampled, 4)
    return made.select("run_id", "trades", settle(F.col("net_profit")).alias("net_profit"), settle(F.col("deflated_sharpe")).alias("deflated_sharpe"), F.array_join("blockers", ",").alias("blockers"), "passed")


@query()
def sealed_final(spark, sf_dir):
    """Trades opened in the last fifth of each run's bars, all bars before being context, under the sealed gates."""
    w = Window.partitionBy("run_id")
    d = _decisions(spark, sf_dir).withColumn("_i", F.row_number().over(w.orderBy("ts_ms"))).withColumn("_n", F.count(F.lit(1)).over(w))
    sealed = d.withColumn("tradable", F.col("tradable") & (F.col("_i") > F.floor(F.col("_n") * 0.8))).drop("_i", "_n")
    m = _measured(Y.replay(sealed, _REPLAY), ["run_id"])
    return m.select("run_id", "trades", settle(F.col("net_profit")).alias("net_profit"), F.coalesce(D.passing(10, 25.0, 0.0, 1.05), F.lit(False)).alias("passed"))


#: Synthetic series in SQL: draws of where blocks end and begin, the returns they fetch, and the closes.
_SYNTHETIC = f"""{BARS}, n AS (SELECT *, row_number() OVER w - 1 AS i, ln(greatest(close, 1e-12)) - ln(greatest(lag(close) OVER w, 1e-12)) AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)), c AS (SELECT symbol, count(*) - 1 AS m, arg_min(close, i) AS c0 FROM n GROUP BY 1),
q0 AS (SELECT *, {draws.trial_keys_sql(7, {"a": draws.HIGH, "b": draws.LOW, "g": draws.TURN})} FROM (SELECT symbol, m, c0, unnest(range(0, 3)) AS trial FROM c)), q AS (SELECT * FROM {draws.mixed_sql("q0", ["a", "b", "g"])}),
g0 AS (SELECT symbol, m, c0, trial, i, a, b, {draws.counted_sql("g", "i")} FROM q JOIN n USING (symbol) WHERE i > 0), s AS (SELECT *, max(CASE WHEN i = 1 OR g < {round(2**32 / 24)} THEN i END) OVER (PARTITION BY symbol, trial ORDER BY i) AS s FROM {draws.mixed_sql("g0", ["g"])}),
b0 AS (SELECT * REPLACE ({draws.counted_sql("a", "bg")}, {draws.counted_sql("b", "bg")}) FROM (SELECT *, s + (i - s) // 96 * 96 AS bg FROM s)), f AS (SELECT symbol, trial, c0, i, 1 + ({draws.index_sql("m")} + i - bg) % m AS src FROM {draws.mixed_sql("b0", ["a", "b"])}),
y0 AS (SELECT f.symbol, trial, f.i, ln(greatest(c0, 1e-12)) + sum(r) OVER (PARTITION BY f.symbol, trial ORDER BY f.i) AS y, c0 FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.src), y AS (SELECT *, exp(y + greatest(ln(1e-12) - min(y) OVER (PARTITION BY symbol, trial ORDER BY i), 0)) AS c FROM y0), z AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY symbol, trial ORDER BY i), c0) AS o FROM y),
syn AS (SELECT n.symbol, q.trial::INT AS trial, n.ts_ms, CASE WHEN n.i = 0 THEN n.open ELSE o END AS open, CASE WHEN n.i = 0 THEN n.high ELSE greatest(o, c) * 1.0001 END AS high, CASE WHEN n.i = 0 THEN n.low ELSE least(o, c) * 0.9999 END AS low, CASE WHEN n.i = 0 THEN n.close ELSE c END AS close, n.tick_volume, n.spread_points FROM n JOIN q USING (symbol) LEFT JOIN z ON z.symbol = n.symbol AND z.trial = q.trial AND z.i = n.i)"""


@query(f"WITH {_SYNTHETIC} SELECT symbol, trial, ts_ms, {s6('ln(open)')} AS ln_open, {s6('ln(high)')} AS ln_high, {s6('ln(low)')} AS ln_low, {s6('ln(close)')} AS ln_close, tick_volume, spread_points FROM syn")
def stationary_bars(spark, sf_dir):
    """Three synthetic series of every symbol's hours, in blocks of a day on average; prices as logarithms, as paths reach 1e12."""
    made = Z.stationary_bars(T.hourly(spark, sf_dir), 3, 24, 7)
    return values(made, ["symbol", "trial", "ts_ms", "tick_volume", "spread_points"], {f"ln_{k}": F.log(k) for k in ("open", "high", "low", "close")})


@query()
def permutation_null(spark, sf_dir):
    """95th percentiles of the best run's metrics over synthetic series of every symbol, each replayed under the same rules."""
    made = Z.stationary_bars(T.hourly(spark, sf_dir), 20, 24, 7)
    bars = made.withColumn("symbol", F.concat_ws("#", "symbol", F.col("trial").cast("string")))
    trades = Y.replay(_decisions(spark, sf_dir, bars), _REPLAY).withColumn("trial", F.regexp_extract("run_id", r"#(\d+)\|", 1).cast("int"))
    r = D.null_of_best(trades)
    return r.select("trials", *[settle(F.col(c)).alias(c) for c in r.columns[1:]])


# -- archives

_ELITES = "el AS (SELECT 'S' || c_custkey AS id, lower(hex(c_custkey)) AS fingerprint, c_mktsegment AS grade, c_nationkey AS cohort, c_acctbal / 100 AS evidence, c_custkey % 7 AS novelty, c_custkey % 13 AS trades, c_custkey % 9 AS drawdown, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 END AS sharpe, CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 6 END AS recovery_factor, c_custkey % 3 AS entry_conditions, c_custkey % 2 AS exit_conditions FROM customer)"


def _elites(spark, sf_dir):
    k = F.col("c_custkey")
    return T.load(spark, sf_dir, "customer").select(
        F.concat(F.lit("S"), k.cast("string")).alias("id"), F.lower(F.hex(k)).alias("fingerprint"), F.col("c_mktsegment").alias("grade"), F.col("c_nationkey").alias("cohort"), (F.col("c_acctbal") / 100).alias("evidence"),
        (k % 7).alias("novelty"), (k % 13).alias("trades"), (k % 9).alias("drawdown"), F.when(k % 4 > 0, k % 4).alias("sharpe"), F.when(k % 6 > 0, k % 6).alias("recovery_factor"), (k % 3).alias("entry_conditions"), (k % 2).alias("exit_conditions"),
    )


@query(f"WITH {_ELITES} SELECT cohort, count(*) AS elites, floor(sum(greatest(evidence, 0)) * 1e4 + 0.5) / 1e4 AS qd_score FROM el GROUP BY 1")
def qd_score(spark, sf_dir):
    return D.qd_score(_elites(spark, sf_dir), ["cohort"]).withColumn("qd_score", settle(F.col("qd_score"), 1e4))


def _order_sql(sort: str) -> str:
    return ", ".join([f"{k.lstrip('-')} {'DESC' if k.startswith('-') else 'ASC'} NULLS LAST" for k in D.ELITE_SORTS[sort]] + ["id"])


@query(f"WITH {_ELITES} " + " UNION ALL ".join(f"SELECT '{s}' AS sort, row_number() OVER (ORDER BY {_order_sql(s)})::INT AS place, id FROM el WHERE entry_conditions = 1 AND (contains(lower(id), '7') OR contains(fingerprint, '7'))" for s in D.ELITE_SORTS))
def elite_table(spark, sf_dir):
    """All eight orders of the elites that match a text and a number of conditions, with their places."""
    return D.places(D.matching(_elites(spark, sf_dir), "7", 1))


@query(f"WITH {TRADES}, r AS (SELECT run_id, trade_no, row_number() OVER (PARTITION BY run_id ORDER BY trade_no) AS k FROM trades) SELECT run_id, trade_no FROM r WHERE k <= 2000")
def trade_list(spark, sf_dir):
    return D.first_trades(T.trades(spark, sf_dir), ["run_id"]).select("run_id", "trade_no")


_KINDS = ("accepted", "replaced", "rejected_gate", "rejected_clone", "rejected_correlated")


@query("WITH d AS (SELECT l_returnflag AS arm, l_orderkey % 5 AS k FROM lineitem) SELECT arm, " + ", ".join(f"count(*) FILTER (k = {i}) AS {k}" for i, k in enumerate(_KINDS)) + " FROM d GROUP BY 1")
def decision_tally(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    li = T.load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("arm"), F.element_at(kinds, (F.col("l_orderkey") % 5 + 1).cast("int")).alias("decision"))
    return D.tally(li, _KINDS, ["arm"])


@query("WITH v AS (SELECT abs(l_discount * 400 - l_tax * 100) AS x FROM lineitem), e(bucket, low, high) AS (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1, 2), (2, 2, 5), (3, 5, 10), (4, 10, 25), (5, 25, 1e300)) SELECT bucket, low, (SELECT count(*) FROM v WHERE x >= low AND x < high) AS n FROM e")
def deviation_histogram(spark, sf_dir):
    return D.histogram(T.load(spark, sf_dir, "lineitem").select(F.abs(F.col("l_discount") * 400 - F.col("l_tax") * 100).alias("x")), "x", [1, 2, 5, 10, 25])


@query("SELECT p_brand AS brand, p_size AS size, count(*) AS n, min(p_name) AS first FROM part GROUP BY 1, 2")
def config_groups(spark, sf_dir):
    p = T.load(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_name")
    return D.config_groups(p, ["brand", "size"], "p_name")


_HINTS = ("trend", "momentum_burst", "breakout", "mean_reversion", "z_score_reversion", "session_orb", "unheard of", "universal")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(("trend_pullback", "momentum_burst", "donchian_breakout", "mean_reversion_band", "zscore_reversion", "session_orb", "trend_pullback", "universal"))) + " END AS family FROM orders")
def rule_family(spark, sf_dir):
    hint = F.element_at(F.array(*[F.lit(h) for h in _HINTS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return T.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), D.family(hint).alias("family"))


# -- equity and ledgers


@query(
    f"""WITH {BARS}, n AS (SELECT symbol, ts_ms, 10000 + sum(close - open) OVER (PARTITION BY symbol ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS equity, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
s AS (SELECT DISTINCT symbol, floor(unnest(range(0, 50)) * greatest((n - 1) / 49.0::DOUBLE, 1))::BIGINT AS i FROM n UNION SELECT symbol, n - 1 FROM n UNION SELECT symbol, greatest(min(i) - 1, 0) FROM n WHERE ts_ms >= 1704844800000 GROUP BY 1 UNION SELECT symbol, greatest(min(i) - 1, 0) FROM n WHERE ts_ms >= 1705708800000 GROUP BY 1)
SELECT symbol, ts_ms, {s6("equity")} AS equity FROM n JOIN s USING (symbol, i)"""
)
def equity_shown(spark, sf_dir):
    e = D.shown_equity(T.equity(spark, sf_dir), ["symbol"], 50, [1_704_844_800_000, 1_705_708_800_000])
    return values(e, ["symbol", "ts_ms"], {"equity": "equity"})


@query(f"WITH {BARS} SELECT symbol, ts_ms, close FROM bars WHERE ts_ms < 1705708800000")
def append_segments(spark, sf_dir):
    b = T.hourly(spark, sf_dir)
    first, later = b.where("ts_ms < 1704844800000"), b.where("ts_ms >= 1704844800000 and ts_ms < 1705708800000")
    return D.append_segments(first, later).select("symbol", "ts_ms", "close")


@query(
    """WITH d AS (SELECT user_id AS strategy, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS n, (abs(hash_k) % 40) / 10.0 AS dd FROM (SELECT *, user_id * 7 + extract(day FROM ts) AS hash_k FROM events) GROUP BY user_id, ts::DATE, hash_k),
b AS (SELECT *, 10000 + sum(n * 10 - 8) OVER (PARTITION BY strategy ORDER BY day) AS e FROM d), s AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY strategy ORDER BY day), 10000) AS st, row_number() OVER (PARTITION BY strategy ORDER BY day) - sum((n = 0)::INT) OVER (PARTITION BY strategy ORDER BY day ROWS UNBOUNDED PRECEDING) AS k FROM b),
z AS (SELECT strategy, max(m) AS idle FROM (SELECT strategy, k, count(*) AS m FROM s WHERE n = 0 GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT strategy, count(*) AS days, arg_max(e, day) AS last, sum(n)::BIGINT AS trades, greatest(max(dd), 0) AS dd, bool_or((e - st) / st * 100 < -0.05) AS loss FROM s GROUP BY 1)
SELECT strategy, days, trades, coalesce(idle, 0) AS idle_streak, floor((last - 10000) * 100 + 0.5) / 100 AS net_profit, concat_ws(',', CASE WHEN days < 10 THEN 'observation_days' END, CASE WHEN loss THEN 'daily_loss' END, CASE WHEN dd > 3.5 THEN 'total_drawdown' END, CASE WHEN trades < 3 THEN 'total_trades' END, CASE WHEN coalesce(idle, 0) > 6 THEN 'trade_frequency' END) AS blockers,
NOT (days < 10 OR loss OR dd > 3.5 OR trades < 3 OR coalesce(idle, 0) > 6) AS passed FROM a LEFT JOIN z USING (strategy)"""
)
def incubation_report(spark, sf_dir):
    e = T.load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("strategy"), F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("trade_count"))
    e = e.withColumn("max_drawdown_percent", (F.abs(F.col("strategy") * 7 + F.dayofmonth("day")) % 40) / 10)
    w = Window.partitionBy("strategy").orderBy("day")
    e = e.withColumn("ending_balance", F.lit(10_000.0) + F.sum(F.col("trade_count") * 10 - 8).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("starting_balance", F.coalesce(F.lag("ending_balance").over(w), F.lit(10_000.0)))
    r = D.incubation(e, 10_000.0, 10, 0.05, 3.5, 3, 6)
    return r.select("strategy", "days", "trades", "idle_streak", settle(F.col("net_profit"), 100.0).alias("net_profit"), "blockers", "passed")
