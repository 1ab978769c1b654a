"""Search for rules: typed random generation, mutation, crossover, and an archive that rejects clones.

Rules are small driver-side values; a generation's rules are evaluated by one Spark job (indicator columns are shared,
each rule is a boolean column, and runs are exploded from one row a bar).
"""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .indicators import windowed as I

#: Ladders that generated parameters snap to.
PERIODS = (5, 8, 10, 14, 20, 24, 30, 50, 100)
LEVELS = (0.05, 0.1, 0.2, 0.5, 1.0, 1.5, 2.0)
FAMILIES = ("trend", "momentum", "breakout", "reversion", "zscore", "impulse", "sweep")


def feature_columns(names: set[str]) -> dict:
    """Builders of the indicator columns that rules name: kind_period."""
    makers = {"sma": lambda n: I.sma("close", n), "roc": lambda n: I.rate_of_change("close", n), "dch": I.donchian_high, "dcl": I.donchian_low, "z": lambda n: I.zscore("close", n), "pct": lambda n: I.percentile_in_range("close", n), "sweep": I.sweep_score}
    out = {}
    for name in sorted(names):
        kind, _, n = name.partition("_")
        if kind in makers and n.isdigit():
            out[name] = makers[kind](int(n))
    return out | ({"body": I.body_range_ratio()} if "body" in names else {}) | ({"place": I.close_location()} if "place" in names else {})


def names_of(rule) -> set[str]:
    if isinstance(rule, R.Test):
        return {v.name for v in (rule.left, rule.right, rule.upper) if v is not None and v.kind == "indicator"}
    return set().union(*(names_of(p) for p in rule.parts))


def atom(family: str, rng: random.Random, long: bool = True) -> R.Test:
    """One comparison of a family; the short side mirrors the long one."""
    n, level = rng.choice(PERIODS), rng.choice(LEVELS)
    close = R.Value("price", "close")
    ind = lambda name, shift=1: R.Value("indicator", name, shift)
    const = lambda v: R.Value("constant", value=v)
    above, below = ("gt", "lt") if long else ("lt", "gt")
    sign = 1 if long else -1
    return {
        "trend": lambda: R.Test(above, close, ind(f"sma_{n}")),
        "momentum": lambda: R.Test(above, ind(f"roc_{n}"), const(sign * level)),
        "breakout": lambda: R.Test(above, close, ind(f"{'dch' if long else 'dcl'}_{n}", 2)),
        "reversion": lambda: R.Test(below, ind(f"pct_{n}"), const(15.0 if long else 85.0)),
        "zscore": lambda: R.Test(below, ind(f"z_{n}"), const(-sign * (1 + level))),
        "impulse": lambda: R.Test("gt", ind("body"), const(0.55)),
        "sweep": lambda: R.Test(above, ind(f"sweep_{n}"), const(sign * 0.5)),
    }[family]()


def generate(seed: int, conditions: int = 2, family: str | None = None, long: bool = True):
    """A random rule: ``conditions`` atoms joined by and."""
    rng = random.Random(seed)
    parts = tuple(atom(family or rng.choice(FAMILIES), rng, long) for _ in range(conditions))
    return parts[0] if conditions == 1 else R.Junction("and", parts)


def mutate(rule, seed: int):
    """One change: a constant scaled, a period moved along its ladder, or an atom replaced."""
    rng = random.Random(seed)
    if isinstance(rule, R.Junction):
        k = rng.randrange(len(rule.parts))
        fresh = atom(rng.choice(FAMILIES), rng) if rng.random() < 0.3 else mutate(rule.parts[k], rng.randrange(1 << 30))
        return replace(rule, parts=(*rule.parts[:k], fresh, *rule.parts[k + 1 :]))
    for side in ("right", "left"):
        v = getattr(rule, side)
        if v.kind == "constant":
            return replace(rule, **{side: replace(v, value=v.value * rng.uniform(0.8, 1.25))})
        kind, _, n = v.name.partition("_")
        if v.kind == "indicator" and n.isdigit() and int(n) in PERIODS:
            at = PERIODS.index(int(n)) + rng.choice((-1, 1))
            return replace(rule, **{side: replace(v, name=f"{kind}_{PERIODS[max(0, min(at, len(PERIODS) - 1))]}")})
    return rule


def crossover(a, b, seed: int):
    rng = random.Random(seed)
    parts = [*(a.parts if isinstance(a, R.Junction) else (a,)), *(b.parts if isinstance(b, R.Junction) else (b,))]
    rng.shuffle(parts)
    picked = tuple(parts[: max(2, len(parts) // 2)])
    return R.Junction("and", picked) if len(picked) > 1 else picked[0]


def trim(rule, most: int = R.CHILDREN[1]):
    """Drops parts until a rule keeps its limits."""
    while isinstance(rule, R.Junction):
        try:
            R.check(rule)
            return rule
        except ValueError:
            if len(rule.parts) <= 2:
                return rule.parts[0]
            rule = replace(rule, parts=rule.parts[:-1][:most])
    return rule


def complexity(rule) -> int:
    return R.check(rule)


def signals(bars: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Bars once for each rule, run_id symbol|rule and the rule's decision as ``long``; features are computed once for all."""
    names = set().union(*(names_of(r) for r in rules.values())) if rules else set()
    wide = bars.withColumns(feature_columns(names)) if names else bars
    tests = F.array(*[F.struct(F.lit(k).alias("rule"), r.column().alias("long")) for k, r in rules.items()])
    decided = wide.select(*bars.columns, tests.alias("_t"))
    return decided.withColumn("_e", F.explode("_t")).select(*bars.columns, F.concat_ws("|", "symbol", "_e.rule").alias("run_id"), F.col("_e.long").alias("long"))


def deposit(archive: list[dict], candidates: list[dict], most: float = 0.9) -> list[dict]:
    """Adds candidates in their order unless their fingerprint is known or their signature correlates above ``most``; novelty is 1 less the largest correlation.

    Sequential by definition; the archive is a few hundred elites.
    """
    kept = list(archive)
    for c in candidates:
        if any(c["fingerprint"] == e["fingerprint"] for e in kept):
            continue
        closest = max((correlation(c["signature"], e["signature"]) for e in kept), default=0.0)
        if closest <= most:
            kept.append(c | {"novelty": 1 - closest})
    return kept


def correlation(a: list[float], b: list[float]) -> float:
    n = min(len(a), len(b))
    if n < 2 or np.std(a[:n]) < 1e-12 or np.std(b[:n]) < 1e-12:
        return 0.0
    return float(np.corrcoef(a[:n], b[:n])[0, 1])


def champion(a: dict, b: dict) -> dict:
    """By evidence, then novelty, lower complexity, and more trades."""
    key = lambda e: (e["evidence"], e.get("novelty", 0.0), -e["complexity"], e["trades"])
    return a if key(a) >= key(b) else b


def tournament(pool: list[dict], k: int, weight: float, seed: int) -> dict:
    rng = random.Random(seed)
    return max((rng.choice(pool) for _ in range(k)), key=lambda e: e["evidence"] + weight * e.get("novelty", 0.0))
