"""Comparison of two runs: trades, equity paths, metrics, and indicator buffers against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import divide


def indicator_diff(ours: DataFrame, reference: DataFrame, keys: list[str], columns: list[str], absolute: float, relative: float, warmup: int = 0) -> DataFrame:
    """(indicator, compared, mismatches, max_abs): values that differ by more than absolute + relative * |expected|, after each symbol's first ``warmup`` rows.

    One join for all indicators; a value that only one side has is a mismatch.
    """
    w = Window.partitionBy(*[k for k in keys if k != "ts_ms"]).orderBy("ts_ms")
    theirs = reference.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    both = ours.select(*keys, *columns).withColumn("_at", F.row_number().over(w)).where(F.col("_at") > warmup).join(theirs, keys)
    pairs = both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).cast("double").alias("a"), F.col(f"_{c}").cast("double").alias("b")) for c in columns])).alias("p")).select("p.*")
    off = F.abs(F.col("a") - F.col("b"))
    one_sided = F.col("a").isNull() != F.col("b").isNull()
    return pairs.groupBy("indicator").agg(
        F.count_if(F.col("a").isNotNull() | F.col("b").isNotNull()).alias("compared"),
        F.count_if(one_sided | (off > absolute + relative * F.abs(F.col("b")))).alias("mismatches"),
        F.coalesce(F.max(off), F.lit(0.0)).alias("max_abs"),
    )


def equity_divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Largest and mean gap of two equity paths at their common times, in percent of the first."""
    both = a.select(*keys, "ts_ms", F.col("equity").alias("_a")).join(b.select(*keys, "ts_ms", F.col("equity").alias("_b")), [*keys, "ts_ms"])
    gap = F.abs(divide(F.col("_b") - F.col("_a"), F.col("_a"))) * 100
    return both.groupBy(*keys).agg(F.count("*").alias("points"), F.max(gap).alias("max_gap_percent"), F.avg(gap).alias("mean_gap_percent"))


def run_diff(ours: DataFrame, theirs: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Metrics of two runs side by side: per metric a relative difference in percent, and passed if all are within their tolerance."""
    names = list(tolerances)
    both = ours.select(*keys, *names).join(theirs.select(*keys, *[F.col(n).alias(f"_{n}") for n in names]), keys, "full")
    off = {n: F.when(F.col(n) == F.col(f"_{n}"), 0.0).otherwise(F.abs(divide(F.col(f"_{n}") - F.col(n), F.col(n))) * 100) for n in names}
    out = both.select(*keys, *[off[n].alias(f"{n}_off") for n in names])
    passed = F.lit(True)
    for n, t in tolerances.items():
        passed = passed & F.coalesce(F.col(f"{n}_off") <= t, F.lit(False))
    return out.withColumn("passed", passed)


def retest_report(baseline: DataFrame, export: DataFrame, name: str, columns: list[str], tolerance: float) -> DataFrame:
    """OK, MISMATCH or MISSING by name: the worst percent difference of the columns. Names with differing results are excluded."""
    ambiguous = export.groupBy(name).agg(F.count_distinct(F.struct(*columns)).alias("_k")).where("_k > 1").select(name)
    clean = export.join(ambiguous, name, "left_anti").dropDuplicates([name]).select(name, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_found"))
    off = [F.coalesce(F.when(F.col(c) == F.col(f"_{c}"), 0.0).otherwise(F.abs(divide(F.col(f"_{c}") - F.col(c), F.col(c))) * 100), F.lit(float("inf"))) for c in columns]
    worst = F.greatest(*off) if len(off) > 1 else off[0]
    return baseline.join(clean, name, "left").select(name, F.when(F.col("_found"), worst).alias("worst_percent"), F.when(F.col("_found").isNull(), "MISSING").when(worst <= tolerance, "OK").otherwise("MISMATCH").alias("status"))


def trade_count_ok(a: Column, b: Column) -> Column:
    """Counts within eight or a tenth of the first."""
    return F.abs(a - b) <= F.greatest(F.lit(8), F.ceil(a * 0.1))


def server_to_utc(ms: Column, zone: str) -> Column:
    """Server wall time, given as epoch milliseconds of that wall time, in UTC; gaps and overlaps are mapped."""
    from ..functions import clock

    return clock.to_utc_mapped(clock.utc(ms), zone)
