"""What the corpus operators share: scratch tables in the cluster's shared folder, and column checks."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import Scratch, delete, shared_dir  # noqa: F401

#: The code points of ASCII white space and of capital letters.
ASCII_SPACE_WORD = r"[^\x20\x09-\x0D]+"
ASCII_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with Arrow batches of BATCH_BYTES at most (or what the session sets below that): texts differ much in length."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(Exception):  # a session that does not know the setting goes by rows
        now = conf.get(name, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
            conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def range_of(col, bounds: list[int], base: int = 0):
    """How many of the ascending bounds are at most the value, by halving."""
    if not bounds:
        return F.lit(base)
    half = len(bounds) // 2
    return F.when(col < bounds[half], range_of(col, bounds[:half], base)).otherwise(range_of(col, bounds[half + 1 :], base + half + 1))


def range_bounds(ids: DataFrame, parts: int, each: int = 64) -> list[int]:
    """Bounds that part a column of longs into about equal ranges; the same for the same ids, in whatever order they come.

    Some ``each`` ids a range, chosen by their hash, reach the driver.
    """
    if parts < 2:
        return []
    (name,) = ids.columns
    n = ids.count()
    share = max(1, n // (each * parts))
    seen = sorted(r[0] for r in ids.where(F.pmod(F.xxhash64(name), F.lit(share)) == 0).groupBy(name).count().orderBy(F.xxhash64(name)).limit(4 * each * parts).select(name).collect())
    return sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else []


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def literal_array(values: list, kind: str):
    """A constant array column; values is bounded by the caller."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def bind(col, use):
    """use(col) with the value computed once: an expression that a lambda names is otherwise computed for every element."""
    return F.element_at(F.transform(F.array(col), use), 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
