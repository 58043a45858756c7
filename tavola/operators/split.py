"""Deterministic splits and folds.

Assignment is a mixing hash (MD5) of seed and row id, so it is unrelated to
any arithmetic pattern in the ids, stable across runs, partitionings and
executor retries, and needs no shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions.stats import smallest

# The split fractions.
TEST_FRACTION = 0.15
VAL_FRACTION = 0.15

# Buckets that a hash is cut into for the fractions.
BUCKETS = 10_000


def mixed_hash(id_col: Column, seed: str | int) -> Column:
    """First 60 bits of ``md5(seed:id)`` as a non-negative integer."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string"))), 1, 15), 16, 10).cast("long")


def assign_split(df: DataFrame, id_col: str, seed: int = 42, test: float = TEST_FRACTION, val: float = VAL_FRACTION) -> DataFrame:
    """``split`` in {train, val, test}: test share ``test``, then ``val`` of the whole."""
    u = mixed_hash(F.col(id_col), seed) % BUCKETS
    low, high = round(test * BUCKETS), round((test + val) * BUCKETS)
    return df.withColumn("split", F.when(u < low, F.lit("test")).when(u < high, F.lit("val")).otherwise(F.lit("train")))


def exact_split(df: DataFrame, id_col: str, seed: int = 42, test: float = TEST_FRACTION, val: float = VAL_FRACTION) -> DataFrame:
    """P1 with exact sizes: ``ceil(test * n)`` rows test, ``ceil`` of val's share of the rest val, the others train.

    Rows go by their mixing hash; the two cuts are the hashes of the last test
    and the last val row, found by distributed selection, not by a sort.  Rows
    that repeat an id have one hash and stay together, which can move a cut by
    their number; null ids, too, are one id.
    """
    u = mixed_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)
    n = df.count()
    n_test = math.ceil(test * n - 1e-9)
    n_val = math.ceil((n - n_test) * val / (1 - test) - 1e-9)
    low, high = smallest(df, u, [n_test, n_test + n_val])
    is_test = u <= F.lit(low) if low is not None else F.lit(False)
    is_val = u <= F.lit(high) if high is not None else F.lit(False)
    return df.withColumn("split", F.when(is_test, F.lit("test")).when(is_val, F.lit("val")).otherwise(F.lit("train")))


def assign_fold(df: DataFrame, id_col: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``fold`` in 0..k-1 from a hash of the id that is independent of the split's."""
    return df.withColumn("fold", (mixed_hash(F.col(id_col), f"fold{seed}") % k).cast("int"))


def candidate_grid(grid: Mapping[str, Sequence], base: Mapping[str, object], max_trials: int | None = None, seed: int = 42) -> list[dict]:
    """Base parameters first, then all other grid points in a seeded hash order; a caller may ask for the first ``max_trials`` only.

    The grid is a small driver-side parameter list (sizes 108-216), not data.
    """
    keys = list(grid)
    points = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    order = sorted(range(len(points)), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    out = [dict(base)]
    for i in order:
        p = {**base, **points[i]}
        if p not in out:
            out.append(p)
    return out[:max_trials]


def summarize_folds(folds: DataFrame, metrics: Sequence[str], candidate_col: str = "candidate") -> DataFrame:
    """Mean and population std of each metric per candidate."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    return folds.groupBy(candidate_col).agg(*aggs)


def select_best(summary: DataFrame, order: Sequence[Column]) -> DataFrame:
    """P5: the best candidate row (ties -> the first candidate)."""
    return summary.orderBy(*order, F.col("candidate").asc()).limit(1)
