"""Model-input features (M4-M7), fitted on the training rows only.

Fitted statistics are one-row tables (or small per-level tables); applying
them is a projection or a broadcast join of a model-sized table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import text as T
from tavola.functions.stats import exact_percentiles_many, prefix_sums
from tavola.operators import split


def cast_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], trim: bool = False) -> DataFrame:
    """Categoricals -> text with ``Unknown`` for null (trimmed on request); numerics -> double (unparsable -> null)."""
    text = lambda c: F.trim(F.col(c).cast("string")) if trim else F.col(c).cast("string")
    return df.withColumns({c: F.coalesce(text(c), F.lit("Unknown")) for c in categorical}).withColumns(
        {c: T.to_number(F.col(c)) for c in numeric}
    )


def fit_median_std(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    """M5 fit: exact median and population std per column.

    Returns a model-sized dict: the parameters of the imputer / scaler.
    """
    if not cols:
        return {}
    medians = exact_percentiles_many(train, [], cols, [0.5], names=["median"]).first()
    stds = train.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    return {c: (medians[f"{c}_median"] if medians else None, float(stds[c]) if stds[c] else 1.0) for c in cols}


def apply_median_std(df: DataFrame, params: dict[str, tuple[float | None, float]], scale: bool = True) -> DataFrame:
    """M5 apply: fill nulls with the train median, divide by the train std (no centring)."""
    exprs = {}
    for c, (m, s) in params.items():
        filled = F.coalesce(F.col(c), F.lit(m if m is not None else 0.0))
        exprs[c] = filled / F.lit(s) if scale else filled
    return df.withColumns(exprs)


def ordered_target_statistics(train: DataFrame, id_col: str, cat: str, target: str, prior: float, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """M7 training side, ordered: each row's statistic of its level over the rows before it in a hashed order.

    ``(sum of earlier targets + weight * prior) / (earlier rows + weight)``, so a
    row never sees its own target and the first row of a level gets the prior.
    Running sums are dealt by ranges, so a hot level spans many tasks.  Rows
    without a target count for no other row.
    """
    order = split.mixed_hash(F.col(id_col), f"order{seed}")
    rows = train.withColumns({"_order": order, "_y": F.col(target).cast("double")})
    out = prefix_sums(rows, [cat], ["_order", F.col(id_col)], {"_s": "_y", "_n": F.col("_y").isNotNull().cast("long")})
    own = F.coalesce("_y", F.lit(0.0))
    value = (F.col("_s") - own + F.lit(weight * prior)) / (F.col("_n") - F.col("_y").isNotNull().cast("long") + F.lit(weight))
    return out.select(*train.columns, value.alias(f"{cat}_ts"))


def target_statistics(train: DataFrame, cat: str, target: str, fold: str, prior: float, weight: float = 1.0) -> DataFrame:
    """M7 training side: out-of-fold statistics, one row per (fold, level).

    A training row must not see its own label: its level's statistic is the
    level's total less the row's own fold.  One grouped aggregate by (level,
    fold); a level no other fold has gets the prior.
    """
    part = train.groupBy(cat, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = part.groupBy(cat).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn")).withColumnRenamed(cat, "_level")
    both = part.join(total, F.col(cat).eqNullSafe(F.col("_level"))).drop("_level")
    value = (F.col("_ts") - F.col("_s") + F.lit(weight * prior)) / (F.col("_tn") - F.col("_n") + F.lit(weight))
    return both.select(cat, fold, value.alias(f"{cat}_ts"))
