"""Profiling and data-quality operators (Q1-Q11).

Each profile is a single aggregate pass over the table (all columns in one
``agg``), then an unpivot of the one-row result into one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import text as T
from tavola.session import cut_lineage
from tavola.functions.stats import exact_medians, exact_percentiles, group_rank, join_group_stats


def _unpivot_one_row(row_df: DataFrame, names: Sequence[str], value_name: str) -> DataFrame:
    return row_df.unpivot([], list(names), "column", value_name)


def profile(df: DataFrame) -> DataFrame:
    """Q1: column name, position, Spark type and non-null count (one scan)."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = _unpivot_one_row(counts, df.columns, "non_null")
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, column string, data_type string"
    )
    return long.join(F.broadcast(types), "column").select("position", "column", "data_type", F.col("non_null").cast("long"))


def null_counts(df: DataFrame) -> DataFrame:
    """Q2: nulls per column (one scan)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _unpivot_one_row(counts, df.columns, "nulls").select("column", F.col("nulls").cast("long"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q3: every full-row duplicate after the first (``occurrence`` 2..k).

    Rows are ranked inside their full-row group with the skew-safe
    :func:`group_rank`, ordered by a row number so that a value repeated in a
    third of the table is spread over many range partitions; nulls compare
    equal, as in the reference.  Occurrence 1 is dropped.
    """
    cols = df.columns
    keyed = df.select(*cols, *[F.struct(F.col(c)).alias(f"_k{i}") for i, c in enumerate(cols)])
    keyed = cut_lineage(keyed.withColumn("_row", F.monotonically_increasing_id()))
    ranked = group_rank(keyed, [f"_k{i}" for i in range(len(cols))], ["_row"], rank_col="occurrence")
    return ranked.filter(F.col("occurrence") > 1).select(*cols, "occurrence")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Q4: number of rows that repeat an earlier row (one row)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def corrupt_values(df: DataFrame, pattern: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Q5: distinct values matching ``pattern`` per text column, as (column, value)."""
    cols = list(cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    long = df.select(*cols).unpivot([], cols, "column", "value")
    return long.filter(T.contains_any(F.col("value"), pattern)).distinct()


def corrupt_counts(df: DataFrame, pattern: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Q6: number of matching values per text column, only columns with > 0 (one scan)."""
    cols = list(cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    counts = df.agg(*[F.count_if(T.contains_any(F.col(c).cast("string"), pattern)).alias(c) for c in cols])
    return _unpivot_one_row(counts, cols, "corrupted").filter("corrupted > 0").select("column", F.col("corrupted").cast("long"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Q7: sorted distinct values of one column (with their position)."""
    d = df.select(col).distinct()
    return d.orderBy(col)


def null_zero(df: DataFrame, col: str) -> DataFrame:
    """Q8: null count and zero count of a numeric column (one row)."""
    c = F.col(col)
    return df.agg(F.count_if(c.isNull()).cast("long").alias("nulls"), F.count_if(c == 0).cast("long").alias("zeros"))


def zero_only_groups(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Q9: groups whose values are all zero or null (non-zero count = 0).

    ``non_zero_count`` counts nulls as non-zero, as ``x != 0`` does on NaN in
    the reference; rows with a null key are not grouped.
    """
    c = F.col(col)
    keyed = df
    for k in keys:
        keyed = keyed.filter(F.col(k).isNotNull())
    g = keyed.groupBy(*keys).agg(
        F.count(c).cast("long").alias("total_rows"),
        F.count_if(c == 0).cast("long").alias("zero_count"),
        F.count_if(~F.coalesce(c == 0, F.lit(False))).cast("long").alias("non_zero_count"),
    )
    medians = exact_medians(keyed.filter(c != 0), keys, col, "non_zero_median")
    return join_group_stats(g.filter(F.col("non_zero_count") == 0), medians, keys)


def group_median_order(df: DataFrame, group: str, col: str) -> DataFrame:
    """Q10: groups ordered by the median of their positive values, descending (with rank)."""
    g = exact_medians(df.filter(F.col(col) > 0), [group], col, "median_value")
    return group_rank(g, [], [F.col("median_value").desc(), F.col(group).asc()], rank_col="rank").withColumn("rank", F.col("rank").cast("int"))


def box_stats(df: DataFrame, group: str, col: str, positive_only: bool = True) -> DataFrame:
    """Q11: per-group quartiles, 1.5 IQR whiskers (most extreme values inside) and outlier count."""
    base = df.filter(F.col(col) > 0) if positive_only else df.filter(F.col(col).isNotNull())
    q = exact_percentiles(base, [group], col, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    q = join_group_stats(q, base.groupBy(group).agg(F.count(F.lit(1)).cast("long").alias("n")), [group])
    j = join_group_stats(base.select(group, col), q.select(group, "q1", "q3"), [group])
    lo_fence = F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))
    hi_fence = F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    w = j.groupBy(group).agg(
        F.min(F.when(F.col(col) >= lo_fence, F.col(col))).alias("lower_whisker"),
        F.max(F.when(F.col(col) <= hi_fence, F.col(col))).alias("upper_whisker"),
        F.count_if((F.col(col) < lo_fence) | (F.col(col) > hi_fence)).cast("long").alias("outliers"),
    )
    return join_group_stats(q, w, [group]).withColumn("iqr", F.col("q3") - F.col("q1"))
