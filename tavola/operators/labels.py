"""Multi-label preparation (L1-L6), in long form ``(row_id, position, label)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import text as T
from tavola.functions.stats import group_rank


def label_split(df: DataFrame, id_col: str, col: str = "cuisines") -> DataFrame:
    """L1: comma list -> one row per non-empty trimmed label, keeping the position."""
    return df.select(F.col(id_col).alias("row_id"), F.posexplode(T.split_list(F.col(col))).alias("position", "label"))


def label_frequency(long: DataFrame, min_count: int) -> DataFrame:
    """L2: label counts (repeats in a row count twice), ``used_in_model`` flag, rank by count desc, label asc."""
    counts = long.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    ranked = group_rank(counts, [], [F.col("count").desc(), F.col("label").asc()], rank_col="rank")
    return ranked.select(
        "label",
        F.col("count").cast("long").alias("count"),
        (F.col("count") >= min_count).alias("used_in_model"),
        F.col("rank").cast("int").alias("rank"),
    )


def rare_labels(long: DataFrame, min_count: int) -> DataFrame:
    """L3: labels below ``min_count``."""
    return long.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("count")).filter(F.col("count") < min_count)


def filter_rare(long: DataFrame, min_count: int) -> DataFrame:
    """L4: keep labels with at least ``min_count`` occurrences; rows left with none disappear.

    Kept labels are a semi-join against the frequent-label table (one row per
    label, broadcast by AQE when small).
    """
    keep = long.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count).select("label")
    return long.join(keep, "label", "left_semi")


def vocabulary(long: DataFrame) -> DataFrame:
    """Sorted label vocabulary with its index (the binariser's columns)."""
    ranked = group_rank(long.select("label").distinct(), [], ["label"], rank_col="_rn")
    return ranked.select("label", (F.col("_rn") - 1).cast("int").alias("label_idx"))


def binarize(long: DataFrame, vocab: DataFrame) -> DataFrame:
    """Indicator rows ``(row_id, label_idx)`` for every present label (sparse form)."""
    return long.join(vocab, "label").select("row_id", "label_idx").distinct()


def label_cardinality(long: DataFrame) -> DataFrame:
    """Mean number of labels per row (rows with at least one label)."""
    per_row = long.groupBy("row_id").agg(F.count(F.lit(1)).alias("_k"))
    return per_row.agg(F.avg("_k").alias("label_cardinality"), F.count(F.lit(1)).cast("long").alias("rows"))
