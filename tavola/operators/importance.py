"""Feature importance and report tables.

Model parameters (importances, coefficients) are small, bounded by the
model's feature count; everything downstream of them is a DataFrame query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tavola.functions.stats import prefix_sums


def importance_table(spark: SparkSession, names: Sequence[str], values: Sequence[float], value_col: str = "importance") -> DataFrame:
    """``(feature, importance)`` from a fitted model's vector (model-sized)."""
    return spark.createDataFrame([(str(n), float(v)) for n, v in zip(names, values)], f"feature string, {value_col} double")


def clean_feature_name(c: Column) -> Column:
    """``name__x`` -> ``Restaurant Name: x``; ``cat__`` / ``num__`` prefixes removed."""
    return (
        F.when(c.startswith("name__"), F.concat(F.lit("Restaurant Name: "), F.substring(c, 7, 1 << 30)))
        .when(c.startswith("cat__"), F.substring(c, 6, 1 << 30))
        .when(c.startswith("num__"), F.substring(c, 6, 1 << 30))
        .otherwise(c)
    )


def source_of_encoded(feature: Column, categorical: Sequence[str]) -> Column:
    """First categorical column ``c`` with ``feature == c`` or ``feature`` starting ``c_``; else the feature itself."""
    expr = None
    for c in categorical:
        cond = (feature == F.lit(c)) | feature.startswith(F.lit(f"{c}_"))
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr.otherwise(feature) if expr is not None else feature


def sum_to_source(imp: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Encoded importances summed back to their source column, sorted desc."""
    src = F.when(F.col("feature").startswith("num__"), F.substring(F.col("feature"), 6, 1 << 30)).when(
        F.col("feature").startswith("cat__"), source_of_encoded(F.substring(F.col("feature"), 6, 1 << 30), categorical)
    ).otherwise(F.col("feature"))
    return imp.groupBy(src.alias("feature")).agg(F.sum("importance").alias("importance"))


def mean_abs_coefficient(coefs: DataFrame) -> DataFrame:
    """Mean |coefficient| over labels, per feature."""
    return coefs.groupBy("feature").agg(F.avg(F.abs("coefficient")).alias("mean_abs_coefficient"))


def top_features_per_label(coefs: DataFrame, k: int = 15) -> DataFrame:
    """I4: the k largest coefficients of each label, ranked 1..k (ties by feature name)."""
    w = Window.partitionBy("label").orderBy(F.col("coefficient").desc(), F.col("feature").asc())
    return coefs.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def cumulative_importance(imp: DataFrame, value_col: str = "importance") -> DataFrame:
    """Running sum and share over features sorted by importance desc, as a distributed prefix sum."""
    total = imp.select(F.sum(value_col)).scalar()
    rows = imp.select("feature", value_col)
    out = prefix_sums(rows, [], [F.col(value_col).desc(), F.col("feature").asc()], {"cumulative": value_col, "rank": F.lit(1)})
    return out.select("feature", value_col, F.col("rank").cast("int").alias("rank"), "cumulative", (F.col("cumulative") / total).alias("cumulative_share"))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Chart feed tables: the first ``n`` rows by ``order`` (per-partition top-n, merged)."""
    return df.orderBy(*order).limit(n)


def slot_names(df: DataFrame, vector_col: str = "features") -> list[str]:
    """Names of every slot of an assembled vector, from its ML attribute metadata."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {})
    size = int(meta.get("num_attrs", 0))
    names = [f"{vector_col}_{i}" for i in range(size)]
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[int(a["idx"])] = a.get("name", names[int(a["idx"])])
    return names
