"""Scalar, conditional and per-group derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import bins
from tavola.functions.stats import exact_medians, group_rank, join_group_stats

COST = "average_cost_inr"


def log_cost(df: DataFrame, cost: str = COST) -> DataFrame:
    """``ln(1 + cost)`` (``log_votes`` is part of :func:`row_features`)."""
    return df.withColumn("log_average_cost_inr", F.log1p(F.col(cost)))


def cost_relative_to_city(df: DataFrame, cost: str = COST, min_city_rows: int = 10) -> DataFrame:
    """Cost / city median when the city has >= 10 non-null costs, else cost /
    (country, price range) median.  Medians include zeros; x / 0 gives null."""
    n = df.groupBy("city").agg(F.count(cost).alias("_city_n"))
    city = join_group_stats(n, exact_medians(df, ["city"], cost, "_city_median"), ["city"])
    cp = exact_medians(df, ["country_code", "price_range"], cost, "_cp_median")
    out = join_group_stats(join_group_stats(df, city, ["city"]), cp, ["country_code", "price_range"])
    rel = F.when(
        F.coalesce(F.col("_city_n"), F.lit(0)) >= min_city_rows, F.try_divide(F.col(cost), F.col("_city_median"))
    ).otherwise(F.try_divide(F.col(cost), F.col("_cp_median")))
    return out.withColumn("cost_relative_to_city", rel).drop("_city_median", "_city_n", "_cp_median")


def city_cost_quartile(df: DataFrame, cost: str = COST, id_col: str = "listing_id") -> DataFrame:
    """D3: cost quartile label inside each city (ties broken by listing id).

    Cities with fewer than 4 rows get ``Medium`` for every row; a null cost in a
    larger city gets null.  Ranks come from the skew-safe :func:`group_rank`.
    """
    ranked = group_rank(df.select("city", cost, id_col).filter(F.col(cost).isNotNull()), ["city"], [cost, id_col], rank_col="_rn")
    sizes = df.groupBy("city").agg(F.count(F.lit(1)).alias("_rows"), F.count(cost).alias("_n"))
    labelled = join_group_stats(ranked, sizes.select("city", "_n"), ["city"]).withColumn("_label", bins.quartile_label(F.col("_rn"), F.col("_n")))
    # Of the sorted narrow rows only the last (cost, id) of every label goes
    # back to the wide rows: one row per city.
    last = labelled.groupBy("city").agg(
        *[F.max(F.when(F.col("_label") == q, F.struct(F.col(cost).alias("c"), F.col(id_col).alias("i")))).alias(f"_last_{k}") for k, q in enumerate(bins.QUARTILE_LABELS)]
    )
    out = join_group_stats(df, join_group_stats(sizes, last, ["city"]), ["city"])
    own = F.struct(F.col(cost).alias("c"), F.col(id_col).alias("i"))
    label = F.when(F.col("_rows") < 4, F.lit("Medium")).when(F.col(cost).isNull() | F.col("city").isNull(), F.lit(None).cast("string"))
    for k, q in enumerate(bins.QUARTILE_LABELS):
        label = label.when(own <= F.col(f"_last_{k}"), F.lit(q))
    return out.withColumn("city_wise_cost_category", label).drop("_rows", "_n", *[f"_last_{k}" for k in range(len(bins.QUARTILE_LABELS))])


def cuisine_count(c):
    """0 for ``Unknown``, else the number of comma pieces (empty pieces count)."""
    return F.when(F.lower(F.trim(c)) == F.lit("unknown"), F.lit(0)).otherwise(F.size(F.split(c, ","))).cast("int")


def primary_cuisine(c):
    """First comma piece, trimmed."""
    return F.trim(F.element_at(F.split(F.coalesce(c, F.lit("Unknown")), ","), 1))


def row_features(df: DataFrame, cost: str = COST) -> DataFrame:
    """Per-row derived columns in one projection."""
    votes = F.col("votes")
    return df.withColumns(
        {
            "restaurant_cost_category": bins.cost_category(F.col(cost)),
            "cuisine_count": cuisine_count(F.col("cuisines")),
            "primary_cuisine": primary_cuisine(F.col("cuisines")),
            "log_votes": F.log1p(votes),
            "rating_category": bins.rating_category(F.col("aggregate_rating")),
            "popularity_category": bins.popularity_category(votes),
            "restaurant_popularity_score": F.col("aggregate_rating") * F.log1p(votes),
            "is_expensive": F.coalesce(F.col("price_range") >= 3, F.lit(False)).cast("int"),
            "has_delivery_or_booking": F.coalesce(
                (F.col("has_online_delivery") == "Yes") | (F.col("has_table_booking") == "Yes"), F.lit(False)
            ).cast("int"),
        }
    )


def city_restaurant_count(df: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """Number of non-null ids in the row's city (grouped count joined back)."""
    counts = df.groupBy("city").agg(F.count(id_col).cast("int").alias("city_restaurant_count"))
    return join_group_stats(df, counts, ["city"])


def city_cluster_key(df: DataFrame) -> DataFrame:
    """``city + "_" + cluster``; a null city renders as ``nan`` like the reference's text cast."""
    return df.withColumn(
        "city_location_cluster",
        F.concat(F.coalesce(F.col("city"), F.lit("nan")), F.lit("_"), F.col("location_cluster").cast("string")),
    )
