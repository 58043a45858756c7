"""Relational model: import, upserts, bridge, users, request and result logs.

The reference loads a wide file into a small relational store; on Spark the
tables are DataFrames (written as parquet by the caller) and the store's
constraints become anti-joins, dedupe keys and checks.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions import text as T
from tavola.functions.stats import exact_medians, group_rank, join_group_stats

# The 29 columns of the listings table, in order.
LISTING_COLUMNS = [
    "listing_id", "listing_name", "country_code", "city", "address", "locality", "longitude", "latitude",
    "cuisines", "average_cost_inr", "log_average_cost_inr", "cost_relative_to_city", "city_wise_cost_category",
    "restaurant_cost_category", "price_range", "aggregate_rating", "rating_category", "votes", "log_votes",
    "popularity_category", "restaurant_popularity_score", "city_restaurant_count", "has_table_booking",
    "has_online_delivery", "is_delivering_now", "is_expensive", "has_delivery_or_booking", "location_cluster",
    "city_location_cluster",
]

# Defaults for optional listing columns absent from the input.
OPTIONAL_DEFAULTS = {
    "cost_relative_to_city": 1.0,
    "city_wise_cost_category": "Unknown",
    "restaurant_cost_category": "Unknown",
    "rating_category": "Unknown",
    "popularity_category": "Unknown",
    "restaurant_popularity_score": 0.0,
    "city_restaurant_count": 0,
    "is_delivering_now": "No",
    "is_expensive": 0,
    "has_delivery_or_booking": 0,
    "location_cluster": -1,
    "city_location_cluster": "Unknown",
}

TEXT_COLUMNS = [
    "listing_name", "city", "address", "locality", "cuisines", "city_wise_cost_category",
    "restaurant_cost_category", "rating_category", "popularity_category", "city_location_cluster",
]
NUMERIC_COLUMNS = [
    "listing_id", "country_code", "longitude", "latitude", "average_cost_inr", "log_average_cost_inr",
    "cost_relative_to_city", "price_range", "aggregate_rating", "votes", "log_votes",
    "restaurant_popularity_score", "city_restaurant_count", "is_expensive", "has_delivery_or_booking",
    "location_cluster",
]
FLAG_COLUMNS = ["has_table_booking", "has_online_delivery", "is_delivering_now"]


# ---------------------------------------------------------------- S2-S6
def normalize_header(df: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Trim column names, then apply aliases (e.g. ``Log votes`` -> ``Log Votes``)."""
    out = df.toDF(*[c.strip() for c in df.columns])
    for old, new in (aliases or {}).items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    return out


def derive_missing(df: DataFrame, coerce_nulls: bool = True) -> DataFrame:
    """S3: add ``log_votes`` / ``log_average_cost_inr`` when absent (nulls -> 0 first unless told not to)."""
    out = df
    for src, dst in (("votes", "log_votes"), ("average_cost_inr", "log_average_cost_inr")):
        if src in out.columns and dst not in out.columns:
            base = F.col(src).cast("string").try_cast("double")
            base = F.coalesce(base, F.lit(0.0)) if coerce_nulls else base
            out = out.withColumn(dst, F.log1p(F.greatest(base, F.lit(0.0)) if coerce_nulls else base))
    return out


def with_defaults(df: DataFrame, defaults: Mapping[str, object] = OPTIONAL_DEFAULTS) -> DataFrame:
    """Add each absent optional column as a literal default."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise listing every missing required column (schema check, no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Projection to the contract."""
    return df.select(*cols)


# ---------------------------------------------------------------- import
def import_listings(prepared: DataFrame) -> DataFrame:
    """Prepared table -> ``listings`` table, with the importer's repairs and fills."""
    df = project(require(with_defaults(prepared), LISTING_COLUMNS), LISTING_COLUMNS)
    df = df.dropna(subset=["listing_id", "listing_name", "cuisines"])
    df = df.withColumns({c: T.norm_text(F.col(c)) for c in TEXT_COLUMNS})
    df = df.withColumns({c: T.to_number(F.col(c)) for c in NUMERIC_COLUMNS})
    cost_median = exact_medians(df, [], "average_cost_inr", "m").select("m").scalar()
    price_median = exact_medians(df, [], "price_range", "m").select("m").scalar()
    cost = F.coalesce(F.col("average_cost_inr"), cost_median)
    votes = F.coalesce(F.col("votes"), F.lit(0.0)).cast("long")
    df = df.withColumns(
        {
            "average_cost_inr": cost,
            "log_average_cost_inr": F.coalesce(F.col("log_average_cost_inr"), F.log1p(F.greatest(cost, F.lit(0.0)))),
            "cost_relative_to_city": F.coalesce(F.col("cost_relative_to_city"), F.lit(1.0)),
            "price_range": F.coalesce(F.col("price_range"), price_median).cast("int"),
            "aggregate_rating": F.coalesce(F.col("aggregate_rating"), F.lit(0.0)),
            "votes": votes,
            "log_votes": F.coalesce(F.col("log_votes"), F.log1p(F.greatest(votes, F.lit(0)).cast("double"))),
            "restaurant_popularity_score": F.coalesce(F.col("restaurant_popularity_score"), F.lit(0.0)),
            "city_restaurant_count": F.coalesce(F.col("city_restaurant_count"), F.lit(0.0)).cast("int"),
            "is_expensive": F.coalesce(F.col("is_expensive"), F.lit(0.0)).cast("int"),
            "has_delivery_or_booking": F.coalesce(F.col("has_delivery_or_booking"), F.lit(0.0)).cast("int"),
            "location_cluster": F.coalesce(F.col("location_cluster"), F.lit(-1.0)).cast("int"),
            "country_code": F.coalesce(F.col("country_code"), F.lit(0.0)).cast("int"),
            "listing_id": F.col("listing_id").cast("long"),
        }
    )
    return df.withColumns({c: T.yes_no(F.col(c)) for c in FLAG_COLUMNS})


# ---------------------------------------------------------------- S8
def upsert_listings(existing: DataFrame, incoming: DataFrame, now: Column, order_col: str | None = None) -> DataFrame:
    """Insert-or-update on ``listing_id``.

    Of incoming rows with one id the last by ``order_col`` wins, of equals in
    that order (all of them without ``order_col``) the greatest by content, so
    partition order never decides.  Updated rows keep ``created_at`` and take
    ``updated_at = now``; new rows get both = now.
    """
    cols = [c for c in incoming.columns if c != order_col]
    # A grouped maximum (combined map-side), so many copies of one id never
    # meet in a single task.
    others = [c for c in cols if c != "listing_id"]
    order = [F.col(order_col).alias("_order")] if order_col else []
    last = F.max(F.struct(*order, *others))
    incoming = incoming.groupBy("listing_id").agg(last.alias("_v")).select("listing_id", *[F.col(f"_v.{c}").alias(c) for c in others])
    inc = incoming.select(*[F.col(c).alias(f"_in_{c}") for c in cols])
    ex = existing.select(*cols, "created_at", "updated_at")
    j = ex.join(inc, ex["listing_id"] == inc["_in_listing_id"], "full_outer")
    has_new = F.col("_in_listing_id").isNotNull()
    out = [F.when(has_new, F.col(f"_in_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    return j.select(
        *out,
        F.when(F.col("listing_id").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(has_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


# ---------------------------------------------------------------- S9-S11, R1-R4
def cuisine_pairs(listings: DataFrame) -> DataFrame:
    """(listing_id, cuisine_name) for every non-empty trimmed piece of ``cuisines``."""
    return listings.select("listing_id", F.explode(T.split_list(F.col("cuisines"))).alias("cuisine_name")).dropDuplicates()


def upsert_dim(existing: DataFrame, names: DataFrame, id_col: str = "cuisine_id", name_col: str = "cuisine_name") -> DataFrame:
    """Insert-or-ignore names into a dimension with surrogate keys.

    New names (left-anti against the dimension) are numbered after the
    current maximum id in name order; the numbering is a skew-safe global
    rank, not a single-partition window.
    """
    new = names.select(name_col).filter(F.col(name_col).isNotNull()).distinct().join(existing.select(name_col), name_col, "left_anti")
    start = existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    ranked = group_rank(new.withColumn("_g", F.lit(0)), ["_g"], [name_col], rank_col="_rn")
    added = ranked.select((start + F.col("_rn")).cast("long").alias(id_col), name_col)
    return existing.select(id_col, name_col).unionByName(added)


def empty_dim(spark, id_col: str = "cuisine_id", name_col: str = "cuisine_name") -> DataFrame:
    return spark.createDataFrame([], f"{id_col} long, {name_col} string")


def build_bridge(listings: DataFrame, dim: DataFrame, existing: DataFrame | None = None, mode: str = "replace") -> DataFrame:
    """(listing_id, cuisine_id) pairs; name -> id lookup (R4) against the dimension.

    ``mode="replace"`` (default): a re-imported listing's links are exactly its
    current cuisines (snapshot).  ``mode="accumulate"``: insert-or-ignore into
    ``existing``, so links of cuisines a listing no longer has survive.
    """
    new = cuisine_pairs(listings).join(dim, "cuisine_name").select("listing_id", "cuisine_id").dropDuplicates()
    if existing is None:
        return new
    old = existing.select("listing_id", "cuisine_id")
    if mode == "replace":
        old = old.join(listings.select("listing_id").distinct(), "listing_id", "left_anti")
    elif mode != "accumulate":
        raise ValueError("mode must be 'replace' or 'accumulate'")
    return old.unionByName(new).dropDuplicates()


def import_summary(listings: DataFrame) -> DataFrame:
    """Imported rows and distinct cuisines of the batch (one row)."""
    pairs = listings.select(F.explode(T.split_list(F.col("cuisines"))).alias("c"))
    n_cuisines = pairs.select(F.count_distinct("c")).scalar()
    return listings.agg(F.count(F.lit(1)).alias("restaurants")).withColumn("cuisines", n_cuisines)


def load_listing_frame(listings: DataFrame, bridge: DataFrame, dim: DataFrame) -> DataFrame:
    """Listings with their cuisine names re-aggregated from the bridge.

    The bridge is aggregated per listing first (sorted names joined by
    ``", "``; null when a listing has none), then left-joined once.
    """
    names = (
        bridge.join(dim, "cuisine_id")
        .groupBy("listing_id")
        .agg(F.array_join(F.array_sort(F.collect_list("cuisine_name")), ", ").alias("cuisines"))
    )
    return listings.drop("cuisines").join(names, "listing_id", "left")


# ---------------------------------------------------------------- S12-S14
def append_users(existing: DataFrame, new: DataFrame, now: Column, order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Append users keeping e-mail unique (null e-mails allowed many times).

    Returns ``(users, rejected)``.  A new user is rejected when the e-mail is
    already taken or an earlier row of the batch (by ``order_col``) has it.
    """
    # First row per e-mail by order_col: grouped min joined back (no window
    # over a possibly huge e-mail group).
    firsts = new.filter(F.col("email").isNotNull()).groupBy("email").agg(F.min(order_col).alias("_first"))
    batch = join_group_stats(new, firsts, ["email"]).withColumn(
        "_k", F.when(F.col("email").isNull() | (F.col(order_col) == F.col("_first")), F.lit(1)).otherwise(F.lit(2))
    ).drop("_first")
    taken = existing.select("email").filter(F.col("email").isNotNull())
    fresh = batch.filter("_k = 1").join(taken, "email", "left_anti")
    rejected = batch.join(fresh.select(order_col), order_col, "left_anti").drop("_k")
    start = existing.select(F.coalesce(F.max("user_id"), F.lit(0)).cast("long")).scalar()
    ranked = group_rank(fresh.withColumn("_g", F.lit(0)), ["_g"], [order_col], rank_col="_rn")
    added = ranked.select((start + F.col("_rn")).cast("long").alias("user_id"), "name", "email", now.alias("created_at"))
    return existing.select("user_id", "name", "email", "created_at").unionByName(added), rejected


PREFERENCE_FIELDS = [
    "cuisines", "city", "locality", "price_range", "min_rating", "max_cost", "cost_category", "rating_category",
    "popularity_category", "is_expensive", "location_cluster", "city_location_cluster", "online_delivery",
    "table_booking", "delivering_now",
]
PREFERENCE_TYPES = {
    "cuisines": "array<string>", "city": "string", "locality": "string", "price_range": "int", "min_rating": "double",
    "max_cost": "double", "cost_category": "string", "rating_category": "string", "popularity_category": "string",
    "is_expensive": "int", "location_cluster": "int", "city_location_cluster": "string", "online_delivery": "string",
    "table_booking": "string", "delivering_now": "string",
}


def complete_requests(requests: DataFrame) -> DataFrame:
    """Add every absent preference field as a typed null (cuisines as an array)."""
    out = requests
    if "cuisines" in out.columns and dict(out.dtypes)["cuisines"] == "string":
        out = out.withColumn("cuisines", T.split_list(F.col("cuisines")))
    for f in PREFERENCE_FIELDS:
        if f not in out.columns:
            out = out.withColumn(f, F.lit(None).cast(PREFERENCE_TYPES[f]))
    return out


def preferences_log(requests: DataFrame, now: Column, user_col: str = "request_id") -> DataFrame:
    """One preference-log row per request (cuisines joined with ``", "``)."""
    r = complete_requests(requests)
    return r.select(
        F.col(user_col).alias("user_id"),
        F.array_join(F.coalesce(F.col("cuisines"), F.array().cast("array<string>")), ", ").alias("preferred_cuisines"),
        F.col("city").alias("preferred_city"),
        F.col("locality").alias("preferred_locality"),
        F.col("price_range").alias("preferred_price_range"),
        F.col("max_cost").alias("max_average_cost_inr"),
        F.col("min_rating"),
        F.col("cost_category").alias("preferred_cost_category"),
        F.col("rating_category").alias("preferred_rating_category"),
        F.col("popularity_category").alias("preferred_popularity_category"),
        F.col("is_expensive").alias("wants_expensive"),
        F.col("location_cluster").alias("preferred_location_cluster"),
        F.col("city_location_cluster").alias("preferred_city_location_cluster"),
        F.col("online_delivery").alias("wants_online_delivery"),
        F.col("table_booking").alias("wants_table_booking"),
        F.col("delivering_now").alias("wants_delivering_now"),
        now.alias("created_at"),
    )


def request_json(requests: DataFrame) -> Column:
    """Preferences as JSON text with every key present (nulls written as null)."""
    r_fields = [F.col(f).alias(f) for f in PREFERENCE_FIELDS]
    return F.to_json(F.struct(*r_fields), {"ignoreNullFields": "false"})


def preferences_json(prefs: Mapping[str, object]) -> str:
    """JSON text of a single request, ASCII-escaped, keys in the request order."""
    return json.dumps({k: prefs.get(k, [] if k == "cuisines" else None) for k in PREFERENCE_FIELDS}, ensure_ascii=True)


def history_log(recs: DataFrame, requests: DataFrame, now: Column, user_col: str = "request_id") -> DataFrame:
    """Recommendation history rows: request JSON, listing, score, rank."""
    r = complete_requests(requests)
    req = r.select(F.col(user_col).alias("_rid"), request_json(r).alias("preferences_json"))
    return recs.join(req, recs["request_id"] == req["_rid"]).select(
        F.col("request_id").alias("user_id"),
        "preferences_json",
        "listing_id",
        F.col("score").alias("recommendation_score"),
        "rank",
        now.alias("created_at"),
    )
