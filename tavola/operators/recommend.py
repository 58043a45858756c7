"""Preference-weighted top-N recommendation.

A request is a plain mapping of preferences; it becomes literal values inside
one projection over the listings table, so scoring is a single scan with
whole-stage codegen: no UDF, no join.  The min-rating filter is pushed below
the scoring; the two normalising maxima over the survivors are scalar
subqueries; the top N is a ``TakeOrderedAndProject`` (per-partition top N,
merged), never a global sort of all listings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions import text as T

# Weights of the score terms (evaluation order).
W_CUISINE = 40.0
W_CITY = 20.0
W_LOCALITY = 3.0
W_PRICE = 12.0
W_RATING = 12.0
W_RATING_CATEGORY = 6.0
W_BUDGET = 8.0
W_COST_CATEGORY = 8.0
W_POPULARITY_CATEGORY = 6.0
W_EXPENSIVE = 4.0
W_LOCATION_CLUSTER = 8.0
W_CITY_CLUSTER = 8.0
W_DELIVERY = 5.0
W_BOOKING = 5.0
W_DELIVERING_NOW = 3.0
W_VOTES = 6.0
W_POPULARITY = 6.0
W_COST_RELATIVE = 2.0

# The 22 output columns, in order.
OUTPUT_COLUMNS = [
    "rank", "listing_id", "listing_name", "city", "locality", "cuisines", "price_range", "average_cost_inr",
    "restaurant_cost_category", "aggregate_rating", "rating_category", "votes", "popularity_category",
    "restaurant_popularity_score", "has_online_delivery", "has_table_booking", "is_delivering_now", "is_expensive",
    "location_cluster", "city_location_cluster", "score", "match_reasons",
]


def parse_cuisines(text: str | None) -> list[str]:
    """comma text -> list of trimmed, non-empty names."""
    if not text:
        return []
    return [x.strip() for x in text.split(",") if x.strip()]


def validate(prefs: Mapping[str, object], top_n: int) -> None:
    """Request checks: price range 1-4, rating 0-5, cost >= 0, top_n 1-50."""
    pr, mr, mc = prefs.get("price_range"), prefs.get("min_rating"), prefs.get("max_cost")
    if pr is not None and not 1 <= int(pr) <= 4:
        raise ValueError("price_range must be between 1 and 4")
    if mr is not None and not 0 <= float(mr) <= 5:
        raise ValueError("min_rating must be between 0 and 5")
    if mc is not None and float(mc) < 0:
        raise ValueError("max_cost must be >= 0")
    if not 1 <= int(top_n) <= 50:
        raise ValueError("top_n must be between 1 and 50")


def _lower_eq(col: str, value: str) -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit(""))) == F.lit(value.lower())


def _reason(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text)).otherwise(F.lit(""))


def _clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def score_terms(prefs: Mapping[str, object]) -> list[tuple[Column, Column | None]]:
    """F1-F16, F19 (without the survivors' maxima): (score term, reason) pairs in order."""
    terms: list[tuple[Column, Column | None]] = []
    cuisines = [c.lower() for c in (prefs.get("cuisines") or [])]
    if cuisines:
        tokens = T.split_list(F.col("cuisines"), lower=True)
        wanted = F.array(*[F.lit(c) for c in dict.fromkeys(cuisines)])
        ratio = F.size(F.array_intersect(F.array_distinct(tokens), wanted)) / F.lit(float(len(cuisines)))
        terms.append((ratio * W_CUISINE, _reason(ratio > 0, "cuisine match; ")))
    city = prefs.get("city")
    if city:
        m = _lower_eq("city", city)
        terms.append((m.cast("double") * W_CITY, _reason(m, "city match; ")))
    locality = prefs.get("locality")
    if locality:
        m = F.lower(F.coalesce(F.col("locality"), F.lit(""))).contains(F.lit(locality.lower()))
        terms.append((m.cast("double") * W_LOCALITY, _reason(m, "weak locality match; ")))
    pr = prefs.get("price_range")
    if pr is not None:
        dist = F.abs(F.coalesce(F.col("price_range"), F.lit(pr)) - F.lit(pr))
        terms.append(((1 - _clip01(dist / F.lit(3.0))) * W_PRICE, _reason(dist == 0, "price match; ")))
    mr = prefs.get("min_rating")
    if mr is not None:
        terms.append((None, F.lit(f"rating >= {float(mr)!r}; ")))
    rating = F.coalesce(F.col("aggregate_rating"), F.lit(0.0))
    terms.append(((F.least(F.greatest(rating, F.lit(0.0)), F.lit(5.0)) / F.lit(5.0)) * W_RATING, None))
    rc = prefs.get("rating_category")
    if rc:
        m = _lower_eq("rating_category", rc)
        terms.append((m.cast("double") * W_RATING_CATEGORY, _reason(m, "rating category match; ")))
    mc = prefs.get("max_cost")
    if mc is not None:
        mc = float(mc)
        cost = F.coalesce(F.col("average_cost_inr"), F.lit(mc))
        over = F.greatest(cost - F.lit(mc), F.lit(0.0)) / F.lit(max(mc, 1.0))
        terms.append(((1 - _clip01(over)) * W_BUDGET, _reason(cost <= F.lit(mc), "within budget; ")))
    cc = prefs.get("cost_category")
    if cc:
        m = _lower_eq("restaurant_cost_category", cc)
        terms.append((m.cast("double") * W_COST_CATEGORY, _reason(m, "cost category match; ")))
    pc = prefs.get("popularity_category")
    if pc:
        m = _lower_eq("popularity_category", pc)
        terms.append((m.cast("double") * W_POPULARITY_CATEGORY, _reason(m, "popularity category match; ")))
    ie = prefs.get("is_expensive")
    if ie is not None:
        m = F.coalesce(F.col("is_expensive"), F.lit(0)).cast("int") == F.lit(int(ie))
        terms.append((m.cast("double") * W_EXPENSIVE, _reason(m, "expensive preference match; ")))
    lc = prefs.get("location_cluster")
    if lc is not None:
        m = F.coalesce(F.col("location_cluster"), F.lit(-1)).cast("int") == F.lit(int(lc))
        terms.append((m.cast("double") * W_LOCATION_CLUSTER, _reason(m, "location cluster match; ")))
    clc = prefs.get("city_location_cluster")
    if clc:
        m = _lower_eq("city_location_cluster", clc)
        terms.append((m.cast("double") * W_CITY_CLUSTER, _reason(m, "city-location cluster match; ")))
    for key, col, w, text in (
        ("online_delivery", "has_online_delivery", W_DELIVERY, "delivery match; "),
        ("table_booking", "has_table_booking", W_BOOKING, "booking match; "),
        ("delivering_now", "is_delivering_now", W_DELIVERING_NOW, "currently delivering match; "),
    ):
        v = prefs.get(key)
        if v:
            m = _lower_eq(col, v)
            terms.append((m.cast("double") * w, _reason(m, text)))
    return terms


def score(listings: DataFrame, prefs: Mapping[str, object]) -> DataFrame:
    """All surviving listings with ``score`` and ``match_reasons`` (unranked)."""
    mr = prefs.get("min_rating")
    pool = listings
    if mr is not None:
        # coalesce(rating, 0) >= m; for m > 0 this is exactly rating >= m, a
        # predicate the parquet scan can evaluate (row-group skipping).
        if float(mr) > 0:
            pool = pool.filter(F.col("aggregate_rating") >= F.lit(float(mr)))
        else:
            pool = pool.filter(F.coalesce(F.col("aggregate_rating"), F.lit(0.0)) >= F.lit(float(mr)))
    terms = score_terms(prefs)
    total = F.lit(0.0)
    for term, _ in terms:
        if term is not None:
            total = total + term
    lv = F.coalesce(F.col("log_votes"), F.lit(0.0))
    ps = F.coalesce(F.col("restaurant_popularity_score"), F.lit(0.0))
    # Both maxima over the survivors in one scalar subquery (one scan).
    mx = pool.select(F.struct(F.max(lv).alias("lv"), F.max(ps).alias("ps"))).scalar()
    lv_max, ps_max = mx.getField("lv"), mx.getField("ps")
    total = total + F.when(lv_max > 0, lv / lv_max * W_VOTES).otherwise(F.lit(0.0))
    total = total + F.when(ps_max > 0, ps / ps_max * W_POPULARITY).otherwise(F.lit(0.0))
    rel = F.coalesce(F.col("cost_relative_to_city"), F.lit(1.0))
    total = total + (1 - _clip01(F.abs(rel - 1))) * W_COST_RELATIVE
    reasons = [r for _, r in terms if r is not None]
    return pool.withColumns({"score": total, "match_reasons": F.concat(F.lit(""), *reasons) if reasons else F.lit("")})


def recommend(listings: DataFrame, prefs: Mapping[str, object], top_n: int = 10, round_score: int | None = 4) -> DataFrame:
    """The ``top_n`` best listings for one request, ranked from 1."""
    validate(prefs, top_n)
    scored = score(listings, prefs)
    order = [F.col("score").desc(), F.col("aggregate_rating").desc(), F.col("votes").desc(), F.col("listing_id").asc()]
    top = scored.orderBy(*order).limit(int(top_n))
    # At most 50 rows remain, so the unpartitioned rank window is tiny.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    if round_score is not None:
        ranked = ranked.withColumn("score", F.round(F.col("score"), round_score))
    return ranked.select(*OUTPUT_COLUMNS)


def evaluate_recommendations(recs: DataFrame, prefs: Mapping[str, object]) -> DataFrame:
    """cuisine match rate (substring test), city match rate, mean rating, mean score (one row)."""
    cuisines = [c.lower() for c in (prefs.get("cuisines") or [])]
    aggs = []
    if cuisines:
        low = F.lower(F.coalesce(F.col("cuisines"), F.lit("")))
        hit = F.lit(False)
        for c in cuisines:
            hit = hit | low.contains(F.lit(c))
        aggs.append((F.avg(hit.cast("double")) * 100).alias("cuisine_match_rate"))
    if prefs.get("city"):
        aggs.append((F.avg(_lower_eq("city", prefs["city"]).cast("double")) * 100).alias("city_match_rate"))
    aggs += [F.avg("aggregate_rating").alias("average_rating"), F.avg("score").alias("average_score"), F.count(F.lit(1)).alias("n")]
    return recs.agg(*aggs)
