"""All requests at once against one request at a time."""

import random

import numpy as np
import pyarrow as pa
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tavola.operators import recommend as R
from tavola.operators import recommend_all as A
from tavola.plans.catalog import imported_listings
from tavola.plans.requests import REQUESTS

SCHEMA = (
    "request_id long, cuisines array<string>, city string, locality string, price_range int, min_rating double, rating_category string, max_cost double, cost_category string, "
    "popularity_category string, is_expensive int, location_cluster int, city_location_cluster string, online_delivery string, table_booking string, delivering_now string"
)


def request_frame(spark, prefs):
    rows = [(i, *(float(p[c]) if c in ("min_rating", "max_cost") and p.get(c) is not None else p.get(c) for c in A.FIELDS)) for i, p in enumerate(prefs)]
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_one_request_at_a_time(spark, monkeypatch):
    listings = imported_listings(spark, SF_SMALL)
    prefs = [*REQUESTS.values(), REQUESTS["canned_budget"], {"cuisines": [], "city": ""}]
    want = {}
    for i, p in enumerate(prefs):
        want[i] = [(r.rank, r.listing_id, r.score) for r in R.recommend(listings, p, 7).orderBy("rank").collect()]
    for block, segment in ((4096, 1 << 16), (3, 20)):
        monkeypatch.setattr(A, "PREFERENCES", block)
        monkeypatch.setattr(A, "SEGMENT", segment)
        got = {i: [] for i in want}
        for r in A.recommend_all(listings.repartition(3), request_frame(spark, prefs), 7).orderBy("request_id", "rank").collect():
            got[r.request_id].append((r.rank, r.listing_id, r.score))
        assert got == want


def test_nulls_empty_tables_and_unknown_columns(spark):
    listings = imported_listings(spark, SF_SMALL)
    assert A.recommend_all(listings.limit(0), request_frame(spark, [{}])).collect() == []
    assert A.recommend_all(listings, request_frame(spark, [])).collect() == []
    bare = listings.withColumns({c: F.lit(None).cast(listings.schema[c].dataType) for c in ("aggregate_rating", "votes", "city", "cuisines", "average_cost_inr", "log_votes", "cost_relative_to_city", "price_range")})
    p = {"cuisines": ["x"], "city": "y", "price_range": 2, "max_cost": 5.0}
    want = [(r.rank, r.listing_id, r.score) for r in R.recommend(bare, p, 10).collect()]
    assert sorted((r.rank, r.listing_id, r.score) for r in A.recommend_all(bare, request_frame(spark, [p])).collect()) == sorted(want)
    only_city = spark.createDataFrame([(1, "NATION_1")], "request_id long, city string").withColumn("note", F.lit("x"))
    want = sorted((r.rank, r.listing_id, r.score) for r in R.recommend(listings, {"city": "NATION_1"}, 10).collect())
    assert sorted((r.rank, r.listing_id, r.score) for r in A.recommend_all(listings, only_city).collect()) == want


def test_most_pairs_are_never_scored():
    rnd = random.Random(3)
    n = 20_000
    cities, sets = [f"c{i}" for i in range(25)], ["a", "b", "a, b", "c", "d, a"]
    table = pa.table({
        "listing_id": pa.array(range(n), pa.int64()), "aggregate_rating": [rnd.randrange(50) / 10 for _ in range(n)], "votes": [rnd.randrange(900) for _ in range(n)],
        "average_cost_inr": [float(rnd.randrange(3000)) for _ in range(n)], "log_votes": [rnd.random() * 7 for _ in range(n)], "restaurant_popularity_score": [rnd.random() * 30 for _ in range(n)],
        "cost_relative_to_city": [rnd.random() * 2 for _ in range(n)], "city": [rnd.choice(cities) for _ in range(n)], "cuisines": [rnd.choice(sets) for _ in range(n)], "price_range": [rnd.randrange(1, 5) for _ in range(n)],
    })
    classes = A.Classes(table, ["cuisines", "city", "price_range"])
    requests = [dict.fromkeys(A.FIELDS) | {"cuisines": [rnd.choice("abcd")], "city": rnd.choice(cities), "price_range": rnd.randrange(1, 5), "min_rating": 2.0} for _ in range(200)]
    for p in requests:
        classes.search(p, (7.0, 30.0), A.Top(10))
    assert classes.scored < 0.05 * n * len(requests)
    assert np.isfinite(classes.scored)
