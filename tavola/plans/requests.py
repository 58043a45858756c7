"""Requests used by the registered queries (FIXTURES.md B), in the listing view's domains.

The reference's three canned scenarios are translated: cuisine -> order
priority name, city -> nation name.  Edge requests exercise the boundary
rules of the scoring.
"""

# Translated canned scenarios and edge requests.
REQUESTS = {
    "canned_delivery": {
        "cuisines": ["1-URGENT"], "city": "NATION_1", "price_range": 2, "min_rating": 3.8,
        "cost_category": "Budget", "popularity_category": "High", "online_delivery": "Yes",
    },
    "canned_budget": {"cuisines": ["3-MEDIUM", "5-LOW"], "price_range": 2, "min_rating": 3.5, "max_cost": 1200, "is_expensive": 0},
    "canned_booking": {"cuisines": ["2-HIGH"], "price_range": 3, "min_rating": 4.0, "rating_category": "Excellent", "table_booking": "Yes"},
    "empty": {},
    "no_survivors": {"cuisines": ["1-URGENT"], "min_rating": 5.0},
    "duplicate_cuisine": {"cuisines": ["4-NOT SPECIFIED", "4-not specified", "2-HIGH"], "price_range": 4},
    "upper_city_locality": {"city": "NATION_7", "locality": "build", "delivering_now": "Yes", "popularity_category": "medium"},
    "zero_budget": {"max_cost": 0, "min_rating": 0.0, "cost_category": "Luxury", "is_expensive": 1},
    "real_cluster": {"city": "NATION_7", "location_cluster": 1, "city_location_cluster": "nation_7_1", "price_range": 3},
    "clusters_and_flags": {"location_cluster": -1, "city_location_cluster": "unknown", "online_delivery": "No", "table_booking": "No", "rating_category": "Not Rated"},
}
