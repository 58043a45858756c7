"""Independent SQL definitions of the views, for the DuckDB oracle.

These are plain ANSI-style SQL over the driver's pre-registered tables.  They
are written separately from the DataFrame code on purpose: the oracle must not
share logic with the implementation it checks.  Fractions are written in ``e``
notation so both engines read them as DOUBLE, not DECIMAL.
"""

LISTINGS = """
listings AS (
  SELECT c.c_custkey AS listing_id,
         concat(p.p_name, ' ', lower(p.p_type)) AS listing_name,
         CAST(n.n_regionkey AS INTEGER) AS country_code,
         n.n_name AS city,
         c.c_name AS address,
         c.c_mktsegment AS locality,
         n.n_regionkey * 10 + 2e-1 * ((c.c_custkey * 104729) % 10007) / 1.0007e4 AS longitude,
         n.n_nationkey + 2e-1 * ((c.c_custkey * 7919) % 10007) / 1.0007e4 AS latitude,
         CASE WHEN c.c_custkey % 97 = 0 THEN NULL ELSE o.prio END AS cuisines,
         CASE WHEN c.c_acctbal <= 0 THEN 0e0 ELSE CAST(floor(c.c_acctbal / 5) AS DOUBLE) END AS cost_for_two,
         CASE n.n_regionkey WHEN 0 THEN 'Rand(R)' WHEN 1 THEN 'Dollar($)' WHEN 2 THEN 'Indian Rupees(Rs.)'
                            WHEN 3 THEN 'Pounds' WHEN 4 THEN 'Emirati Diram(AED)' END AS currency,
         CAST(1 + c.c_custkey % 4 AS INTEGER) AS price_range,
         CASE WHEN o.n_orders IS NULL OR c.c_custkey % 11 = 0 THEN 0e0
              ELSE least(49, 10 + floor(5.5e1 * coalesce(o.votes, 0) / (o.n_orders * 5e1))) / 1e1 END AS aggregate_rating,
         CAST(coalesce(o.votes, 0) AS BIGINT) AS votes,
         CASE WHEN o.n_p >= 4 THEN 'Yes' ELSE 'No' END AS has_table_booking,
         CASE WHEN o.n_f > o.n_o THEN 'Yes' ELSE 'No' END AS has_online_delivery,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS is_delivering_now
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON p.p_partkey = c.c_custkey
  LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders,
           CAST(sum(floor(o_totalprice / 1e4)) AS BIGINT) AS votes,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
           count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
           array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS prio
    FROM orders GROUP BY o_custkey
  ) o ON o.o_custkey = c.c_custkey
)
"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n" + body


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nested_replace(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


LISTING_TEXT_COLUMNS = [
    "listing_name", "city", "address", "locality", "cuisines", "currency",
    "has_table_booking", "has_online_delivery", "is_delivering_now",
]
LISTING_OTHER_COLUMNS = [
    "listing_id", "country_code", "longitude", "latitude", "cost_for_two", "price_range", "aggregate_rating", "votes",
]


def repaired() -> str:
    from tavola.functions.repairs import REPAIRS_1, REPAIRS_2, REPAIRS_TURKISH
    from tavola.functions.text import NAME_STRIP_PATTERN

    cols = list(LISTING_OTHER_COLUMNS)
    for c in LISTING_TEXT_COLUMNS:
        e = nested_replace(nested_replace(c, REPAIRS_1), REPAIRS_2)
        if c == "listing_name":
            e = f"regexp_replace({e}, {q(NAME_STRIP_PATTERN)}, '', 'g')"
        e = nested_replace(e, REPAIRS_TURKISH)
        if c == "cuisines":
            e = f"coalesce({e}, 'Unknown')"
        cols.append(f"{e} AS {c}")
    return "repaired AS (SELECT " + ", ".join(cols) + " FROM listings)"


def currency_case(col: str) -> str:
    from tavola.functions.repairs import CURRENCY_TO_INR

    arms = " ".join(f"WHEN {q(k)} THEN CAST('{float(v)!r}' AS DOUBLE)" for k, v in CURRENCY_TO_INR.items())
    return f"CASE {col} {arms} END"


PREPARED_STEPS = """
conv AS (SELECT *, cost_for_two * {rate} AS cost0 FROM repaired),
g1 AS (SELECT country_code, city, price_range, median(cost0) FILTER (WHERE cost0 <> 0) AS m1
       FROM conv GROUP BY country_code, city, price_range),
l1 AS (SELECT conv.*, CASE WHEN cost0 = 0 AND g1.m1 IS NOT NULL THEN g1.m1 ELSE cost0 END AS cost1
       FROM conv LEFT JOIN g1 ON conv.country_code = g1.country_code AND conv.city = g1.city AND conv.price_range = g1.price_range),
g2 AS (SELECT country_code, price_range, median(cost1) FILTER (WHERE cost1 <> 0) AS m2
       FROM l1 GROUP BY country_code, price_range),
l2 AS (SELECT l1.*, CASE WHEN cost1 = 0 AND g2.m2 IS NOT NULL THEN g2.m2 ELSE cost1 END AS average_cost_inr
       FROM l1 LEFT JOIN g2 ON l1.country_code = g2.country_code AND l1.price_range = g2.price_range),
cs AS (SELECT city, median(average_cost_inr) AS city_median, count(average_cost_inr) AS city_n,
              count(*) AS city_rows, count(listing_id) AS city_ids FROM l2 GROUP BY city),
cp AS (SELECT country_code, price_range, median(average_cost_inr) AS cp_median FROM l2 GROUP BY country_code, price_range),
rk AS (SELECT listing_id AS rid, row_number() OVER (PARTITION BY city ORDER BY average_cost_inr, listing_id) AS rn
       FROM l2 WHERE average_cost_inr IS NOT NULL AND city IS NOT NULL),
prepared AS (
  SELECT l2.listing_id, l2.listing_name, l2.country_code, l2.city, l2.address, l2.locality, l2.longitude, l2.latitude,
         l2.cuisines, l2.cost_for_two, l2.currency, l2.price_range, l2.aggregate_rating, l2.votes,
         l2.has_table_booking, l2.has_online_delivery, l2.is_delivering_now, l2.average_cost_inr,
         ln(1 + l2.average_cost_inr) AS log_average_cost_inr,
         CASE WHEN coalesce(cs.city_n, 0) >= 10 THEN l2.average_cost_inr / nullif(cs.city_median, 0)
              ELSE l2.average_cost_inr / nullif(cp.cp_median, 0) END AS cost_relative_to_city,
         CASE WHEN cs.city_rows < 4 THEN 'Medium'
              WHEN rk.rn IS NULL THEN NULL
              ELSE ['Budget', 'Medium', 'Premium', 'Luxury'][greatest(1, CAST(ceil(4e0 * (rk.rn - 1) / nullif(cs.city_n - 1, 0)) AS INTEGER))] END
           AS city_wise_cost_category,
         CASE WHEN l2.average_cost_inr > -1 AND l2.average_cost_inr <= 300 THEN 'Budget'
              WHEN l2.average_cost_inr > 300 AND l2.average_cost_inr <= 700 THEN 'Medium'
              WHEN l2.average_cost_inr > 700 AND l2.average_cost_inr <= 1500 THEN 'Premium'
              WHEN l2.average_cost_inr > 1500 THEN 'Luxury' END AS restaurant_cost_category,
         CAST(CASE WHEN lower(trim(l2.cuisines)) = 'unknown' THEN 0 ELSE len(string_split(l2.cuisines, ',')) END AS INTEGER) AS cuisine_count,
         trim(string_split(l2.cuisines, ',')[1]) AS primary_cuisine,
         ln(1 + l2.votes) AS log_votes,
         CASE WHEN l2.aggregate_rating = 0 THEN 'Not Rated'
              WHEN l2.aggregate_rating >= 0 AND l2.aggregate_rating <= 2.5e0 THEN 'Poor'
              WHEN l2.aggregate_rating > 2.5e0 AND l2.aggregate_rating <= 3.5e0 THEN 'Average'
              WHEN l2.aggregate_rating > 3.5e0 AND l2.aggregate_rating <= 4e0 THEN 'Good'
              WHEN l2.aggregate_rating > 4e0 AND l2.aggregate_rating <= 5e0 THEN 'Excellent' END AS rating_category,
         CASE WHEN l2.votes > -1 AND l2.votes <= 50 THEN 'Low'
              WHEN l2.votes > 50 AND l2.votes <= 200 THEN 'Medium'
              WHEN l2.votes > 200 AND l2.votes <= 1000 THEN 'High'
              WHEN l2.votes > 1000 THEN 'Very High' END AS popularity_category,
         l2.aggregate_rating * ln(1 + l2.votes) AS restaurant_popularity_score,
         CAST(coalesce(l2.price_range >= 3, false) AS INTEGER) AS is_expensive,
         CAST(coalesce(l2.has_online_delivery = 'Yes' OR l2.has_table_booking = 'Yes', false) AS INTEGER) AS has_delivery_or_booking,
         CAST(cs.city_ids AS INTEGER) AS city_restaurant_count
  FROM l2
  LEFT JOIN cs ON l2.city = cs.city
  LEFT JOIN cp ON l2.country_code = cp.country_code AND l2.price_range = cp.price_range
  LEFT JOIN rk ON l2.listing_id = rk.rid
)
"""


def prepared() -> str:
    return PREPARED_STEPS.replace("{rate}", currency_case("currency")).strip()


def cluster_steps(src: str) -> str:
    """Places, cluster counts, seeds and the state of every (city, start), from the rows of ``src``."""
    return f"""
places AS MATERIALIZED (
  SELECT city, latitude, longitude, CAST(count(*) AS DOUBLE) AS weight FROM {src} WHERE city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY ALL),
boxes AS (
  SELECT city, count(*) AS n_points, count(DISTINCT (latitude, longitude)) AS n, avg(latitude) AS mean_lat, (var_pop(latitude) + var_pop(longitude)) / 2 AS mean_var,
    min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon,
    quantile_cont(latitude, 0.95) - quantile_cont(latitude, 0.05) AS height, quantile_cont(longitude, 0.95) - quantile_cont(longitude, 0.05) AS width
  FROM {src} WHERE city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY city),
sized AS MATERIALIZED (
  SELECT *, CAST(CASE WHEN n_points < 2 OR n < 2 THEN 1 ELSE least(greatest(ceil(abs(height * 111e0 * (width * 111e0 * cos(radians(mean_lat)))) / 25e0), 1), 30, n_points, n) END AS BIGINT) AS k
  FROM boxes),
banded AS (
  SELECT p.*, k, n,
    CASE WHEN max_lat > min_lat THEN least(floor((latitude - min_lat) / (max_lat - min_lat) * ceil(sqrt(k))), ceil(sqrt(k)) - 1) ELSE 0 END AS lat_band,
    CASE WHEN max_lon > min_lon THEN least(floor((longitude - min_lon) / (max_lon - min_lon) * ceil(sqrt(k))), ceil(sqrt(k)) - 1) ELSE 0 END AS lon_band,
    (CAST(round(latitude * 1e6) AS BIGINT) * 48271 + CAST(round(longitude * 1e6) AS BIGINT) * 69621) * 5 AS scatter
  FROM places p JOIN sized s ON p.city = s.city),
ordered AS (
  SELECT city, latitude, longitude, k, n, 0 AS start, lat_band AS a, CASE WHEN lat_band % 2 = 0 THEN longitude ELSE -longitude END AS b, latitude AS c FROM banded
  UNION ALL SELECT city, latitude, longitude, k, n, 1, lon_band, CASE WHEN lon_band % 2 = 0 THEN latitude ELSE -latitude END, longitude FROM banded
  UNION ALL SELECT city, latitude, longitude, k, n, 2, ((scatter % 2147483647) + 2147483647) % 2147483647, latitude, longitude FROM banded),
numbered AS (SELECT *, row_number() OVER (PARTITION BY city, start ORDER BY a, b, c) - 1 AS r FROM ordered),
picked AS (SELECT *, (r * k + n - 1) // n AS j FROM numbered),
seeds AS MATERIALIZED (SELECT city, start, CAST(j AS INTEGER) AS cluster, latitude AS c_lat, longitude AS c_lon FROM picked WHERE j < k AND (j * n) // k = r),
states AS MATERIALIZED (SELECT city, start, list(struct_pack(cluster := cluster, c_lat := c_lat, c_lon := c_lon) ORDER BY cluster) AS centres FROM seeds GROUP BY city, start)"""


NEAREST = "list_sort(list_transform({c}, lambda x: struct_pack(d := (latitude - x.c_lat) ** 2 + (longitude - x.c_lon) ** 2, cluster := x.cluster)))[1]"


def cluster_round(state: str, keep: str = "true") -> str:
    """One round from the rows (city, start, centres, round, lim) of ``state``: the same with the centres' shift."""
    return f"""
  SELECT city, start, centres, round + 1 AS round, lim,
    list_sum(list_transform(range(1, len(centres) + 1), lambda i: (old[i].c_lat - centres[i].c_lat) ** 2 + (old[i].c_lon - centres[i].c_lon) ** 2)) AS shift
  FROM (
    SELECT city, start, round, lim, old, list_transform(old, lambda x: struct_pack(cluster := x.cluster,
      c_lat := coalesce(map_extract(m, x.cluster)[1].lat, x.c_lat), c_lon := coalesce(map_extract(m, x.cluster)[1].lon, x.c_lon))) AS centres
    FROM (
      SELECT city, start, any_value(round) AS round, any_value(lim) AS lim, any_value(centres) AS old, map_from_entries(list(row(cluster, struct_pack(lat := lat, lon := lon)))) AS m
      FROM (
        SELECT city, start, cluster, any_value(round) AS round, any_value(lim) AS lim, any_value(centres) AS centres,
          sum(weight * latitude) / sum(weight) AS lat, sum(weight * longitude) / sum(weight) AS lon
        FROM (SELECT s.city, start, round, lim, centres, latitude, longitude, weight, {NEAREST.format(c='centres')}.cluster AS cluster
              FROM {state} s JOIN places p ON p.city = s.city WHERE {keep})
        GROUP BY city, start, cluster)
      GROUP BY city, start))"""


def clusters(src: str) -> str:
    """CTE ``clusters_of``: the location cluster of every place, by rounds until every start has converged."""
    return f"""clusters_of AS MATERIALIZED (
WITH RECURSIVE {cluster_steps(src).strip()},
rounds(city, start, centres, round, lim, shift) AS (
  SELECT s.city, start, centres, 0, 1e-4 * coalesce(mean_var, 0), CAST('infinity' AS DOUBLE) FROM states s JOIN sized z ON z.city = s.city
  UNION ALL {cluster_round('rounds', 'round = 0 OR round % 3 <> 0 OR shift > lim')}),
ended AS (SELECT * FROM rounds WHERE round > 0 AND round % 3 = 0 AND shift <= lim),
assigned AS MATERIALIZED (
  SELECT e.city, start, latitude, longitude, weight, centres, {NEAREST.format(c='centres')} AS best FROM ended e JOIN places p ON p.city = e.city),
inertias AS (SELECT city, start, sum(weight * best.d) AS inertia FROM assigned GROUP BY city, start),
chosen AS (SELECT city, start FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY round(inertia, 9), start) AS r FROM inertias) WHERE r = 1),
kept AS MATERIALIZED (SELECT a.*, best.cluster AS cluster FROM assigned a JOIN chosen c ON a.city = c.city AND a.start = c.start),
used AS (SELECT DISTINCT city, cluster, list_filter(centres, lambda x: x.cluster = cluster)[1] AS c FROM kept),
named AS (SELECT city, cluster, CAST(row_number() OVER (PARTITION BY city ORDER BY c.c_lat, c.c_lon, cluster) - 1 AS INTEGER) AS location_cluster FROM used)
SELECT k.city, latitude, longitude, location_cluster FROM kept k JOIN named n ON n.city = k.city AND n.cluster = k.cluster)"""


def clustered(src: str) -> str:
    """CTE ``clustered``: the rows of ``src`` with their cluster and its key."""
    return clusters(src) + f""",
clustered AS MATERIALIZED (
  SELECT s.*, coalesce(location_cluster, 0) AS location_cluster, coalesce(s.city, 'nan') || '_' || coalesce(location_cluster, 0) AS city_location_cluster
  FROM {src} s LEFT JOIN clusters_of c ON c.city = s.city AND c.latitude = s.latitude AND c.longitude = s.longitude)"""


IMPORTED = clustered("prepared") + """,
imp0 AS (
  SELECT * FROM clustered WHERE listing_id IS NOT NULL AND listing_name IS NOT NULL AND cuisines IS NOT NULL
),
imported AS (
  SELECT CAST(listing_id AS BIGINT) AS listing_id,
         trim(coalesce(listing_name, 'Unknown')) AS listing_name,
         CAST(coalesce(country_code, 0) AS INTEGER) AS country_code,
         trim(coalesce(city, 'Unknown')) AS city,
         trim(coalesce(address, 'Unknown')) AS address,
         trim(coalesce(locality, 'Unknown')) AS locality,
         longitude, latitude,
         trim(coalesce(cuisines, 'Unknown')) AS cuisines,
         coalesce(average_cost_inr, (SELECT median(average_cost_inr) FROM imp0)) AS average_cost_inr,
         coalesce(log_average_cost_inr, ln(1 + greatest(coalesce(average_cost_inr, (SELECT median(average_cost_inr) FROM imp0)), 0))) AS log_average_cost_inr,
         coalesce(cost_relative_to_city, 1e0) AS cost_relative_to_city,
         trim(coalesce(city_wise_cost_category, 'Unknown')) AS city_wise_cost_category,
         trim(coalesce(restaurant_cost_category, 'Unknown')) AS restaurant_cost_category,
         CAST(trunc(coalesce(CAST(price_range AS DOUBLE), (SELECT median(CAST(price_range AS DOUBLE)) FROM imp0))) AS INTEGER) AS price_range,
         coalesce(aggregate_rating, 0e0) AS aggregate_rating,
         trim(coalesce(rating_category, 'Unknown')) AS rating_category,
         CAST(coalesce(votes, 0) AS BIGINT) AS votes,
         coalesce(log_votes, ln(1 + greatest(coalesce(votes, 0), 0))) AS log_votes,
         trim(coalesce(popularity_category, 'Unknown')) AS popularity_category,
         coalesce(restaurant_popularity_score, 0e0) AS restaurant_popularity_score,
         CAST(coalesce(city_restaurant_count, 0) AS INTEGER) AS city_restaurant_count,
         CASE WHEN upper(trim(coalesce(has_table_booking, ''))) = 'YES' THEN 'Yes' ELSE 'No' END AS has_table_booking,
         CASE WHEN upper(trim(coalesce(has_online_delivery, ''))) = 'YES' THEN 'Yes' ELSE 'No' END AS has_online_delivery,
         CASE WHEN upper(trim(coalesce(is_delivering_now, ''))) = 'YES' THEN 'Yes' ELSE 'No' END AS is_delivering_now,
         CAST(coalesce(is_expensive, 0) AS INTEGER) AS is_expensive,
         CAST(coalesce(has_delivery_or_booking, 0) AS INTEGER) AS has_delivery_or_booking,
         coalesce(location_cluster, -1) AS location_cluster,
         trim(coalesce(city_location_cluster, 'Unknown')) AS city_location_cluster
  FROM imp0
)
"""
