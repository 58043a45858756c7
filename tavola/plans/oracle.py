"""Oracle SQL (DuckDB) for every registered query with an SQL equivalent."""

from __future__ import annotations

from tavola.plans import oracle_views as V
from tavola.plans.oracle_views import q


def _lower_eq(col: str, v: str) -> str:
    return f"(lower(coalesce({col}, '')) = {q(v.lower())})"


def recommend_sql(prefs: dict, top_n: int = 10, round_score: bool = True) -> str:
    """Independent SQL formulation of the scoring over the ``imported`` view."""
    terms, reasons = [], []
    cz = [c.lower() for c in prefs.get("cuisines") or []]
    if cz:
        wanted = "[" + ", ".join(q(c) for c in dict.fromkeys(cz)) + "]"
        toks = "list_distinct(list_filter(list_transform(string_split(lower(coalesce(cuisines, '')), ','), lambda x: trim(x)), lambda x: x <> ''))"
        ratio = f"(len(list_intersect({toks}, {wanted})) / {float(len(cz))!r})"
        terms.append(f"{ratio} * 40e0")
        reasons.append(f"CASE WHEN {ratio} > 0 THEN 'cuisine match; ' ELSE '' END")
    if prefs.get("city"):
        m = _lower_eq("city", prefs["city"])
        terms.append(f"CAST({m} AS DOUBLE) * 20e0")
        reasons.append(f"CASE WHEN {m} THEN 'city match; ' ELSE '' END")
    if prefs.get("locality"):
        m = f"contains(lower(coalesce(locality, '')), {q(prefs['locality'].lower())})"
        terms.append(f"CAST({m} AS DOUBLE) * 3e0")
        reasons.append(f"CASE WHEN {m} THEN 'weak locality match; ' ELSE '' END")
    if prefs.get("price_range") is not None:
        p = int(prefs["price_range"])
        d = f"abs(coalesce(price_range, {p}) - {p})"
        terms.append(f"(1 - least(greatest({d} / 3e0, 0e0), 1e0)) * 12e0")
        reasons.append(f"CASE WHEN {d} = 0 THEN 'price match; ' ELSE '' END")
    if prefs.get("min_rating") is not None:
        reasons.append(q(f"rating >= {float(prefs['min_rating'])!r}; "))
    terms.append("(least(greatest(coalesce(aggregate_rating, 0e0), 0e0), 5e0) / 5e0) * 12e0")
    if prefs.get("rating_category"):
        m = _lower_eq("rating_category", prefs["rating_category"])
        terms.append(f"CAST({m} AS DOUBLE) * 6e0")
        reasons.append(f"CASE WHEN {m} THEN 'rating category match; ' ELSE '' END")
    if prefs.get("max_cost") is not None:
        mc = float(prefs["max_cost"])
        cost = f"coalesce(average_cost_inr, CAST('{mc!r}' AS DOUBLE))"
        terms.append(f"(1 - least(greatest(greatest({cost} - CAST('{mc!r}' AS DOUBLE), 0e0) / CAST('{max(mc, 1.0)!r}' AS DOUBLE), 0e0), 1e0)) * 8e0")
        reasons.append(f"CASE WHEN {cost} <= CAST('{mc!r}' AS DOUBLE) THEN 'within budget; ' ELSE '' END")
    for key, col, w, text in (
        ("cost_category", "restaurant_cost_category", "8e0", "cost category match; "),
        ("popularity_category", "popularity_category", "6e0", "popularity category match; "),
    ):
        if prefs.get(key):
            m = _lower_eq(col, prefs[key])
            terms.append(f"CAST({m} AS DOUBLE) * {w}")
            reasons.append(f"CASE WHEN {m} THEN {q(text)} ELSE '' END")
    if prefs.get("is_expensive") is not None:
        m = f"(CAST(coalesce(is_expensive, 0) AS INTEGER) = {int(prefs['is_expensive'])})"
        terms.append(f"CAST({m} AS DOUBLE) * 4e0")
        reasons.append(f"CASE WHEN {m} THEN 'expensive preference match; ' ELSE '' END")
    if prefs.get("location_cluster") is not None:
        m = f"(CAST(coalesce(location_cluster, -1) AS INTEGER) = {int(prefs['location_cluster'])})"
        terms.append(f"CAST({m} AS DOUBLE) * 8e0")
        reasons.append(f"CASE WHEN {m} THEN 'location cluster match; ' ELSE '' END")
    if prefs.get("city_location_cluster"):
        m = _lower_eq("city_location_cluster", prefs["city_location_cluster"])
        terms.append(f"CAST({m} AS DOUBLE) * 8e0")
        reasons.append(f"CASE WHEN {m} THEN 'city-location cluster match; ' ELSE '' END")
    for key, col, w, text in (
        ("online_delivery", "has_online_delivery", "5e0", "delivery match; "),
        ("table_booking", "has_table_booking", "5e0", "booking match; "),
        ("delivering_now", "is_delivering_now", "3e0", "currently delivering match; "),
    ):
        if prefs.get(key):
            m = _lower_eq(col, prefs[key])
            terms.append(f"CAST({m} AS DOUBLE) * {w}")
            reasons.append(f"CASE WHEN {m} THEN {q(text)} ELSE '' END")
    total = "0e0"
    for t in terms:
        total = f"({total} + {t})"
    total = (
        f"(({total} + CASE WHEN mx.lv > 0 THEN coalesce(log_votes, 0e0) / mx.lv * 6e0 ELSE 0e0 END)"
        f" + CASE WHEN mx.ps > 0 THEN coalesce(restaurant_popularity_score, 0e0) / mx.ps * 6e0 ELSE 0e0 END)"
        f" + (1 - least(greatest(abs(coalesce(cost_relative_to_city, 1e0) - 1), 0e0), 1e0)) * 2e0"
    )
    reason = "concat(''" + "".join(", " + r for r in reasons) + ")"
    where = ""
    if prefs.get("min_rating") is not None:
        where = f"WHERE coalesce(aggregate_rating, 0e0) >= CAST('{float(prefs['min_rating'])!r}' AS DOUBLE)"
    body = f"""
pool AS (SELECT * FROM imported {where}),
mx AS (SELECT max(coalesce(log_votes, 0e0)) AS lv, max(coalesce(restaurant_popularity_score, 0e0)) AS ps FROM pool),
scored AS (SELECT pool.*, {total} AS score, {reason} AS match_reasons FROM pool, mx),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, aggregate_rating DESC, votes DESC, listing_id ASC) AS INTEGER) AS rank FROM scored)
SELECT rank, listing_id, listing_name, city, locality, cuisines, price_range, round(average_cost_inr, 6) AS average_cost_inr,
       restaurant_cost_category, round(aggregate_rating, 6) AS aggregate_rating, rating_category, votes, popularity_category,
       round(restaurant_popularity_score, 6) AS restaurant_popularity_score, has_online_delivery, has_table_booking,
       is_delivering_now, is_expensive, location_cluster, city_location_cluster, {'round(score, 4)' if round_score else 'score'} AS score, match_reasons
FROM ranked WHERE rank <= {int(top_n)}
"""
    return "WITH " + ",\n".join([V.LISTINGS.strip(), V.repaired(), V.prepared(), V.IMPORTED.strip(), body.strip()])


def oracle_sql() -> dict[str, str]:
    from tavola.plans.requests import REQUESTS

    out: dict[str, str] = {}
    for name, prefs in REQUESTS.items():
        out[f"recommend_{name}"] = recommend_sql(prefs, 10)
    out.update(_quality_sql())
    out.update(_clean_feature_sql())
    out.update(_label_eval_sql())
    out.update(_warehouse_sql())
    return out


def W(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


SPARK_TYPE = "CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT' THEN 'float' ELSE lower({t}) END"

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
RAW_LISTING_COLS = ["listing_id", "listing_name", "country_code", "city", "address", "locality", "longitude", "latitude", "cuisines", "cost_for_two", "currency", "price_range", "aggregate_rating", "votes", "has_table_booking", "has_online_delivery", "is_delivering_now"]


PREPARED_DOUBLES = {
    "longitude", "latitude", "cost_for_two", "aggregate_rating", "average_cost_inr", "log_average_cost_inr",
    "cost_relative_to_city", "log_votes", "restaurant_popularity_score",
}
IMPORTED_COLUMNS = [
    "listing_id", "listing_name", "country_code", "city", "address", "locality", "longitude", "latitude",
    "cuisines", "average_cost_inr", "log_average_cost_inr", "cost_relative_to_city", "city_wise_cost_category",
    "restaurant_cost_category", "price_range", "aggregate_rating", "rating_category", "votes", "log_votes",
    "popularity_category", "restaurant_popularity_score", "city_restaurant_count", "has_table_booking",
    "has_online_delivery", "is_delivering_now", "is_expensive", "has_delivery_or_booking", "location_cluster",
    "city_location_cluster",
]
DOC_PATTERN_VALUES_SQL = "ß|ñ"
DOC_PATTERN_COUNTS_SQL = "é|ü"


def _quality_sql() -> dict[str, str]:
    L = V.LISTINGS
    prof = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, {SPARK_TYPE.format(t='any_value(typeof(' + c + '))')} AS data_type, count({c}) AS non_null FROM lineitem"
        for i, c in enumerate(LINEITEM_COLS)
    )
    nulls = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM listings" for c in RAW_LISTING_COLS)
    conv = f"conv AS (SELECT *, cost_for_two * {V.currency_case('currency')} AS average_cost_inr FROM listings)"
    corrupt_vals = " UNION ".join(
        f"SELECT '{c}' AS column_name, {c} AS value FROM documents WHERE regexp_matches({c}, {q(DOC_PATTERN_VALUES_SQL)})" for c in ["text", "lang", "source"]
    )
    corrupt_cnt = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE regexp_matches({c}, {q(DOC_PATTERN_COUNTS_SQL)})) AS corrupted FROM documents" for c in ["text", "lang", "source"]
    )
    return {
        "profile_lineitem": prof,
        "null_counts_listings": W(nulls, L),
        "duplicate_rows_documents": "SELECT text, CAST(o AS BIGINT) AS occurrence FROM (SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) g, range(2, n + 1) r(o)",
        "duplicate_count_documents": "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)",
        "corrupt_values_documents": corrupt_vals,
        "corrupt_counts_documents": f"SELECT * FROM ({corrupt_cnt}) WHERE corrupted > 0",
        "distinct_sorted_cost": W("SELECT DISTINCT round(cost_for_two, 6) AS cost_for_two FROM listings", L),
        "null_zero_cost": W("SELECT count(*) FILTER (WHERE average_cost_inr IS NULL) AS nulls, count(*) FILTER (WHERE average_cost_inr = 0) AS zeros FROM conv", L, conv),
        "zero_only_groups_cost": W(
            """SELECT city, locality, price_range, count(average_cost_inr) AS total_rows,
                      count(*) FILTER (WHERE average_cost_inr = 0) AS zero_count,
                      count(*) FILTER (WHERE NOT coalesce(average_cost_inr = 0, false)) AS non_zero_count,
                      round(median(average_cost_inr) FILTER (WHERE average_cost_inr <> 0), 6) AS non_zero_median
               FROM conv WHERE city IS NOT NULL AND locality IS NOT NULL AND price_range IS NOT NULL
               GROUP BY city, locality, price_range
               HAVING count(*) FILTER (WHERE NOT coalesce(average_cost_inr = 0, false)) = 0""",
            L, conv,
        ),
        "group_median_order_currency": W(
            """SELECT currency, round(m, 6) AS median_value, CAST(row_number() OVER (ORDER BY m DESC, currency ASC) AS INTEGER) AS rank
               FROM (SELECT currency, median(cost_for_two) AS m FROM listings WHERE cost_for_two > 0 GROUP BY currency)""",
            L,
        ),
        "box_stats_currency": W(
            """SELECT * FROM (WITH q AS (SELECT currency, quantile_cont(cost_for_two, 0.25) AS q1, median(cost_for_two) AS med,
                             quantile_cont(cost_for_two, 0.75) AS q3, count(*) AS n FROM b GROUP BY currency)
               SELECT q.currency, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, n,
                      round(min(cost_for_two) FILTER (WHERE cost_for_two >= q1 - 1.5e0 * (q3 - q1)), 6) AS lower_whisker,
                      round(max(cost_for_two) FILTER (WHERE cost_for_two <= q3 + 1.5e0 * (q3 - q1)), 6) AS upper_whisker,
                      count(*) FILTER (WHERE cost_for_two < q1 - 1.5e0 * (q3 - q1) OR cost_for_two > q3 + 1.5e0 * (q3 - q1)) AS outliers,
                      round(q3 - q1, 6) AS iqr
               FROM q JOIN b ON q.currency = b.currency GROUP BY q.currency, q1, med, q3, n)""",
            L, "b AS (SELECT currency, cost_for_two FROM listings WHERE cost_for_two > 0)",
        ),
    }


def _clean_feature_sql() -> dict[str, str]:
    from tavola.plans.catalog import DOC_REPAIRS, DOC_STRIP
    from tavola.operators.clean import LEAKAGE_COLUMNS

    L = V.LISTINGS
    conv = f"conv AS (SELECT *, cost_for_two * {V.currency_case('currency')} AS average_cost_inr FROM listings)"

    def imp(src: str, keys: list[str], name: str) -> str:
        on = " AND ".join(f"s.{k} = g.{k}" for k in keys)
        ks = ", ".join(keys)
        return (
            f"{name} AS (SELECT s.* REPLACE (CASE WHEN s.average_cost_inr = 0 AND g.m IS NOT NULL THEN g.m ELSE s.average_cost_inr END AS average_cost_inr) "
            f"FROM {src} s LEFT JOIN (SELECT {ks}, median(average_cost_inr) FILTER (WHERE average_cost_inr <> 0) AS m FROM {src} GROUP BY {ks}) g ON {on})"
        )

    yn = lambda c: f"CASE WHEN upper(trim(CAST({c} AS VARCHAR))) = 'YES' THEN 'Yes' ELSE 'No' END AS {c}"
    leak = set(LEAKAGE_COLUMNS["base"])
    from tavola.plans.catalog import PREPARED_COLUMNS

    keep = [c for c in PREPARED_COLUMNS if c not in leak]
    r6 = lambda c, t=None: f"round({c}, 6) AS {c}" if c in PREPARED_DOUBLES else c
    return {
        "replace_literals_documents": f"SELECT doc_id, {V.nested_replace('text', DOC_REPAIRS)} AS text FROM documents",
        "strip_regex_documents": f"SELECT doc_id, regexp_replace(text, {q(DOC_STRIP)}, '', 'g') AS text FROM documents",
        "fill_cuisines": W("SELECT listing_id, coalesce(cuisines, 'Unknown') AS cuisines FROM listings", L),
        "norm_text_listings": W("SELECT listing_id, trim(coalesce(cuisines, 'Unknown')) AS cuisines, trim(coalesce(listing_name, 'Unknown')) AS listing_name FROM listings", L),
        "to_number_part": """SELECT p_partkey, round(TRY_CAST(trim(CAST(p_size AS VARCHAR)) AS DOUBLE), 6) AS size_num,
                                    round(TRY_CAST(trim(p_brand) AS DOUBLE), 6) AS brand_num,
                                    round(TRY_CAST(trim(' ' || CAST(p_retailprice AS VARCHAR) || ' ') AS DOUBLE), 6) AS price_num FROM part""",
        "yes_no_listings": W(
            f"SELECT listing_id, {yn('has_table_booking')}, {yn('has_online_delivery')}, {yn('lower(is_delivering_now)').replace(' AS lower(is_delivering_now)', ' AS is_delivering_now')}, {yn('locality')} FROM listings",
            L,
        ),
        "convert_currency": W("SELECT listing_id, currency, round(average_cost_inr, 6) AS average_cost_inr FROM conv", L, conv),
        "impute_zero_level1": W(
            "SELECT listing_id, round(average_cost_inr, 6) AS average_cost_inr FROM i1", L, conv, imp("conv", ["country_code", "city", "price_range"], "i1")
        ),
        "impute_zero_level2": W(
            "SELECT listing_id, round(average_cost_inr, 6) AS average_cost_inr FROM i2",
            L, conv, imp("conv", ["country_code", "city", "locality", "price_range"], "i1"), imp("i1", ["country_code", "price_range"], "i2"),
        ),
        "fill_median_rating": W(
            """SELECT listing_id, round(coalesce(rating, (SELECT median(rating) FROM r)), 6) AS rating,
                      round(coalesce(cost_for_two, (SELECT median(cost_for_two) FROM r)), 6) AS cost_for_two FROM r""",
            L, "r AS (SELECT listing_id, nullif(aggregate_rating, 0e0) AS rating, cost_for_two FROM listings)",
        ),
        "drop_missing_cuisines": W("SELECT listing_id, cuisines FROM listings WHERE cuisines IS NOT NULL", L),
        "cost_relative_to_city": W(
            """SELECT listing_id, round(CASE WHEN coalesce(cs.n, 0) >= 10 THEN average_cost_inr / nullif(cs.m, 0)
                                            ELSE average_cost_inr / nullif(cp.m, 0) END, 6) AS cost_relative_to_city
               FROM conv LEFT JOIN (SELECT city, median(average_cost_inr) AS m, count(average_cost_inr) AS n FROM conv GROUP BY city) cs ON conv.city = cs.city
               LEFT JOIN (SELECT country_code, price_range, median(average_cost_inr) AS m FROM conv GROUP BY country_code, price_range) cp
                 ON conv.country_code = cp.country_code AND conv.price_range = cp.price_range""",
            L, conv,
        ),
        "city_cost_quartile": W(
            """SELECT c.listing_id, CASE WHEN s.rows_ < 4 THEN 'Medium' WHEN r.rn IS NULL THEN NULL
                      ELSE ['Budget', 'Medium', 'Premium', 'Luxury'][greatest(1, CAST(ceil(4e0 * (r.rn - 1) / nullif(s.n - 1, 0)) AS INTEGER))] END AS city_wise_cost_category
               FROM conv c LEFT JOIN (SELECT city, count(*) AS rows_, count(average_cost_inr) AS n FROM conv GROUP BY city) s ON c.city = s.city
               LEFT JOIN (SELECT listing_id, row_number() OVER (PARTITION BY city ORDER BY average_cost_inr, listing_id) AS rn
                          FROM conv WHERE average_cost_inr IS NOT NULL AND city IS NOT NULL) r ON c.listing_id = r.listing_id""",
            L, conv,
        ),
        "row_features": W(
            """SELECT listing_id,
                 CASE WHEN average_cost_inr > -1 AND average_cost_inr <= 300 THEN 'Budget'
                      WHEN average_cost_inr > 300 AND average_cost_inr <= 700 THEN 'Medium'
                      WHEN average_cost_inr > 700 AND average_cost_inr <= 1500 THEN 'Premium'
                      WHEN average_cost_inr > 1500 THEN 'Luxury' END AS restaurant_cost_category,
                 CAST(CASE WHEN lower(trim(cuisines)) = 'unknown' THEN 0 ELSE len(string_split(cuisines, ',')) END AS INTEGER) AS cuisine_count,
                 trim(string_split(cuisines, ',')[1]) AS primary_cuisine,
                 round(ln(1 + votes), 6) AS log_votes,
                 CASE WHEN aggregate_rating = 0 THEN 'Not Rated'
                      WHEN aggregate_rating >= 0 AND aggregate_rating <= 2.5e0 THEN 'Poor'
                      WHEN aggregate_rating > 2.5e0 AND aggregate_rating <= 3.5e0 THEN 'Average'
                      WHEN aggregate_rating > 3.5e0 AND aggregate_rating <= 4e0 THEN 'Good'
                      WHEN aggregate_rating > 4e0 AND aggregate_rating <= 5e0 THEN 'Excellent' END AS rating_category,
                 CASE WHEN votes > -1 AND votes <= 50 THEN 'Low' WHEN votes > 50 AND votes <= 200 THEN 'Medium'
                      WHEN votes > 200 AND votes <= 1000 THEN 'High' WHEN votes > 1000 THEN 'Very High' END AS popularity_category,
                 round(aggregate_rating * ln(1 + votes), 6) AS restaurant_popularity_score,
                 CAST(coalesce(price_range >= 3, false) AS INTEGER) AS is_expensive,
                 CAST(coalesce(has_online_delivery = 'Yes' OR has_table_booking = 'Yes', false) AS INTEGER) AS has_delivery_or_booking
               FROM (SELECT * REPLACE (coalesce(cuisines, 'Unknown') AS cuisines) FROM conv)""",
            L, conv,
        ),
        "city_restaurant_count": W(
            "SELECT l.listing_id, l.city, CAST(c.n AS INTEGER) AS city_restaurant_count FROM listings l LEFT JOIN (SELECT city, count(listing_id) AS n FROM listings GROUP BY city) c ON l.city = c.city",
            L,
        ),
        "prepare_listings": W("SELECT " + ", ".join(r6(c) for c in PREPARED_COLUMNS) + " FROM clustered", L, V.repaired(), V.prepared(), V.clustered("prepared")),
        "import_listings": W("SELECT " + ", ".join(r6(c) for c in IMPORTED_COLUMNS) + " FROM imported", L, V.repaired(), V.prepared(), V.IMPORTED),
        "drop_leakage_base": W("SELECT " + ", ".join(r6(c) for c in keep) + " FROM clustered", L, V.repaired(), V.prepared(), V.clustered("prepared")),
        "cluster_seeds": W("SELECT city, start, cluster, round(c_lat, 6) AS c_lat, round(c_lon, 6) AS c_lon FROM seeds", L, V.cluster_steps("listings")),
        "cluster_step": W(
            "SELECT city, start, u.cluster, round(u.c_lat, 6) AS c_lat, round(u.c_lon, 6) AS c_lon, round(shift, 6) AS shift FROM (SELECT *, unnest(centres) AS u FROM stepped)",
            L, V.cluster_steps("listings"), "first_state AS (SELECT *, 0 AS round, 0 AS lim FROM states)", f"stepped AS ({V.cluster_round('first_state')})",
        ),
        "geo_clusters": W("SELECT listing_id, city, latitude, longitude, location_cluster, city_location_cluster FROM clustered", L, V.clustered("listings")),
        "cluster_counts": W(
            """SELECT city, n_points, n_locations, round(mean_lat, 6) AS mean_lat, round(lat_lo, 6) AS lat_lo, round(lat_hi, 6) AS lat_hi,
                      round(lon_lo, 6) AS lon_lo, round(lon_hi, 6) AS lon_hi, round(area, 6) AS area_km2,
                      CAST(CASE WHEN n_points < 2 OR n_locations < 2 THEN 1
                                ELSE least(greatest(ceil(area / 25e0), 1), 30, n_points, n_locations) END AS INTEGER) AS n_clusters
               FROM (SELECT *, abs((lat_hi - lat_lo) * 111e0 * ((lon_hi - lon_lo) * 111e0 * cos(radians(mean_lat)))) AS area FROM g)""",
            L,
            """g AS (SELECT city, count(*) AS n_points, count(DISTINCT (latitude, longitude)) AS n_locations, avg(latitude) AS mean_lat,
                     quantile_cont(latitude, 0.05) AS lat_lo, quantile_cont(latitude, 0.95) AS lat_hi,
                     quantile_cont(longitude, 0.05) AS lon_lo, quantile_cont(longitude, 0.95) AS lon_hi
              FROM listings WHERE city IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY city)""",
        ),
    }


def _label_eval_sql() -> dict[str, str]:
    from tavola.plans.catalog import FIXED_THRESHOLD, MAX_FEATURES, TFIDF_MIN_DF
    from tavola.sources.tables import PRIORITY_LABELS

    L = V.LISTINGS
    n_lab = len(PRIORITY_LABELS)
    lng = """lng AS (SELECT listing_id AS row_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS position, unnest(ls) AS label
                FROM (SELECT listing_id, list_filter(list_transform(string_split(coalesce(cuisines, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS ls FROM listings))"""
    cnt = "cnt AS (SELECT label, count(*) AS n FROM lng GROUP BY label)"
    vocab_vals = ", ".join(f"({i}, {q(x)})" for i, x in enumerate(PRIORITY_LABELS))
    preds = f"""preds AS (SELECT l.listing_id AS row_id, v.label_idx, v.label,
                   CAST(list_contains(list_transform(string_split(coalesce(l.cuisines, ''), ','), lambda x: trim(x)), v.label) AS INTEGER) AS truth,
                   ((l.listing_id * 7919 + v.label_idx * 104729) % 1009) / 1.009e3 AS prob
                 FROM listings l, (VALUES {vocab_vals}) v(label_idx, label))"""
    rowmax = "rm AS (SELECT row_id, max(prob) AS row_max, arg_min(label_idx, struct_pack(neg := -prob, idx := label_idx)) AS best_idx FROM preds GROUP BY row_id)"
    mixed = lambda seed: f"CAST('0x' || substr(md5('{seed}:' || row_id), 1, 15) AS BIGINT)"
    split_expr = f"CASE WHEN {mixed(42)} % 10000 < 1500 THEN 'test' WHEN {mixed(42)} % 10000 < 3000 THEN 'val' ELSE 'train' END"
    thr = f"""th AS (SELECT p.*, CAST(p.prob >= {FIXED_THRESHOLD!r}e0 OR (rm.row_max < {FIXED_THRESHOLD!r}e0 AND p.label_idx = rm.best_idx) AS INTEGER) AS pred,
                     {split_expr.replace('row_id', 'p.row_id')} AS split
              FROM preds p JOIN rm ON p.row_id = rm.row_id)"""

    def metrics(src: str, g: list[str]) -> str:
        gs = "".join(f"{x}, " for x in g)
        gb = ", ".join(g)
        on = " AND ".join(f"a.{x} = b.{x}" for x in g) or "true"
        sel_g = "".join(f"a.{x}, " for x in g)
        return f"""SELECT {sel_g}
              round(b.exact_match, 6) AS exact_match, round(b.hamming_loss, 6) AS hamming_loss,
              round(coalesce(a.TP / nullif(a.TP + a.FP, 0), 0), 6) AS micro_precision,
              round(coalesce(a.TP / nullif(a.TP + a.FN, 0), 0), 6) AS micro_recall,
              round(coalesce(2 * a.TP / nullif(2 * a.TP + a.FP + a.FN, 0), 0), 6) AS micro_f1,
              round(a.macro_precision, 6) AS macro_precision, round(a.macro_recall, 6) AS macro_recall, round(a.macro_f1, 6) AS macro_f1,
              round(a.weighted_f1, 6) AS weighted_f1, round(b.sample_f1, 6) AS sample_f1,
              round(b.avg_true_labels, 6) AS avg_true_labels, round(b.avg_pred_labels, 6) AS avg_pred_labels, b.rows
            FROM (SELECT {gs} CAST(sum(tp) AS DOUBLE) AS TP, CAST(sum(fp) AS DOUBLE) AS FP, CAST(sum(fn) AS DOUBLE) AS FN,
                         sum(coalesce(tp / nullif(tp + fp, 0), 0)) / {n_lab} AS macro_precision,
                         sum(coalesce(tp / nullif(tp + fn, 0), 0)) / {n_lab} AS macro_recall,
                         sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / {n_lab} AS macro_f1,
                         coalesce(sum(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * support) / nullif(sum(support), 0), 0) AS weighted_f1
                  FROM (SELECT {gs} label_idx, CAST(sum(truth * pred) AS DOUBLE) AS tp, CAST(sum((1 - truth) * pred) AS DOUBLE) AS fp,
                               CAST(sum(truth * (1 - pred)) AS DOUBLE) AS fn, CAST(sum(truth) AS DOUBLE) AS support
                        FROM {src} GROUP BY {gs} label_idx) {"GROUP BY " + gb if g else ""}) a
            JOIN (SELECT {gs} avg(CAST(err = 0 AS DOUBLE)) AS exact_match, sum(err) / (count(*) * {float(n_lab)!r}) AS hamming_loss,
                         avg(coalesce(2 * tp / nullif(n_true + n_pred, 0), 0)) AS sample_f1, avg(n_true) AS avg_true_labels,
                         avg(n_pred) AS avg_pred_labels, count(*) AS rows
                  FROM (SELECT {gs} row_id, CAST(sum(truth * pred) AS DOUBLE) AS tp, CAST(sum((1 - truth) * pred + truth * (1 - pred)) AS DOUBLE) AS err,
                               CAST(sum(truth) AS DOUBLE) AS n_true, CAST(sum(pred) AS DOUBLE) AS n_pred
                        FROM {src} GROUP BY {gs} row_id) {"GROUP BY " + gb if g else ""}) b ON {on}"""

    per_label = f"""pl AS (SELECT v.label, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
                        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, CAST(coalesce(support, 0) AS BIGINT) AS support
                 FROM (SELECT label_idx, CAST(sum(truth * pred) AS DOUBLE) AS tp, CAST(sum((1 - truth) * pred) AS DOUBLE) AS fp,
                              CAST(sum(truth * (1 - pred)) AS DOUBLE) AS fn, sum(truth) AS support FROM th GROUP BY label_idx) x
                 RIGHT JOIN (VALUES {vocab_vals}) v(label_idx, label) ON x.label_idx = v.label_idx),
          plr AS (SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, support DESC, label ASC) AS INTEGER) AS rank FROM pl)"""
    sweep_vals = ", ".join(f"({k / 2e1!r}e0)" for k in range(2, 17))
    sweep = f"""sw AS (SELECT p.*, t.threshold, CAST(p.prob >= t.threshold OR (rm.row_max < t.threshold AND p.label_idx = rm.best_idx) AS INTEGER) AS pred
                FROM preds p JOIN rm ON p.row_id = rm.row_id, (VALUES {sweep_vals}) t(threshold))"""
    tf = f"""tk AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS tok FROM documents),
          grams AS (SELECT doc_id, unnest(tok) AS term FROM tk
                    UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) AS term FROM tk),
          tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY doc_id, term)"""
    vocab = f"""voc0 AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term HAVING count(*) >= {TFIDF_MIN_DF}
                        ORDER BY cf DESC, term ASC LIMIT {MAX_FEATURES}),
          voc AS (SELECT term, df, cf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_idx FROM voc0)"""
    tfidf = """idf AS (SELECT term, term_idx, ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + df)) + 1e0 AS idf FROM voc),
          w AS (SELECT doc_id, tf.term, term_idx, tf * idf AS w FROM tf JOIN idf ON tf.term = idf.term),
          nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id)"""
    coefs = """j AS (SELECT p.row_id, p.label, p.truth, l.city, l.locality FROM preds p JOIN listings l ON p.row_id = l.listing_id),
          base AS (SELECT label, avg(truth) AS b FROM j GROUP BY label),
          coefs AS (SELECT g.label, 'cat__city_' || g.city AS feature, g.a - base.b AS coefficient
                    FROM (SELECT label, city, avg(truth) AS a FROM j GROUP BY label, city) g JOIN base ON g.label = base.label
                    UNION ALL
                    SELECT g.label, 'cat__locality_' || g.locality AS feature, g.a - base.b AS coefficient
                    FROM (SELECT label, locality, avg(truth) AS a FROM j GROUP BY label, locality) g JOIN base ON g.label = base.label),
          mac AS (SELECT feature, avg(abs(coefficient)) AS mean_abs_coefficient FROM coefs GROUP BY feature)"""
    fold = f"CAST({mixed('fold42').replace('row_id', 'listing_id')} % 3 AS INTEGER)"
    folds = f"""rec AS (SELECT candidate, {fold} AS fold, sqrt(avg((((listing_id * 7919) % 101 - shift) / 1e2) ^ 2)) AS rmse,
                          avg(abs(((listing_id * 7919) % 101 - shift) / 1e2)) AS mae
                   FROM listings, (VALUES (1, 50), (2, 40), (3, 60)) c(candidate, shift) GROUP BY ALL),
          fs AS (SELECT candidate, round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS std_rmse,
                        round(avg(mae), 6) AS mean_mae, round(stddev_pop(mae), 6) AS std_mae FROM rec GROUP BY candidate)"""
    sample = """ids AS (SELECT DISTINCT row_id FROM th WHERE split = 'test' ORDER BY row_id LIMIT 100)"""
    return {
        "prediction_sample": W(
            f"""SELECT th.row_id,
                       coalesce(string_agg(CASE WHEN truth = 1 THEN v.label END, ', ' ORDER BY CASE WHEN truth = 1 THEN v.label END), '') AS actual,
                       coalesce(string_agg(CASE WHEN pred = 1 THEN v.label END, ', ' ORDER BY CASE WHEN pred = 1 THEN v.label END), '') AS predicted
                FROM th JOIN ids ON th.row_id = ids.row_id JOIN (VALUES {vocab_vals}) v(label_idx, label) ON th.label_idx = v.label_idx
                WHERE th.split = 'test' GROUP BY th.row_id""",
            L, preds, rowmax, thr, sample,
        ),
        "label_split": W("SELECT * FROM lng", L, lng),
        "label_frequency": W(
            f"SELECT label, n AS count, n >= (SELECT ceil(avg(n)) FROM cnt) AS used_in_model, CAST(row_number() OVER (ORDER BY n DESC, label ASC) AS INTEGER) AS rank FROM cnt",
            L, lng, cnt,
        ),
        "rare_labels": W(f"SELECT label, n AS count FROM cnt WHERE n < (SELECT ceil(avg(n)) FROM cnt)", L, lng, cnt),
        "filter_rare_labels": W(f"SELECT lng.label, row_id, position FROM lng JOIN cnt ON lng.label = cnt.label WHERE n >= (SELECT ceil(avg(n)) FROM cnt)", L, lng, cnt),
        "label_vocabulary": W("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT label FROM lng)", L, lng),
        "label_binarize": W(
            "SELECT DISTINCT row_id, label_idx FROM lng JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT label FROM lng)) v ON lng.label = v.label",
            L, lng,
        ),
        "label_cardinality": W(
            f"SELECT round(avg(k), 6) AS label_cardinality, count(*) AS rows FROM (SELECT row_id, count(*) AS k FROM lng JOIN cnt ON lng.label = cnt.label WHERE n >= (SELECT ceil(avg(n)) FROM cnt) GROUP BY row_id)",
            L, lng, cnt,
        ),
        "term_frequencies": W("SELECT * FROM tf", tf),
        "tfidf_vocabulary": W("SELECT * FROM voc", tf, vocab),
        "tfidf_weights": W("SELECT w.doc_id, term, term_idx, round(w / nrm, 6) AS weight FROM w JOIN nrm ON w.doc_id = nrm.doc_id", tf, vocab, tfidf),
        "split_listings": W(f"SELECT listing_id, {split_expr.replace('row_id', 'listing_id')} AS split FROM listings", L),
        "target_statistics": W(
            """SELECT a.city, a.fold, round((t.s - a.s + 2.5) / (t.n - a.n + 1.0), 6) AS city_ts
               FROM (SELECT city, fold, sum(aggregate_rating) AS s, count(aggregate_rating) AS n FROM tr GROUP BY ALL) a
               JOIN (SELECT city, sum(aggregate_rating) AS s, count(aggregate_rating) AS n FROM tr GROUP BY ALL) t ON a.city IS NOT DISTINCT FROM t.city""",
            L,
            f"""tr AS (SELECT city, aggregate_rating, CAST({mixed('fold42').replace('row_id', 'listing_id')} % 3 AS INTEGER) AS fold
                       FROM listings WHERE {split_expr.replace('row_id', 'listing_id')} = 'train')""",
        ),
        "median_std_fit": W(
            " UNION ALL ".join(
                f"SELECT '{n}' AS feature, round(median({c}), 6) AS median, round(coalesce(nullif(stddev_pop({c}), 0), 1), 6) AS std FROM listings"
                for n, c in (("cost", "cost_for_two"), ("votes", "CAST(votes AS DOUBLE)"), ("latitude", "latitude"))
            ),
            L,
        ),
        "one_hot_long": W(
            """SELECT listing_id AS row_id, label_idx FROM listings l
               JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT coalesce(city, 'Unknown') AS label FROM listings)) v
               ON coalesce(l.city, 'Unknown') = v.label""",
            L,
        ),
        "fold_summary": W("SELECT * FROM fs", L, folds),
        "select_best_candidate": W("SELECT * FROM fs ORDER BY mean_rmse, candidate LIMIT 1", L, folds),
        "assembled_features": W(
            """SELECT w.doc_id AS row_id, w.term_idx AS slot, round(w.w / nrm.nrm, 6) AS value FROM w JOIN nrm ON w.doc_id = nrm.doc_id
               UNION ALL SELECT c.doc_id, lv.slot, 1e0 FROM cats c JOIN lv ON lv.col = c.col AND lv.level = c.level
               UNION ALL SELECT doc_id, slots.n, round(coalesce(CAST(n_chars AS DOUBLE), med) / sd, 6) FROM documents, slots, st WHERE coalesce(n_chars, med) <> 0""",
            tf.replace("lower(text)", "lower(coalesce(text, ''))"),
            f"tr AS (SELECT * FROM documents WHERE {split_expr.replace('row_id', 'doc_id')} = 'train')",
            vocab.replace("FROM tf GROUP BY", "FROM tf WHERE doc_id IN (SELECT doc_id FROM tr) GROUP BY"),
            tfidf.replace("FROM documents", "FROM tr"),
            """cats AS (SELECT doc_id, 0 AS col, coalesce(lang, 'Unknown') AS level FROM documents UNION ALL SELECT doc_id, 1, coalesce(source, 'Unknown') FROM documents)""",
            """lv AS (SELECT col, level, CAST(row_number() OVER (ORDER BY col, level) - 1 + (SELECT count(*) FROM voc) AS INTEGER) AS slot
                      FROM (SELECT DISTINCT col, level FROM cats WHERE doc_id IN (SELECT doc_id FROM tr)))""",
            "slots AS (SELECT CAST((SELECT count(*) FROM voc) + (SELECT count(*) FROM lv) AS INTEGER) AS n)",
            "st AS (SELECT median(n_chars) AS med, coalesce(nullif(stddev_pop(n_chars), 0), 1) AS sd FROM tr)",
        ),
        "ordered_target_statistics": W(
            """SELECT listing_id, city, round((coalesce(sum(y) OVER w, 0) + 2.5) / (count(y) OVER w + 1.0), 6) AS city_ts FROM tr
               WINDOW w AS (PARTITION BY city ORDER BY u, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
            L,
            f"""tr AS (SELECT listing_id, city, aggregate_rating AS y, {mixed('order42').replace('row_id', 'listing_id')} AS u
                       FROM listings WHERE {split_expr.replace('row_id', 'listing_id')} = 'train')""",
        ),
        "exact_split_listings": W(
            """SELECT listing_id, CASE WHEN r <= test THEN 'test' WHEN r <= test + ceil((n - test) * 0.15 / 0.85 - 1e-9) THEN 'val' ELSE 'train' END AS split
               FROM (SELECT listing_id, n, r, ceil(0.15 * n - 1e-9) AS test FROM ranked)""",
            L,
            f"ranked AS (SELECT listing_id, row_number() OVER (ORDER BY {mixed('42').replace('row_id', 'listing_id')}) AS r, count(*) OVER () AS n FROM listings)",
        ),
        "fold_listings": W(f"SELECT listing_id, CAST({mixed('fold42').replace('row_id', 'listing_id')} % 3 AS INTEGER) AS fold FROM listings", L),
        "threshold_predict": W("SELECT row_id, label_idx, truth, round(prob, 6) AS prob, pred FROM th", L, preds, rowmax, thr),
        "threshold_sweep": W(
            f"SELECT *, row_number() OVER (ORDER BY micro_f1 DESC, sample_f1 DESC, macro_f1 DESC, threshold ASC) = 1 AS is_best FROM ({metrics('sw', ['threshold'])})",
            L, preds, rowmax, sweep,
        ),
        "multilabel_metrics_by_split": W(metrics("th", ["split"]), L, preds, rowmax, thr),
        "per_label_metrics": W("SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, rank FROM plr", L, preds, rowmax, thr, per_label),
        "extreme_labels": W(
            """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, rank,
                      CASE WHEN rank <= 2 THEN 'highest' ELSE 'lowest' END AS band
               FROM plr WHERE rank <= 2 OR rank > (SELECT max(rank) FROM plr) - 2""",
            L, preds, rowmax, thr, per_label,
        ),
        "regression_metrics_by_split": W(
            """SELECT r.split, round(avg(abs(prediction - aggregate_rating)), 6) AS mae, round(sqrt(avg((prediction - aggregate_rating) ^ 2)), 6) AS rmse,
                      round(1 - sum((prediction - aggregate_rating) ^ 2) / sum((aggregate_rating - m) ^ 2), 6) AS r2,
                      round(avg(CAST(abs(prediction - aggregate_rating) <= 0.25e0 AS DOUBLE)) * 100, 6) AS within_025,
                      round(avg(CAST(abs(prediction - aggregate_rating) <= 0.5e0 AS DOUBLE)) * 100, 6) AS within_050,
                      count(*) AS rows,
                      round(greatest(0e0, (1 - avg(abs(prediction - aggregate_rating)) / 5e0) * 100), 6) AS rating_scale_accuracy
               FROM r JOIN (SELECT split, avg(aggregate_rating) AS m FROM r GROUP BY split) mm ON r.split = mm.split GROUP BY r.split""",
            L,
            f"""r AS (SELECT listing_id, aggregate_rating, aggregate_rating + ((listing_id * 7919) % 101 - 50) / 1e2 AS prediction,
                      {split_expr.replace('row_id', 'listing_id')} AS split FROM listings)""",
        ),
        "mean_abs_coefficient": W("SELECT feature, round(mean_abs_coefficient, 6) AS mean_abs_coefficient FROM mac", L, preds, coefs),
        "top_features_per_label": W(
            """SELECT label, feature, round(coefficient, 6) AS coefficient, rank FROM (
                 SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY coefficient DESC, feature ASC) AS INTEGER) AS rank FROM coefs) WHERE rank <= 15""",
            L, preds, coefs,
        ),
        "clean_feature_names": W(
            """SELECT label, feature, CASE WHEN starts_with(feature, 'name__') THEN 'Restaurant Name: ' || substr(feature, 7)
                                           WHEN starts_with(feature, 'cat__') THEN substr(feature, 6)
                                           WHEN starts_with(feature, 'num__') THEN substr(feature, 6) ELSE feature END AS clean_feature FROM coefs""",
            L, preds, coefs,
        ),
        "importance_to_source": W(
            """SELECT feature, round(sum(mean_abs_coefficient), 6) AS importance FROM (
                 SELECT CASE WHEN starts_with(feature, 'num__') THEN substr(feature, 6)
                             WHEN starts_with(feature, 'cat__') THEN CASE WHEN substr(feature, 6) = 'city' OR starts_with(substr(feature, 6), 'city_') THEN 'city'
                                                                          WHEN substr(feature, 6) = 'locality' OR starts_with(substr(feature, 6), 'locality_') THEN 'locality'
                                                                          ELSE substr(feature, 6) END
                             ELSE feature END AS feature, mean_abs_coefficient FROM mac) GROUP BY feature""",
            L, preds, coefs,
        ),
        "cumulative_importance": W(
            """SELECT feature, round(mean_abs_coefficient, 6) AS importance, CAST(row_number() OVER w AS INTEGER) AS rank,
                      round(sum(mean_abs_coefficient) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative,
                      round(sum(mean_abs_coefficient) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (SELECT sum(mean_abs_coefficient) FROM mac), 6) AS cumulative_share
               FROM mac WINDOW w AS (ORDER BY mean_abs_coefficient DESC, feature ASC)""",
            L, preds, coefs,
        ),
        "top_importance": W("SELECT feature, round(mean_abs_coefficient, 6) AS mean_abs_coefficient FROM mac ORDER BY mean_abs_coefficient DESC, feature ASC LIMIT 5", L, preds, coefs),
    }


def _warehouse_sql() -> dict[str, str]:
    from tavola.plans.catalog import HISTORY_USER, SNAPSHOT_BEFORE, T_EXISTING, T_NOW
    from tavola.plans.requests import REQUESTS
    from tavola.operators.warehouse import PREFERENCE_FIELDS, PREFERENCE_TYPES

    L = V.LISTINGS
    snap = (
        V.LISTINGS.replace("listings AS (", "snap AS (", 1)
        .replace("FROM orders GROUP BY o_custkey", f"FROM orders WHERE o_orderdate < TIMESTAMP '{SNAPSHOT_BEFORE}' GROUP BY o_custkey")
        .replace("  LEFT JOIN (\n    SELECT o_custkey", "  JOIN (\n    SELECT o_custkey")
    )
    assert "JOIN (\n    SELECT o_custkey" in snap and "WHERE o_orderdate" in snap
    fmt = "'%Y-%m-%d %H:%M:%S'"
    imp = [L, V.repaired(), V.prepared(), V.IMPORTED]
    pairs = "pairs AS (SELECT DISTINCT listing_id, unnest(list_filter(list_transform(string_split(coalesce(cuisines, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS cuisine_name FROM imported)"
    dim = "dim AS (SELECT CAST(row_number() OVER (ORDER BY cuisine_name) AS BIGINT) AS cuisine_id, cuisine_name FROM (SELECT DISTINCT cuisine_name FROM pairs))"
    users = f"""ex AS (SELECT CAST(n_nationkey + 1 AS BIGINT) AS user_id, n_name AS name,
                       CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '@example.org' END AS email, TIMESTAMP '{T_EXISTING}' AS created_at FROM nation),
          nw AS (SELECT c_custkey AS seq, c_name AS name, CASE WHEN c_acctbal > 5000 THEN lower(n_name) || '@example.org' END AS email
                 FROM customer JOIN nation ON c_nationkey = n_nationkey),
          ranked AS (SELECT *, CASE WHEN email IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY email ORDER BY seq) END AS k FROM nw),
          fresh AS (SELECT * FROM ranked WHERE k = 1 AND (email IS NULL OR email NOT IN (SELECT email FROM ex WHERE email IS NOT NULL)))"""
    req = """rq AS (SELECT DISTINCT user_id FROM events),
          r AS (SELECT user_id AS request_id,
                  list_filter(list_transform(string_split(['', '1-URGENT', '2-HIGH, 5-LOW', '3-medium', '4-NOT SPECIFIED, 1-URGENT, 1-URGENT', '5-LOW'][user_id % 6 + 1], ','), lambda x: trim(x)), lambda x: x <> '') AS cuisines,
                  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'nation_' || CAST(user_id % 25 AS VARCHAR) END AS city,
                  CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(1 + user_id % 4 AS INTEGER) END AS price_range,
                  CASE WHEN user_id % 5 = 0 THEN NULL ELSE (20 + user_id % 25) / 1e1 END AS min_rating,
                  CASE WHEN user_id % 2 = 0 THEN NULL ELSE CAST(300 + 100 * (user_id % 17) AS DOUBLE) END AS max_cost
                FROM rq)"""
    prefs = REQUESTS["canned_delivery"]
    sql_type = {"array<string>": "VARCHAR[]", "string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}

    def val(k):
        v = prefs.get(k)
        t = sql_type[PREFERENCE_TYPES[k]]
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, list):
            return "[" + ", ".join(q(x) for x in v) + "]"
        if isinstance(v, str):
            return q(v)
        return f"CAST({v!r} AS {t})"

    js = "to_json(struct_pack(" + ", ".join(f"{k} := {val(k)}" for k in PREFERENCE_FIELDS) + "))"
    cz = [c.lower() for c in prefs.get("cuisines", [])]
    hit = " OR ".join(f"contains(lower(coalesce(cuisines, '')), {q(c)})" for c in cz)
    return {
        "upsert_listings": W(
            f"""SELECT coalesce(e.listing_id, i.listing_id) AS listing_id,
                       CASE WHEN i.listing_id IS NOT NULL THEN i.votes ELSE e.votes END AS votes,
                       round(CASE WHEN i.listing_id IS NOT NULL THEN i.aggregate_rating ELSE e.aggregate_rating END, 6) AS aggregate_rating,
                       CASE WHEN i.listing_id IS NOT NULL THEN i.has_table_booking ELSE e.has_table_booking END AS has_table_booking,
                       strftime(CASE WHEN e.listing_id IS NULL THEN TIMESTAMP '{T_NOW}' ELSE TIMESTAMP '{T_EXISTING}' END, {fmt}) AS created_at,
                       strftime(CASE WHEN i.listing_id IS NOT NULL THEN TIMESTAMP '{T_NOW}' ELSE TIMESTAMP '{T_EXISTING}' END, {fmt}) AS updated_at
                FROM snap e FULL OUTER JOIN listings i ON e.listing_id = i.listing_id""",
            L, snap,
        ),
        "recommend_all_requests": W(
            """SELECT request_id, rank, listing_id, round(score, 4) AS score FROM ranked WHERE rank <= 10""",
            *imp,
            """wishes AS (
                 SELECT user_id AS request_id,
                   list_transform(list_filter(list_transform(string_split([ '', '1-URGENT', '2-HIGH, 5-LOW', '3-medium', '4-NOT SPECIFIED, 1-URGENT, 1-URGENT', '5-LOW'][user_id % 6 + 1], ','),
                     lambda x: trim(x)), lambda x: x <> ''), lambda x: lower(x)) AS cz,
                   CASE WHEN user_id % 3 <> 0 THEN 'nation_' || (user_id % 25) END AS city, CASE WHEN user_id % 4 <> 0 THEN 1 + user_id % 4 END AS pr,
                   CASE WHEN user_id % 5 <> 0 THEN (20 + user_id % 25) / 1e1 END AS mr, CASE WHEN user_id % 2 <> 0 THEN CAST(300 + 100 * (user_id % 17) AS DOUBLE) END AS mc
                 FROM (SELECT DISTINCT user_id FROM events))""",
            """pairs_of AS (
                 SELECT w.*, l.*, max(coalesce(log_votes, 0e0)) OVER (PARTITION BY request_id) AS lvm, max(coalesce(restaurant_popularity_score, 0e0)) OVER (PARTITION BY request_id) AS psm
                 FROM (SELECT request_id, cz, city AS wanted_city, pr, mr, mc FROM wishes) w JOIN imported l ON mr IS NULL OR coalesce(aggregate_rating, 0e0) >= mr)""",
            """scored AS (
                 SELECT request_id, listing_id, aggregate_rating, votes, 0e0
                   + CASE WHEN len(cz) > 0 THEN (len(list_intersect(list_distinct(list_filter(list_transform(string_split(lower(coalesce(cuisines, '')), ','), lambda x: trim(x)), lambda x: x <> '')),
                       list_distinct(cz))) / CAST(len(cz) AS DOUBLE)) * 40e0 ELSE 0e0 END
                   + CASE WHEN lower(coalesce(city, '')) = wanted_city THEN 20e0 ELSE 0e0 END
                   + CASE WHEN pr IS NULL THEN 0e0 ELSE (1 - least(greatest(abs(coalesce(price_range, pr) - pr) / 3e0, 0e0), 1e0)) * 12e0 END
                   + (least(greatest(coalesce(aggregate_rating, 0e0), 0e0), 5e0) / 5e0) * 12e0
                   + CASE WHEN mc IS NULL THEN 0e0 ELSE (1 - least(greatest(greatest(coalesce(average_cost_inr, mc) - mc, 0e0) / greatest(mc, 1e0), 0e0), 1e0)) * 8e0 END
                   + CASE WHEN lvm > 0 THEN coalesce(log_votes, 0e0) / lvm * 6e0 ELSE 0e0 END
                   + CASE WHEN psm > 0 THEN coalesce(restaurant_popularity_score, 0e0) / psm * 6e0 ELSE 0e0 END
                   + (1 - least(greatest(abs(coalesce(cost_relative_to_city, 1e0) - 1), 0e0), 1e0)) * 2e0 AS score
                 FROM pairs_of)""",
            "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, aggregate_rating DESC, votes DESC, listing_id) AS INTEGER) AS rank FROM scored)",
        ),
        "merge_store": W(
            f"""SELECT l.listing_id, l.votes, round(l.aggregate_rating, 6) AS aggregate_rating, l.has_table_booking,
                       strftime(CASE WHEN e.listing_id IS NULL THEN TIMESTAMP '{T_NOW}' ELSE TIMESTAMP '{T_EXISTING}' END, {fmt}) AS created_at,
                       strftime(CASE WHEN e.listing_id IS NULL OR (l.listing_name, l.city, l.votes, l.aggregate_rating, l.has_table_booking, l.cuisines)
                                       IS DISTINCT FROM (e.listing_name, e.city, e.votes, e.aggregate_rating, e.has_table_booking, e.cuisines)
                                THEN TIMESTAMP '{T_NOW}' ELSE TIMESTAMP '{T_EXISTING}' END, {fmt}) AS updated_at
                FROM listings l LEFT JOIN snap e ON e.listing_id = l.listing_id""",
            L, snap,
        ),
        "csv_roundtrip_documents": "SELECT doc_id, nullif(text, '') AS text, nullif(lang, '') AS lang, nullif(source, '') AS source, n_chars FROM documents",
        "cuisine_dimension": W("SELECT * FROM dim", *imp, pairs, dim),
        "type_dimension_upsert": """WITH e AS (SELECT CAST(row_number() OVER (ORDER BY type_name) AS BIGINT) AS type_id, type_name
                                         FROM (SELECT DISTINCT p_type AS type_name FROM part WHERE p_type IS NOT NULL)),
                                    n AS (SELECT concat_ws(' ', p_type, p_brand) AS type_name FROM part UNION SELECT p_type FROM part)
                                    SELECT * FROM e UNION ALL
                                    SELECT CAST((SELECT coalesce(max(type_id), 0) FROM e) + row_number() OVER (ORDER BY type_name) AS BIGINT) AS type_id, type_name
                                    FROM n WHERE type_name IS NOT NULL AND type_name NOT IN (SELECT type_name FROM e)""",
        "upsert_repeated_ids": W(
            f"""SELECT listing_id, votes + 2 * (1 + listing_id % 3) AS votes, round(aggregate_rating, 6) AS aggregate_rating,
                       strftime(CASE WHEN listing_id % 2 = 0 THEN TIMESTAMP '{T_EXISTING}' ELSE TIMESTAMP '{T_NOW}' END, {fmt}) AS created_at,
                       strftime(TIMESTAMP '{T_NOW}', {fmt}) AS updated_at FROM listings""",
            L,
        ),
        "cuisine_bridge_replace": W(
            """SELECT DISTINCT listing_id, cuisine_id FROM pairs JOIN dim ON pairs.cuisine_name = dim.cuisine_name
                 WHERE listing_id NOT IN (SELECT listing_id FROM imported WHERE price_range >= 3)
               UNION SELECT listing_id, cuisine_id FROM imported, dim WHERE price_range >= 3 AND cuisine_name IN ('5-LOW', '2-HIGH')""",
            *imp, pairs, dim,
        ),
        "cuisine_bridge_accumulate": W(
            """SELECT DISTINCT listing_id, cuisine_id FROM pairs JOIN dim ON pairs.cuisine_name = dim.cuisine_name
               UNION SELECT listing_id, cuisine_id FROM imported, dim WHERE price_range >= 3 AND cuisine_name IN ('5-LOW', '2-HIGH')""",
            *imp, pairs, dim,
        ),
        "cuisine_bridge": W("SELECT DISTINCT listing_id, cuisine_id FROM pairs JOIN dim ON pairs.cuisine_name = dim.cuisine_name", *imp, pairs, dim),
        "import_summary": W("SELECT count(*) AS restaurants, (SELECT count(DISTINCT cuisine_name) FROM pairs) AS cuisines FROM imported", *imp, pairs),
        "load_listing_frame": W(
            """SELECT i.listing_id, i.listing_name, g.cuisines FROM imported i LEFT JOIN (
                 SELECT listing_id, string_agg(cuisine_name, ', ' ORDER BY cuisine_name) AS cuisines
                 FROM (SELECT DISTINCT listing_id, cuisine_id FROM pairs JOIN dim ON pairs.cuisine_name = dim.cuisine_name) b
                 JOIN dim ON b.cuisine_id = dim.cuisine_id GROUP BY listing_id) g ON i.listing_id = g.listing_id""",
            *imp, pairs, dim,
        ),
        "append_users": W(
            f"""SELECT user_id, name, email, strftime(created_at, {fmt}) AS created_at FROM ex
                UNION ALL
                SELECT CAST((SELECT max(user_id) FROM ex) + row_number() OVER (ORDER BY seq) AS BIGINT), name, email, strftime(TIMESTAMP '{T_NOW}', {fmt}) FROM fresh""",
            users,
        ),
        "append_users_rejected": W("SELECT seq, name, email FROM ranked WHERE seq NOT IN (SELECT seq FROM fresh)", users),
        "preferences_log": W(
            f"""SELECT request_id AS user_id, array_to_string(cuisines, ', ') AS preferred_cuisines, city AS preferred_city,
                       CAST(NULL AS VARCHAR) AS preferred_locality, price_range AS preferred_price_range, round(max_cost, 6) AS max_average_cost_inr,
                       round(min_rating, 6) AS min_rating, CAST(NULL AS VARCHAR) AS preferred_cost_category, CAST(NULL AS VARCHAR) AS preferred_rating_category,
                       CAST(NULL AS VARCHAR) AS preferred_popularity_category, CAST(NULL AS INTEGER) AS wants_expensive,
                       CAST(NULL AS INTEGER) AS preferred_location_cluster, CAST(NULL AS VARCHAR) AS preferred_city_location_cluster,
                       CAST(NULL AS VARCHAR) AS wants_online_delivery, CAST(NULL AS VARCHAR) AS wants_table_booking,
                       CAST(NULL AS VARCHAR) AS wants_delivering_now, strftime(TIMESTAMP '{T_NOW}', {fmt}) AS created_at FROM r""",
            req,
        ),
        "history_log": f"""SELECT CAST({HISTORY_USER} AS BIGINT) AS user_id, {js} AS preferences_json, listing_id, score AS recommendation_score, rank,
                                  strftime(TIMESTAMP '{T_NOW}', {fmt}) AS created_at FROM ({recommend_sql(prefs, 10)})""",
        "evaluate_recommendations": f"""SELECT round(avg(CAST({hit} AS DOUBLE)) * 100, 6) AS cuisine_match_rate,
                                               round(avg(CAST(lower(coalesce(city, '')) = {q(prefs['city'].lower())} AS DOUBLE)) * 100, 6) AS city_match_rate,
                                               round(avg(aggregate_rating), 6) AS average_rating, round(avg(score), 6) AS average_score, count(*) AS n
                                        FROM ({recommend_sql(prefs, 10, round_score=False)})""",
    }
