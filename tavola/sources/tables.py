"""Driver tables and the listing / request / prediction views built on them.

The reference works on one wide listings table; the test tables are a
TPC-H-like star schema, so the listing-shaped view is derived from them with
joins and one aggregate over ``orders`` (FIXTURES.md part 2 A, C, D).  All
views are lazy DataFrames: Catalyst prunes the columns each query needs and
pushes filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Currency name per region key 0..4 of the listing view.
REGION_CURRENCY = ["Rand(R)", "Dollar($)", "Indian Rupees(Rs.)", "Pounds", "Emirati Diram(AED)"]

# The five label names (order priorities) and their index.
PRIORITY_LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def order_stats(orders: DataFrame) -> DataFrame:
    """One row per customer: order counts, votes, status counts, priority list.

    A plain grouped aggregate: partial aggregation runs map-side, so a customer
    holding a large share of the orders is combined per task before the
    shuffle; ``collect_set`` holds at most the five distinct priorities.
    """
    st = F.col("o_orderstatus")
    return orders.groupBy(F.col("o_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.floor(F.col("o_totalprice") / F.lit(1e4))).cast("bigint").alias("order_votes"),
        F.count_if(st == "F").alias("n_f"),
        F.count_if(st == "O").alias("n_o"),
        F.count_if(st == "P").alias("n_p"),
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("prio"),
    )


def listings_raw(spark: SparkSession, sf_dir: str, orders_before: str | None = None) -> DataFrame:
    """Raw listing table (one row per customer), FIXTURES.md part 2 A.

    ``orders_before`` builds an earlier snapshot: only orders placed before
    that date count, and only customers with such an order are listed.
    """
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    orders = table(spark, sf_dir, "orders")
    if orders_before is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(orders_before).cast("timestamp_ntz"))
    o = order_stats(orders.select("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"))
    if orders_before is not None:
        c = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")

    key = F.col("c_custkey")
    votes = F.coalesce(F.col("order_votes"), F.lit(0)).cast("bigint")
    currency = F.element_at(F.array(*[F.lit(x) for x in REGION_CURRENCY]), F.col("n_regionkey") + 1)
    rating = F.when(F.col("n_orders").isNull() | (key % 11 == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(49), F.lit(10) + F.floor(F.lit(5.5e1) * votes / (F.col("n_orders") * F.lit(5e1)))) / F.lit(1e1)
    )
    # nation has one row per city and is broadcast; part and the order
    # aggregate join on the customer key (sort-merge or broadcast by AQE).
    return (
        c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .join(p, key == p.p_partkey, "left")
        .join(o, key == o.o_custkey, "left")
        .select(
            key.alias("listing_id"),
            F.concat(F.col("p_name"), F.lit(" "), F.lower(F.col("p_type"))).alias("listing_name"),
            F.col("n_regionkey").cast("int").alias("country_code"),
            F.col("n_name").alias("city"),
            F.col("c_name").alias("address"),
            F.col("c_mktsegment").alias("locality"),
            (F.col("n_regionkey") * 10 + F.lit(2e-1) * ((key * 104729) % 10007) / F.lit(1.0007e4)).alias("longitude"),
            (F.col("n_nationkey") + F.lit(2e-1) * ((key * 7919) % 10007) / F.lit(1.0007e4)).alias("latitude"),
            F.when(key % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("prio")).alias("cuisines"),
            F.when(F.col("c_acctbal") <= 0, F.lit(0.0))
            .otherwise(F.floor(F.col("c_acctbal") / F.lit(5)).cast("double"))
            .alias("cost_for_two"),
            currency.alias("currency"),
            (F.lit(1) + key % 4).cast("int").alias("price_range"),
            rating.cast("double").alias("aggregate_rating"),
            votes.alias("votes"),
            _yes_no(F.col("n_p") >= 4).alias("has_table_booking"),
            _yes_no(F.col("n_f") > F.col("n_o")).alias("has_online_delivery"),
            _yes_no(key % 5 == 0).alias("is_delivering_now"),
        )
    )


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference request per distinct ``events.user_id`` (FIXTURES.md C)."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    uid = F.col("user_id")
    cuisines_by_mod = F.element_at(
        F.array(
            F.lit(""),
            F.lit("1-URGENT"),
            F.lit("2-HIGH, 5-LOW"),
            F.lit("3-medium"),
            F.lit("4-NOT SPECIFIED, 1-URGENT, 1-URGENT"),
            F.lit("5-LOW"),
        ),
        (uid % 6 + 1).cast("int"),
    )
    return u.select(
        uid.alias("request_id"),
        cuisines_by_mod.alias("cuisines"),
        F.when(uid % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("nation_"), (uid % 25).cast("string"))).alias("city"),
        F.when(uid % 4 == 0, F.lit(None).cast("int")).otherwise((F.lit(1) + uid % 4).cast("int")).alias("price_range"),
        F.when(uid % 5 == 0, F.lit(None).cast("double")).otherwise(((F.lit(20) + uid % 25) / F.lit(1e1)).cast("double")).alias("min_rating"),
        F.when(uid % 2 == 0, F.lit(None).cast("double")).otherwise((F.lit(300) + F.lit(100) * (uid % 17)).cast("double")).alias("max_cost"),
    )


def label_vocabulary(spark: SparkSession) -> DataFrame:
    """The five order priorities as a (label_idx, label) table (tiny, fixed)."""
    return spark.createDataFrame(list(enumerate(PRIORITY_LABELS)), "label_idx int, label string")


def predictions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing x label truth and pseudo-probability table (FIXTURES.md D).

    Each listing row is expanded with ``posexplode`` over the fixed
    five-label array (no join), so the output is exactly five rows per
    listing and stays linear in the listings.
    """
    lst = listings_raw(spark, sf_dir).select("listing_id", "cuisines")
    labels_of_row = F.transform(F.split(F.coalesce(F.col("cuisines"), F.lit("")), ","), lambda x: F.trim(x))
    voc = F.array(*[F.lit(x) for x in PRIORITY_LABELS])
    return lst.select("listing_id", labels_of_row.alias("labels"), F.posexplode(voc).alias("label_idx", "label")).select(
        F.col("listing_id").alias("row_id"),
        F.col("label_idx").cast("int").alias("label_idx"),
        F.col("label"),
        F.array_contains(F.col("labels"), F.col("label")).cast("int").alias("truth"),
        (((F.col("listing_id") * 7919 + F.col("label_idx") * 104729) % 1009) / F.lit(1.009e3)).alias("prob"),
    )
