"""Boundary values of the derived categories and text rules."""

from pyspark.sql import functions as F

from tavola.functions import bins, text
from tavola.functions.repairs import REPAIRS_1, REPAIRS_2, REPAIRS_TURKISH
from tavola.operators import features


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_cost_bins_right_closed(spark):
    vals = [(300.0,), (300.01,), (700.0,), (1500.0,), (1500.01,), (-1.0,), (None,)]
    got = _one(spark, vals, "x double", bins.cost_category(F.col("x")))
    assert got == ["Budget", "Medium", "Medium", "Premium", "Luxury", None, None]


def test_rating_bins(spark):
    vals = [(0.0,), (0.1,), (2.5,), (3.5,), (4.0,), (5.0,)]
    got = _one(spark, vals, "x double", bins.rating_category(F.col("x")))
    assert got == ["Not Rated", "Poor", "Poor", "Average", "Good", "Excellent"]


def test_popularity_bins(spark):
    vals = [(0,), (50,), (51,), (200,), (1000,), (1001,)]
    got = _one(spark, vals, "x long", bins.popularity_category(F.col("x")))
    assert got == ["Low", "Low", "Medium", "Medium", "High", "Very High"]


def test_quartiles_small_cities(spark):
    rows = [(i, "A", float(c)) for i, c in enumerate([10, 20, 30, 40, 50, 60])] + [(10 + i, "B", float(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "listing_id long, city string, average_cost_inr double")
    out = {r.listing_id: r.city_wise_cost_category for r in features.city_cost_quartile(df).collect()}
    assert [out[i] for i in range(6)] == ["Budget", "Budget", "Medium", "Premium", "Luxury", "Luxury"]
    assert [out[10 + i] for i in range(3)] == ["Medium"] * 3


def test_quartile_ties_by_id(spark):
    rows = [(5, "A", 1.0), (1, "A", 1.0), (3, "A", 1.0), (2, "A", 1.0), (9, "A", None)]
    df = spark.createDataFrame(rows, "listing_id long, city string, average_cost_inr double")
    out = {r.listing_id: r.city_wise_cost_category for r in features.city_cost_quartile(df).collect()}
    assert out == {1: "Budget", 2: "Medium", 3: "Premium", 5: "Luxury", 9: None}


def test_cuisine_count_and_label_split(spark):
    df = spark.createDataFrame([("Unknown",), ("A, B",), ("A,,B",)], "c string")
    assert [r[0] for r in df.select(features.cuisine_count(F.col("c"))).collect()] == [0, 2, 3]
    assert [r[0] for r in df.select(F.size(text.split_list(F.col("c")))).collect()] == [1, 2, 2]


def test_yes_no(spark):
    got = _one(spark, [(" yes ",), ("YES",), ("no",), (None,), ("1",)], "x string", text.yes_no(F.col("x")))
    assert got == ["Yes", "Yes", "No", "No", "No"]


def test_replacement_order_is_sequential(spark):
    got = _one(spark, [("abc",)], "x string", text.replace_literals(F.col("x"), [("ab", "x"), ("xc", "y")]))
    assert got == ["y"]


def test_reference_dictionaries(spark):
    from tavola.plans.prepare import repair_text

    rows = [("Bras�_lia", "Emirg��n", "Caf�� x_y�"), (None, "plain", "Kad۱k�_y")]
    df = spark.createDataFrame(rows, "city string, locality string, listing_name string")
    out = repair_text(df).collect()
    assert out[0].city == "Brasilia"
    # The second dictionary already maps this key, before the Turkish map sees it.
    assert out[0].locality == "Emirgun"
    assert out[0].listing_name == "Cafe xy"
    assert out[1].city is None and out[1].locality == "plain"
    assert out[1].listing_name == "Kadky"  # the name strip runs before the Turkish map
    assert len(REPAIRS_1) == 17 and len(REPAIRS_2) == 43 and len(REPAIRS_TURKISH) == 10


def test_tokens_and_bigrams(spark):
    from tavola.operators import text as tt

    df = spark.createDataFrame([(1, "Café au lait, x CAFÉ!"), (2, "a")], "doc_id long, text string")
    tf = {(r.doc_id, r.term): r.tf for r in tt.term_frequencies(df, "doc_id", "text", 2).collect()}
    assert tf == {(1, "cafe"): 2, (1, "au"): 1, (1, "lait"): 1, (1, "cafe au"): 1, (1, "au lait"): 1, (1, "lait cafe"): 1}
