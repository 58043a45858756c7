"""Prefix sums, selection by rank and what is built on them."""

import random

from pyspark.sql import functions as F

from tavola.functions import stats
from tavola.operators import mlfeatures, split


def test_prefix_sums_against_python(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([1.0, 2.5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    for group in (["g"], []):
        got = {r.id: (r.s, r.n) for r in stats.prefix_sums(df, group, [F.col("id").desc()], {"s": "x", "n": F.lit(1)}).collect()}
        sums = {}
        for i, g, x in sorted(rows, reverse=True):
            key = g if group else 0
            s, n = sums.get(key, (0, 0))
            sums[key] = (s + (x or 0), n + 1)
            assert got[i] == sums[key]
    assert stats.prefix_sums(df.limit(0), ["g"], ["id"], {"s": "x"}).collect() == []


def test_a_hot_group_is_spread(spark):
    """A level with a third of the rows lies in many partitions and is right all the same."""
    df = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"))
    dealt = df.repartitionByRange(8, "g", "id").withColumn("p", F.spark_partition_id()).filter("g = 'hot'")
    assert dealt.select("p").distinct().count() >= 3
    top = stats.prefix_sums(df, ["g"], ["id"], {"n": F.lit(1)}).filter("g = 'hot'").agg(F.max("n"), F.count_distinct("n")).first()
    assert top[0] == top[1] == 66_667


def test_smallest_against_a_sort(spark):
    rnd = random.Random(2)
    values = [rnd.randrange(1 << 60) for _ in range(500)] + [0, (1 << 60) - 1] + [7] * 20
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    ranks = [1, 2, 15, 21, 22, 300, 522, 523, 0]
    want = [sorted(values)[k - 1] if 0 < k <= len(values) else None for k in ranks]
    assert stats.smallest(df, F.col("v"), ranks) == want
    assert stats.smallest(df.limit(0), F.col("v"), [1]) == [None]


def test_exact_split_sizes(spark):
    for n, sizes in ((9551, (6685, 1433, 1433)), (1, (0, 0, 1)), (7, (4, 1, 2)), (0, (0, 0, 0))):
        got = {r.split: r["count"] for r in split.exact_split(spark.range(n), "id").groupBy("split").count().collect()}
        assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == sizes
    ids = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "id long")
    by = {}
    for r in split.exact_split(ids, "id").collect():
        by.setdefault(r.id, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())


def test_ordered_statistics_never_see_the_own_target(spark):
    rows = [(i, "a" if i % 2 else "b", float(i)) for i in range(40)] + [(100, "alone", 9.0), (101, "a", None)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    got = {r.id: r.c_ts for r in mlfeatures.ordered_target_statistics(df, "id", "c", "y", 3.0).collect()}
    assert got[100] == 3.0
    key = {r.id: r.u for r in df.select("id", split.mixed_hash(F.col("id"), "order42").alias("u")).collect()}
    for i, c, _ in rows:
        before = [y for j, d, y in rows if d == c and (key[j], j) < (key[i], i) and y is not None]
        assert abs(got[i] - (sum(before) + 3.0) / (len(before) + 1)) < 1e-9
