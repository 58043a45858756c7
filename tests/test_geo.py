"""k-means properties: nearest-centre assignment, inertia never rises, k within bounds."""

import pytest
from pyspark.sql import functions as F

from tavola.operators import geo
from tavola.sources.tables import listings_raw

from conftest import SF_SMALL


def test_cluster_counts_bounds(spark):
    c = geo.cluster_counts(listings_raw(spark, SF_SMALL)).collect()
    for r in c:
        assert 1 <= r.n_clusters <= min(30, r.n_points, r.n_locations) or (r.n_clusters == 1)


def test_kmeans_properties(spark):
    raw = listings_raw(spark, SF_SMALL).select("listing_id", "city", "latitude", "longitude")
    raw = raw.unionByName(spark.createDataFrame([(-1, None, 1.0, 1.0), (-2, "NATION_1", None, 2.0)], raw.schema))
    hist = []
    out = geo.kmeans_by_city(raw, history=hist)
    assert all(b <= a + 1e-9 for a, b in zip(hist, hist[1:])), hist
    rows = {r.listing_id: r.location_cluster for r in out.collect()}
    assert rows[-1] == 0 and rows[-2] == 0
    counts = {r.city: r.n_clusters for r in geo.cluster_counts(raw).collect()}
    per_city = out.filter(F.col("city").isNotNull() & F.col("latitude").isNotNull()).groupBy("city").agg(F.max("location_cluster").alias("m")).collect()
    for r in per_city:
        assert r.m < counts[r.city]
    # every point is nearer (or equal) to its own cluster mean than to any other mean of its city
    pts = out.filter(F.col("city").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cen = pts.groupBy("city", "location_cluster").agg(F.avg("latitude").alias("clat"), F.avg("longitude").alias("clon"))
    j = pts.join(cen.withColumnRenamed("location_cluster", "other"), "city")
    d = (F.col("latitude") - F.col("clat")) ** 2 + (F.col("longitude") - F.col("clon")) ** 2
    best = j.groupBy("listing_id").agg(F.min(d).alias("best"), F.min(F.when(F.col("other") == F.col("location_cluster"), d)).alias("own"))
    assert best.filter(F.col("own") > F.col("best") + 1e-9).count() == 0


def test_step_aggregates_numbers_over_blocks(spark):
    """A round sorts no rows with centres in them, and agrees with a plain recomputation over many blocks of a city."""
    rows = [("A", float(i % 71), float(i % 89) / 2, float(1 + i % 3)) for i in range(5000)] + [("B", 0.0, 0.0, 1.0), ("B", 1.0, 1.0, 1.0)]
    places = spark.createDataFrame(rows, "city string, latitude double, longitude double, weight double")
    centres = {("A", 0): [(0, 3.0, 3.0), (1, 60.0, 40.0), (2, 900.0, 900.0)], ("A", 1): [(0, 30.0, 30.0)], ("B", 0): [(0, 0.0, 0.0), (1, 1.0, 1.0)]}
    states = spark.createDataFrame([(c, s, x) for (c, s), x in centres.items()], "city string, start int, centres array<struct<cluster: int, c_lat: double, c_lon: double>>")
    dealt = geo.blocks(places)
    assert dealt.filter("city = 'A'").count() > 1
    step = geo.cluster_step(dealt, states)
    assert "SortAggregate" not in step._jdf.queryExecution().executedPlan().toString()
    got = {(r.city, r.start): ([tuple(c) for c in r.centres], r.shift) for r in step.collect()}
    assert got.keys() == centres.keys()
    for (city, start), own in centres.items():
        sums = {k: [0.0, 0.0, 0.0] for k, _, _ in own}
        for c, lat, lon, w in rows:
            if c == city:
                near = min(own, key=lambda x: ((lat - x[1]) ** 2 + (lon - x[2]) ** 2, x[0]))[0]
                sums[near] = [a + b for a, b in zip(sums[near], (w, w * lat, w * lon))]
        want = [(k, sums[k][1] / sums[k][0], sums[k][2] / sums[k][0]) if sums[k][0] else (k, lat, lon) for k, lat, lon in own]
        assert [[round(x, 9) for x in c] for c in got[city, start][0]] == [[round(x, 9) for x in c] for c in want]
        assert abs(got[city, start][1] - sum((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 for a, b in zip(own, want))) < 1e-6


def test_rounds_in_one_task_equal_rounds_over_blocks(spark, monkeypatch):
    """Cities up to the bound end in one task; the clusters are those of the rounds over blocks, mixed bounds included."""
    rows = [(i, c, x * float((i * 7919) % 1009) / 10000, x * float((i * 104729) % 997) / 10000) for x, c in ((1.0, "A"), (0.7, "B")) for i in range(300 if c == "A" else 60)]
    rows += [(0, "C", 1.0, 1.0), (1, "C", 1.0, 1.0), (2, None, 1.0, 1.0), (3, "B", None, 1.0)]
    df = spark.createDataFrame(rows, "listing_id long, city string, latitude double, longitude double")
    monkeypatch.setattr(geo, "BLOCK", 64)
    labels = lambda at_once: sorted(geo.kmeans_by_city(df, tol=1e-2, at_once=at_once).collect(), key=str)
    want = labels(0)
    calls, step = [], geo.cluster_step
    monkeypatch.setattr(geo, "cluster_step", lambda *a: calls.append(1) or step(*a))
    assert labels(100) == want and calls
    calls.clear()
    assert labels(geo.AT_ONCE) == want and not calls


def test_unfinished_rounds_are_an_error(spark):
    rows = [(i, "A", float((i * 7919) % 1009) / 1000, float((i * 104729) % 997) / 1000) for i in range(500)]
    df = spark.createDataFrame(rows, "listing_id long, city string, latitude double, longitude double")
    for at_once in (0, geo.AT_ONCE):
        with pytest.raises(RuntimeError, match="not converged"):
            geo.kmeans_by_city(df, max_iter=1, tol=0.0, at_once=at_once).count()
