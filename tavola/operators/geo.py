"""Per-city location clustering.

D13 sizes the number of clusters of each city from the area of its 5-95 %
coordinate box; D14 runs Lloyd's k-means for every city and several starts at
once.  Points are the distinct locations with their number of rows, dealt into
blocks of some thousand places of one city.  The state is one row per (city,
start) with at most 30 centres; each round every block meets its city's states,
its places pick their nearest centres (NumPy, a block at a time), and the sums
per centre, a few rows a block, are grouped to the new centres.  A city holding
a third of the rows is many blocks.  A city of at most ``AT_ONCE`` places takes
the same rounds inside one task per start, without a job for each of them.
Starts are seeded without random state: along a snake path through latitude
bands, through longitude bands, and in a scattered order.  Of a city's starts
the one of least inertia is kept; its clusters are numbered by centre position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.stats import exact_percentiles_many, group_rank, join_group_stats
from tavola.session import materialize_table

# Sizing rule of the clusters.
TARGET_AREA_KM2 = 25.0
MAX_CLUSTERS = 30
KM_PER_DEGREE = 111.0
# Rounds between two tests of convergence.
UNROLL = 3
# Places of a block on average.
BLOCK = 2048
# Most places of a city whose rounds run inside one task per start (1.5 MB of coordinates and weights).
AT_ONCE = 1 << 16
# Starts per city, of which the one of least inertia is kept.
STARTS = 3


def _valid_points(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col, "city", "latitude", "longitude").filter(
        F.col("city").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )


def cluster_counts(df: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """One row per city with ``n_clusters`` (and the inputs of the rule)."""
    pts = _valid_points(df, id_col)
    base = pts.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_distinct("latitude", "longitude").alias("n_locations"),
        F.avg("latitude").alias("mean_lat"),
        ((F.var_pop("latitude") + F.var_pop("longitude")) / 2).alias("mean_var"),
        F.min("latitude").alias("min_lat"),
        F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"),
        F.max("longitude").alias("max_lon"),
    )
    # Both coordinates' 5 % / 95 % points from one distributed sort.
    q = exact_percentiles_many(pts, ["city"], ["latitude", "longitude"], [0.05, 0.95], tiebreak=id_col, names=["lo", "hi"])
    q = q.select(
        "city",
        F.col("latitude_lo").alias("lat_lo"), F.col("latitude_hi").alias("lat_hi"),
        F.col("longitude_lo").alias("lon_lo"), F.col("longitude_hi").alias("lon_hi"),
    )
    out = join_group_stats(base, q, ["city"])
    height = (F.col("lat_hi") - F.col("lat_lo")) * F.lit(KM_PER_DEGREE)
    width = (F.col("lon_hi") - F.col("lon_lo")) * F.lit(KM_PER_DEGREE) * F.cos(F.radians(F.col("mean_lat")))
    area = F.abs(height * width)
    k = F.ceil(area / F.lit(TARGET_AREA_KM2))
    bounded = F.least(F.greatest(k, F.lit(1)), F.lit(MAX_CLUSTERS), F.col("n_points"), F.col("n_locations"))
    return out.withColumn("area_km2", area).withColumn(
        "n_clusters",
        F.when((F.col("n_points") < 2) | (F.col("n_locations") < 2), F.lit(1)).otherwise(bounded).cast("int"),
    )


def locations(df: DataFrame, id_col: str = "listing_id") -> DataFrame:
    """(city, latitude, longitude, weight): distinct places and their number of rows."""
    return _valid_points(df, id_col).groupBy("city", "latitude", "longitude").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def cluster_seeds(places: DataFrame, counts: DataFrame, starts: int = STARTS) -> DataFrame:
    """(city, start, cluster, c_lat, c_lon): k places per city and start, evenly spaced in the start's order.

    Start 0 cuts the city into ``ceil(sqrt(k))`` latitude bands and walks them
    alternately east and west, start 1 does so with longitude bands, and every
    further start takes the places in another scattered order.
    """
    locs = join_group_stats(places.select("city", "latitude", "longitude"), counts.select("city", "n_clusters", "n_locations", "min_lat", "max_lat", "min_lon", "max_lon"), ["city"])
    bands = F.ceil(F.sqrt(F.col("n_clusters").cast("double")))

    def band(x: str, low: str, high: str):
        span = F.col(high) - F.col(low)
        return F.when(span > 0, F.least(F.floor((F.col(x) - F.col(low)) / span * bands), bands - 1)).otherwise(F.lit(0)).cast("long")

    def order(start: int):
        if start < 2:
            x, y = ("latitude", "longitude") if start == 0 else ("longitude", "latitude")
            own = band("latitude", "min_lat", "max_lat") if start == 0 else band("longitude", "min_lon", "max_lon")
            return F.struct(F.lit(start).alias("start"), own.cast("double").alias("a"), F.when(own % 2 == 0, F.col(y)).otherwise(-F.col(y)).alias("b"), F.col(x).alias("c"))
        mixed = (F.round(F.col("latitude") * 1e6).cast("long") * 48_271 + F.round(F.col("longitude") * 1e6).cast("long") * 69_621) * (2 * start + 1)
        return F.struct(F.lit(start).alias("start"), F.pmod(mixed, F.lit(2_147_483_647)).cast("double").alias("a"), F.col("latitude").alias("b"), F.col("longitude").alias("c"))

    locs = locs.withColumn("_o", F.explode(F.array(*[order(i) for i in range(starts)]))).select("*", "_o.start", "_o.a", "_o.b", "_o.c")
    ranked = group_rank(locs, ["city", "start"], ["a", "b", "c"], rank_col="_rn")
    r0, k, n = F.col("_rn") - 1, F.col("n_clusters").cast("long"), F.col("n_locations").cast("long")
    j = F.floor((r0 * k + n - 1) / n).cast("long")
    pick = (j < k) & (F.floor((j * n) / k).cast("long") == r0)
    return ranked.filter(pick).select("city", "start", j.cast("int").alias("cluster"), F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon"))


def states_of(seeds: DataFrame) -> DataFrame:
    """(city, start, centres): the centres of every start side by side."""
    return seeds.groupBy("city", "start").agg(F.sort_array(F.collect_list(F.struct("cluster", "c_lat", "c_lon"))).alias("centres"))


def _assign(places: DataFrame, states: DataFrame) -> DataFrame:
    """(city, start, latitude, longitude, weight, cluster, c_lat, c_lon, d2): every place with the states of its city, nearest centre and squared distance."""
    away = lambda c: F.struct(((F.col("latitude") - c["c_lat"]) ** 2 + (F.col("longitude") - c["c_lon"]) ** 2).alias("d2"), c["cluster"].alias("cluster"), c["c_lat"].alias("c_lat"), c["c_lon"].alias("c_lon"))
    out = places.join(states.withColumnRenamed("city", "_city"), F.col("city") == F.col("_city"))
    out = out.select("city", "start", "latitude", "longitude", "weight", F.array_min(F.transform("centres", away)).alias("_best"))
    return out.select("city", "start", "latitude", "longitude", "weight", *[f"_best.{c}" for c in ("cluster", "c_lat", "c_lon", "d2")])


def blocks(places: DataFrame) -> DataFrame:
    """(city, latitudes, longitudes, weights): the places of every city in blocks of about ``BLOCK``, by a hash."""
    sizes = places.groupBy("city").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("_blocks"))
    dealt = join_group_stats(places, sizes, ["city"]).withColumn("_block", F.pmod(F.xxhash64("latitude", "longitude"), "_blocks"))
    cells = dealt.groupBy("city", "_block").agg(F.collect_list(F.struct("latitude", "longitude", "weight")).alias("c"))
    return cells.select("city", F.col("c.latitude").alias("latitudes"), F.col("c.longitude").alias("longitudes"), F.col("c.weight").alias("weights"))


def _round(lat: np.ndarray, lon: np.ndarray, w: np.ndarray, c_lat: np.ndarray, c_lon: np.ndarray) -> np.ndarray:
    """Per centre: summed weight and weighted coordinates of the places nearest to it."""
    # Of equally near centres the first, which has the lowest cluster.
    best = ((lat[:, None] - c_lat) ** 2 + (lon[:, None] - c_lon) ** 2).argmin(axis=1)
    return np.array([np.bincount(best, x, len(c_lat)) for x in (w, w * lat, w * lon)])


def _solved(max_iter: int):
    """All rounds of one city and start: its centres, and the last shift."""

    def run(key, cells):
        blocks = list(zip(*([x.values.to_numpy() for x in cells.column(c)] for c in ("latitudes", "longitudes", "weights"))))
        state, limit = cells.column("centres")[0].as_py(), cells.column("limit")[0].as_py()
        c_lat, c_lon = (np.array([c[x] for c in state]) for x in ("c_lat", "c_lon"))
        rounds, shift = 0, None
        # Tested after as many rounds as between two tests of the others, NaN above all numbers as in Spark.
        while rounds < max_iter and (shift is None or not (shift <= limit or np.isnan(limit))):
            for _ in range(min(UNROLL, max_iter - rounds)):
                n, lat, lon = sum(_round(*b, c_lat, c_lon) for b in blocks)
                used = n > 0
                new_lat, new_lon = (np.where(used, np.divide(x, n, out=np.zeros_like(x), where=used), old) for x, old in ((lat, c_lat), (lon, c_lon)))
                shift = float(((new_lat - c_lat) ** 2 + (new_lon - c_lon) ** 2).sum())
                c_lat, c_lon = new_lat, new_lon
                rounds += 1
        centres = [{"cluster": c["cluster"], "c_lat": a, "c_lon": b} for c, a, b in zip(state, c_lat.tolist(), c_lon.tolist())]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.struct([("cluster", pa.int32()), ("c_lat", pa.float64()), ("c_lon", pa.float64())])), pa.float64(), pa.float64()]
        row = (key[0].as_py(), key[1].as_py(), centres, shift, limit)
        return pa.Table.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["city", "start", "centres", "shift", "limit"])

    return run


def solve_at_once(blocks: DataFrame, states: DataFrame, limits: DataFrame, max_iter: int) -> DataFrame:
    """(city, start, centres, shift, limit): every state after its rounds, each city and start in one task."""
    own = states.join(limits.withColumnRenamed("_city", "_of"), F.col("city") == F.col("_of")).select(F.col("city").alias("_city"), "start", "centres", "limit")
    met = blocks.join(own, F.col("city") == F.col("_city")).select("city", "start", "latitudes", "longitudes", "weights", "centres", "limit")
    return met.groupBy("city", "start").applyInArrow(
        _solved(max_iter), "city string, start int, centres array<struct<cluster: int, c_lat: double, c_lon: double>>, shift double, limit double"
    )


def _sums(batches):
    """Per block, start and cluster with a place: summed weight and weighted coordinates."""
    for b in batches:
        cities, found = b.column(0), []
        lats, lons, weights = (b.column(i) for i in (1, 2, 3))
        for i, states in enumerate(b.column(4).to_pylist()):
            lat, lon, w = (x[i].values.to_numpy() for x in (lats, lons, weights))
            for state in states:
                c_lat, c_lon = (np.array([c[x] for c in state["centres"]]) for x in ("c_lat", "c_lon"))
                sums = _round(lat, lon, w, c_lat, c_lon)
                found += [(i, state["start"], state["centres"][k]["cluster"], *(x[k] for x in sums)) for k in np.flatnonzero(sums[0])]
        columns = list(zip(*found)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 3]
        columns = [pa.array(x, kind) for x, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([cities.take(columns[0]), *columns[1:]], ["city", "start", "cluster", "w", "w_lat", "w_lon"])


def cluster_step(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """One round: (city, start, centres, shift); a cluster without places keeps its centre.

    Reads ``states`` twice, for the distances and for the old centres, so they
    should be a table.
    """
    of_city = states.groupBy(F.col("city").alias("_city")).agg(F.collect_list(F.struct("start", "centres")).alias("states"))
    met = blocks.join(of_city, F.col("city") == F.col("_city")).select("city", "latitudes", "longitudes", "weights", "states")
    sums = met.mapInArrow(_sums, "city string, start int, cluster int, w double, w_lat double, w_lon double")
    means = sums.groupBy("city", "start", "cluster").agg((F.sum("w_lat") / F.sum("w")).alias("lat"), (F.sum("w_lon") / F.sum("w")).alias("lon"))
    new = F.map_from_entries(F.collect_list(F.struct("cluster", F.struct("lat", "lon"))))
    out = means.groupBy("city", "start").agg(new.alias("new")).join(states.select("city", "start", F.col("centres").alias("old")), ["city", "start"])
    at = lambda c, x, y: F.coalesce(F.col("new")[c["cluster"]][x], c[y])
    out = out.withColumn("centres", F.transform("old", lambda c: F.struct(c["cluster"].alias("cluster"), at(c, "lat", "c_lat").alias("c_lat"), at(c, "lon", "c_lon").alias("c_lon"))))
    moved = F.zip_with("old", "centres", lambda a, b: (a["c_lat"] - b["c_lat"]) ** 2 + (a["c_lon"] - b["c_lon"]) ** 2)
    return out.select("city", "start", "centres", F.aggregate(moved, F.lit(0.0), lambda a, x: a + x).alias("shift"))


def kmeans_by_city(
    df: DataFrame,
    counts: DataFrame | None = None,
    id_col: str = "listing_id",
    max_iter: int = 300,
    tol: float = 1e-4,
    history: list | None = None,
    starts: int = STARTS,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """``location_cluster`` per row (0 for rows without coordinates or city).

    A (city, start) stops when its summed squared centre shift is at most
    ``tol`` times the city's mean coordinate variance; not having converged after
    ``max_iter`` rounds is an error, never a silent result.  Those that have
    converged leave the rounds.  Every round writes its centres; ``UNROLL``
    rounds lie between two tests.  Cities of at most ``at_once`` places end
    their rounds in one task per start, unless ``history`` asks for every round.
    ``history``, when given, receives the inertia (sum of squared distances)
    after each assignment step, for convergence checks.
    """
    counts = materialize_table(counts if counts is not None else cluster_counts(df, id_col), "cluster-counts")
    limits = counts.select(F.col("city").alias("_city"), (F.lit(float(tol)) * F.coalesce("mean_var", F.lit(0.0))).alias("limit"))
    places = materialize_table(locations(df, id_col), "places")
    dealt = materialize_table(blocks(places), "place-blocks")
    moving = materialize_table(states_of(cluster_seeds(places, counts, starts)), "centres")
    inertia = lambda states: _assign(places, states).agg(F.sum(F.col("weight") * F.col("d2"))).first()[0]
    done: list[DataFrame] = []
    rounds = 0
    if history is None:
        few = limits.join(counts.filter(F.col("n_locations") <= at_once).select(F.col("city").alias("_few")), F.col("_city") == F.col("_few")).drop("_few")
        solved = materialize_table(solve_at_once(dealt, moving, few, max_iter), "centres")
        if not solved.filter("not shift <= limit").isEmpty():
            raise RuntimeError(f"k-means has not converged after {max_iter} rounds")
        done.append(solved.select("city", "start", "centres"))
        moving = moving.join(few, F.col("city") == F.col("_city"), "left_anti")
    while not (done and moving.isEmpty()):
        if rounds >= max_iter:
            raise RuntimeError(f"k-means has not converged after {rounds} rounds")
        step = moving
        for _ in range(min(UNROLL, max_iter - rounds)):
            if history is not None and not done:
                history.append(inertia(step))
            step = materialize_table(cluster_step(dealt, step), "centres")
            rounds += 1
        # Written with its limits, so that the next round's join knows the states as the small side.
        step = materialize_table(step.join(limits, F.col("city") == F.col("_city")).drop("_city"), "centres")
        done.append(step.filter("shift <= limit").select("city", "start", "centres"))
        moving = step.filter("shift > limit").select("city", "start", "centres")
    states = done[0]
    for d in done[1:]:
        states = states.unionByName(d)
    final = materialize_table(_assign(places, states), "assigned")
    best = final.groupBy("city", "start").agg(F.sum(F.col("weight") * F.col("d2")).alias("inertia")).groupBy("city").agg(F.min(F.struct(F.round("inertia", 9), "start", "inertia")).alias("m"))
    best = best.select("city", "m.start", "m.inertia")
    if history is not None:
        history.append(best.agg(F.sum("inertia")).first()[0])
    final = final.join(best, ["city", "start"])
    # Number the non-empty clusters of each city by centre position (at most 30 rows a city).
    used = final.select("city", "cluster", "c_lat", "c_lon").distinct()
    number = F.row_number().over(Window.partitionBy("city").orderBy("c_lat", "c_lon", "cluster")) - 1
    order = used.select("city", "cluster", number.cast("int").alias("location_cluster"))
    labels = final.join(order, ["city", "cluster"]).select(F.col("city").alias("_city"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "location_cluster")
    out = df.join(labels, (df["city"] == labels["_city"]) & (df["latitude"] == labels["_lat"]) & (df["longitude"] == labels["_lon"]), "left").drop("_city", "_lat", "_lon")
    return out.withColumn("location_cluster", F.coalesce(F.col("location_cluster"), F.lit(0)).cast("int"))
