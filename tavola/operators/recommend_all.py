"""R11 / F20 for all requests: the top N listings of every request.

Requests with equal preferences are answered once; distinct preferences go to
the tasks in blocks of bounded size, each block against all listings:

1. one pass takes the survivors' maxima (F17, F18) of every distinct rating floor;
2. every task puts its listings, a bounded segment at a time, into classes of
   equal values in the attributes that the block's requests ask for.  A class
   bounds the score of its listings: its own match terms, and the best of the
   numeric terms any of its listings has;
3. a request reads the classes from the highest bound down and stops at the
   first bound below its N-th score so far.  Bounds add the same terms in the
   same order as scores do, so rounding cannot lift a score above its bound;
4. the tasks' best N per preference are ranked together and joined back to the
   requests.

No listing is left out but by its class's bound, so the result is exact; a
request never meets all listings one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tavola.operators import recommend as R
from tavola.session import materialize_table

PREFERENCES = 4096
SEGMENT = 1 << 16
# Preference -> (listing column, weight): terms that match by equal lower-case text, in the order of scoring.
EQUAL = {
    "city": ("city", R.W_CITY),
    "rating_category": ("rating_category", R.W_RATING_CATEGORY),
    "cost_category": ("restaurant_cost_category", R.W_COST_CATEGORY),
    "popularity_category": ("popularity_category", R.W_POPULARITY_CATEGORY),
    "city_location_cluster": ("city_location_cluster", R.W_CITY_CLUSTER),
    "online_delivery": ("has_online_delivery", R.W_DELIVERY),
    "table_booking": ("has_table_booking", R.W_BOOKING),
    "delivering_now": ("is_delivering_now", R.W_DELIVERING_NOW),
}
NUMBERS = {"is_expensive": ("is_expensive", R.W_EXPENSIVE, 0), "location_cluster": ("location_cluster", R.W_LOCATION_CLUSTER, -1)}
OTHER = {"cuisines": "cuisines", "locality": "locality", "price_range": "price_range"}
COLUMN = {k: v[0] for k, v in (EQUAL | NUMBERS).items()} | OTHER
FIELDS = ["cuisines", "city", "locality", "price_range", "min_rating", "rating_category", "max_cost", "cost_category", "popularity_category", "is_expensive", "location_cluster", "city_location_cluster", "online_delivery", "table_booking", "delivering_now"]
# The order in which recommend.score adds its terms up; "numeric" terms depend on values beyond a class.
ORDER = ["cuisines", "city", "locality", "price_range", "rating", "rating_category", "budget", "cost_category", "popularity_category", "is_expensive", "location_cluster", "city_location_cluster", "online_delivery", "table_booking", "delivering_now", "votes", "popularity", "cost_relative"]
SCORED = ["listing_id", "aggregate_rating", "votes", "average_cost_inr", "log_votes", "restaurant_popularity_score", "cost_relative_to_city"]


def _clip01(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, 0.0), 1.0)


def _filled(column: pa.ChunkedArray, null: float) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(null).to_numpy()


class Numbers:
    """The numeric attributes of listings, or the best of each class: ready for the numeric terms."""

    def __init__(self, rating, cost, log_votes, popularity, relative):
        self.rating, self.cost, self.log_votes, self.popularity, self.relative = rating, cost, log_votes, popularity, relative

    def terms(self, pref: dict, maxima: tuple[float, float]) -> dict[str, np.ndarray]:
        out = {"rating": (np.minimum(np.maximum(self.rating, 0.0), 5.0) / 5.0) * R.W_RATING, "cost_relative": self.relative * R.W_COST_RELATIVE}
        if pref["max_cost"] is not None:
            limit = float(pref["max_cost"])
            cost = np.where(np.isnan(self.cost), limit, self.cost)
            out["budget"] = (1 - _clip01(np.maximum(cost - limit, 0.0) / max(limit, 1.0))) * R.W_BUDGET
        for name, values, most, weight in (("votes", self.log_votes, maxima[0], R.W_VOTES), ("popularity", self.popularity, maxima[1], R.W_POPULARITY)):
            if most > 0:
                out[name] = values / most * weight
        return out


class Classes:
    """A segment of listings in classes of equal asked-for attributes."""

    def __init__(self, table: pa.Table, asked: list[str]):
        self.asked = asked
        codes, self.levels = [], {}
        for name in asked:
            column = table[COLUMN[name]]
            if name in EQUAL or name in ("cuisines", "locality"):
                values = [(x or "").lower() for x in column.to_pylist()]
            else:
                values = column.to_pylist()
            levels: dict = {}
            codes.append([levels.setdefault(v, len(levels)) for v in values])
            self.levels[name] = list(levels)
        n = table.num_rows
        grid = np.array(codes, np.int64).T.reshape(n, len(asked))
        self.keys, own = np.unique(grid, axis=0, return_inverse=True)
        own = own.reshape(n)
        order = np.argsort(own, kind="stable")
        self.cuts = np.append(np.searchsorted(own[order], np.arange(len(self.keys))), n)
        rows = table.take(pa.array(order))
        self.ids = rows["listing_id"].to_numpy()
        self.rating, self.votes = _filled(rows["aggregate_rating"], -np.inf), _filled(rows["votes"], -np.inf)
        relative = 1 - _clip01(np.abs(_filled(rows["cost_relative_to_city"], 1.0) - 1))
        self.numbers = Numbers(_filled(rows["aggregate_rating"], 0.0), _filled(rows["average_cost_inr"], np.nan), _filled(rows["log_votes"], 0.0), _filled(rows["restaurant_popularity_score"], 0.0), relative)
        best = lambda x, f=np.maximum: f.reduceat(x, self.cuts[:-1])
        cheapest = best(np.where(np.isnan(self.numbers.cost), -np.inf, self.numbers.cost), np.minimum)  # unknown costs count as within any budget
        self.best = Numbers(best(self.numbers.rating), cheapest, best(self.numbers.log_votes), best(self.numbers.popularity), best(relative))
        self.scored = 0

    def matches(self, pref: dict) -> dict[str, np.ndarray]:
        """The terms that are equal for all listings of a class."""
        out = {}
        for i, name in enumerate(self.asked):
            wish = pref[name]
            if wish is None or name not in ("price_range", *NUMBERS) and not wish:
                continue
            if name == "cuisines":
                wanted = {c.lower() for c in wish}
                level = [len({t for x in v.split(",") if (t := x.strip(" "))} & wanted) / float(len(wish)) * R.W_CUISINE for v in self.levels[name]]
            elif name == "locality":
                level = [float(wish.lower() in v) * R.W_LOCALITY for v in self.levels[name]]
            elif name == "price_range":
                level = [(1 - min(max(abs((wish if v is None else v) - wish) / 3.0, 0.0), 1.0)) * R.W_PRICE for v in self.levels[name]]
            elif name in NUMBERS:
                level = [float(int(NUMBERS[name][2] if v is None else v) == int(wish)) * NUMBERS[name][1] for v in self.levels[name]]
            else:
                level = [float(v == wish.lower()) * EQUAL[name][1] for v in self.levels[name]]
            out[name] = np.array(level)[self.keys[:, i]]
        return out

    def search(self, pref: dict, maxima: tuple[float, float], top: Top) -> None:
        floor = -np.inf if pref["min_rating"] is None else float(pref["min_rating"])
        matches = self.matches(pref)
        bound = _total(matches | self.best.terms(pref, maxima), len(self.keys))
        bound[self.best.rating < floor] = -np.inf
        order, done, step = np.argsort(-bound, kind="stable"), 0, 4
        numeric = self.numbers.terms(pref, maxima)
        while done < len(order):
            read = order[done : done + step]
            read = read[(bound[read] >= top.least) & (bound[read] > -np.inf)]
            if not len(read):
                break
            sizes = self.cuts[read + 1] - self.cuts[read]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(self.cuts[read], self.cuts[read + 1])])
            owner = np.repeat(read, sizes)
            live = self.numbers.rating[rows] >= floor
            rows, owner = rows[live], owner[live]
            self.scored += len(rows)
            scores = _total({k: v[owner] for k, v in matches.items()} | {k: v[rows] for k, v in numeric.items()}, len(rows))
            top.offer(scores, self.rating[rows], self.votes[rows], self.ids[rows])
            done, step = done + step, step * 2


def _total(terms: dict[str, np.ndarray], n: int) -> np.ndarray:
    total = np.zeros(n)
    for name in ORDER:
        if name in terms:
            total = total + terms[name]
    return total


class Top:
    """The N best (score, rating, votes, id) of a preference."""

    def __init__(self, n: int):
        self.n, self.rows = n, [np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]

    @property
    def least(self) -> float:
        return self.rows[0][-1] if len(self.rows[0]) == self.n else -np.inf

    def offer(self, *rows: np.ndarray) -> None:
        good = rows[0] >= self.least
        rows = [np.append(a, b[good]) for a, b in zip(self.rows, rows)]
        best = np.lexsort((rows[3], -rows[2], -rows[1], -rows[0]))[: self.n]
        self.rows = [x[best] for x in rows]


def _maxima(listings: DataFrame, floors: list[float]) -> dict[float, tuple[float, float]]:
    """(most log votes, most popularity) of the listings at or above every rating floor."""
    spark, steps = listings.sparkSession, np.array(sorted(floors))
    shared = spark.sparkContext.broadcast(steps)
    rows = listings.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("aggregate_rating", "log_votes", "restaurant_popularity_score")))

    def run(batches):
        steps = shared.value
        most = np.full((2, len(steps)), -np.inf)
        for b in batches:
            rating, *values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            reached = np.searchsorted(steps, rating, side="right") - 1  # the highest floor that a listing reaches
            for i, v in enumerate(values):
                np.maximum.at(most[i], reached[reached >= 0], v[reached >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(steps)), pa.int32()), *(pa.array(x, pa.float64()) for x in most)], ["step", "lv", "ps"])

    most = np.full((2, len(steps)), -np.inf)
    for r in rows.mapInArrow(run, "step int, lv double, ps double").groupBy("step").agg(F.max("lv").alias("lv"), F.max("ps").alias("ps")).collect():  # a row per floor
        most[:, r["step"]] = r["lv"], r["ps"]
    most = np.maximum.accumulate(most[:, ::-1], axis=1)[:, ::-1]
    return {f: (float(a), float(b)) for f, a, b in zip(steps.tolist(), *most)}


def _search_block(listings: DataFrame, block: list[dict], n: int) -> DataFrame:
    spark = listings.sparkSession
    maxima = _maxima(listings, list({-np.inf if p["min_rating"] is None else float(p["min_rating"]) for p in block}))
    asked = [k for k in COLUMN if any(p[k] not in (None, "", []) for p in block)]
    shared = spark.sparkContext.broadcast((block, maxima, asked))
    columns = list(dict.fromkeys([*SCORED, *(COLUMN[k] for k in asked)]))

    def run(batches):
        block, maxima, asked = shared.value
        tops = [Top(n) for _ in block]

        def search(held):
            classes = Classes(pa.Table.from_batches(held), asked)
            for p, top in zip(block, tops):
                classes.search(p, maxima[-np.inf if p["min_rating"] is None else float(p["min_rating"])], top)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SEGMENT:
                search(held)
                held, size = [], 0
        if size:
            search(held)
        found = [np.concatenate(x) for x in zip(*(t.rows for t in tops))]
        which = np.repeat(np.arange(len(tops)), [len(t.rows[0]) for t in tops])
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.array(x) for x in found)], ["which", "score", "rating", "order_votes", "listing_id"])

    found = listings.select(*columns).filter("listing_id is not null").mapInArrow(run, "which int, score double, rating double, order_votes double, listing_id long")
    best = Window.partitionBy("which").orderBy(F.col("score").desc(), F.col("rating").desc(), F.col("order_votes").desc(), F.col("listing_id").asc())
    found = found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= n)
    keys = spark.createDataFrame([(i, p["_key"]) for i, p in enumerate(block)], "which int, key string")
    out = materialize_table(found.join(keys, "which").select("key", "rank", "listing_id", "score"), "recommended")
    shared.destroy()
    return out


def recommend_all(listings: DataFrame, requests: DataFrame, top_n: int = 10, round_score: int | None = 4) -> DataFrame:
    """(request_id, rank, listing_id, score) for every row of ``requests``.

    Requests have ``request_id`` and any of the preference columns (``cuisines``
    an array); a missing or null preference is not asked for.  Requests with a
    rating floor that no listing reaches get no rows, as with one request.
    """
    R.validate({}, top_n)
    there = [c for c in FIELDS if c in requests.columns]
    key = F.to_json(F.struct(*there)) if there else F.lit("{}")
    keyed = requests.select("request_id", key.alias("key"), *there)
    distinct = keyed.drop("request_id").dropDuplicates(["key"])
    empty = requests.sparkSession.createDataFrame([], "key string, rank int, listing_id long, score double")
    out, block = empty, []
    for r in distinct.toLocalIterator():
        pref = {c: r[c] if c in there else None for c in FIELDS}
        R.validate(pref, top_n)
        block.append(pref | {"_key": r["key"]})
        if len(block) == PREFERENCES:
            out, block = out.unionByName(_search_block(listings, block, top_n)), []
    if block:
        out = out.unionByName(_search_block(listings, block, top_n))
    found = keyed.select("request_id", "key").join(out, "key").select("request_id", "rank", "listing_id", "score")
    return found if round_score is None else found.withColumn("score", F.round("score", round_score))
