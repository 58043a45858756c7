"""Right-closed bins and quartile labels as chained ``when`` expressions.

``Bucketizer`` is left-closed, the reference's bins are right-closed
(``(a, b]``), so bins are written out as comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges and labels of the derived categories.
COST_EDGES = [-1.0, 300.0, 700.0, 1500.0, float("inf")]
COST_LABELS = ["Budget", "Medium", "Premium", "Luxury"]
RATING_EDGES = [0.0, 2.5, 3.5, 4.0, 5.0]
RATING_LABELS = ["Poor", "Average", "Good", "Excellent"]
NOT_RATED = "Not Rated"
POPULARITY_EDGES = [-1.0, 50.0, 200.0, 1000.0, float("inf")]
POPULARITY_LABELS = ["Low", "Medium", "High", "Very High"]
QUARTILE_LABELS = ["Budget", "Medium", "Premium", "Luxury"]


def right_closed_bins(x: Column, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Label of the bin ``(edges[i], edges[i+1]]`` holding ``x``; null outside or for null."""
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower_ok = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        cond = lower_ok & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def cost_category(cost: Column) -> Column:
    return right_closed_bins(cost, COST_EDGES, COST_LABELS)


def rating_category(rating: Column) -> Column:
    return F.when(rating == F.lit(0.0), F.lit(NOT_RATED)).otherwise(
        right_closed_bins(rating, RATING_EDGES, RATING_LABELS, include_lowest=True)
    )


def popularity_category(votes: Column) -> Column:
    return right_closed_bins(votes, POPULARITY_EDGES, POPULARITY_LABELS)


def quartile_index(rn: Column, n: Column) -> Column:
    """1..4 as ``qcut`` of the ranks 1..n into four equal-width rank bins.

    Bin j holds ranks with ``1 + (j-1)(n-1)/4 < rn <= 1 + j(n-1)/4``, so
    ``j = max(1, ceil(4 (rn-1) / (n-1)))``.  (``ntile(4)`` differs.)
    """
    return F.greatest(F.lit(1), F.ceil(F.try_divide(F.lit(4.0) * (rn - 1), (n - 1).cast("double"))).cast("int"))


def quartile_label(rn: Column, n: Column, labels: list[str] = QUARTILE_LABELS) -> Column:
    arr = F.array(*[F.lit(x) for x in labels])
    return F.element_at(arr, quartile_index(rn, n))
