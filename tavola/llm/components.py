"""Connected components of links, as alternating star contractions on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.session import materialize_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component = its smallest node.

    Links are pairs of comparable ids.  Each round hangs every larger
    neighbour of a node, then the node itself, under the smallest neighbour;
    rounds are logarithmic in practice and end when the links are stars whose
    centres are the components.  The smallest neighbour is a grouped minimum
    (combined before the shuffle), never a collected neighbour list.  Every
    round is written to the shared checkpoint folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = materialize_table(edges, "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.filter("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        small = materialize_table(small.filter("u <> v").distinct(), "links")
        # Stars: every node is under one centre and no centre is under another.
        done = small.groupBy("u").count().filter("count > 1").isEmpty() and small.join(small.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        edges = small
        if done:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
