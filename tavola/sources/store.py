"""A listings store that is merged part by part.

The store is Parquet, partitioned by a hash of the listing id.  A merge reads
and rewrites only the parts that hold incoming ids, by Spark's dynamic
partition overwrite; the files of all other parts stay as they are.  A merge
that is run again with the same rows and time gives the same store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.operators import warehouse
from tavola.session import materialize_table

PARTS = 64
PART = "store_part"


def _part(id_col: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(parts)).cast("int")


def write_store(df: DataFrame, path: str, parts: int = PARTS) -> None:
    """A new store of ``parts`` parts; every part is one task's files."""
    rows = df.withColumn(PART, _part("listing_id", parts))
    rows.repartition(parts, PART).write.mode("overwrite").partitionBy(PART).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def merge_store(spark: SparkSession, path: str, incoming: DataFrame, now: Column, order_col: str | None = None, parts: int = PARTS) -> list[int]:
    """Upsert ``incoming`` into the store; returns the parts that were rewritten.

    ``parts`` must be the store's own number.  The merged parts are written to
    the shared scratch folder before they replace the old ones, as a job cannot
    overwrite what it reads.
    """
    incoming = incoming.withColumn(PART, _part("listing_id", parts))
    touched = sorted(r[0] for r in incoming.select(PART).distinct().collect())  # at most ``parts`` numbers
    if not touched:
        return []
    existing = spark.read.parquet(path).filter(F.col(PART).isin(touched))  # only these folders are read
    merged = warehouse.upsert_listings(existing.drop(PART), incoming.drop(PART), now, order_col)
    merged = materialize_table(merged.withColumn(PART, _part("listing_id", parts)), "merged-parts")
    rows = merged.repartition(min(parts, len(touched)), PART)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return touched
