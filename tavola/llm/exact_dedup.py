"""Exact duplicate groups by 128-bit content hash, with byte comparison.

Defined results: a null text counts as empty; empty texts form one group like
any other; a null id never wins over an id, and a group of null ids only keeps
a null id; rows that repeat the kept id are all marked kept; an empty table
gives no rows; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.llm.common import lower_ascii
from tavola.session import materialize_table


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (hash, normalised text): the hash spreads and orders
    the rows, the text itself decides equality, so two texts under one hash
    never merge.  The aggregate combines copies before the shuffle, hence a
    group holding a third of the rows travels as one row per task.  Members
    find their group by the hash alone in a join of two narrow tables, which
    adaptive execution can split; only hashes that the byte comparison found
    to cover several texts, if any, are joined by text.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    norm = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm")).withColumn("_hash", hash_of(F.col("_norm")))
    by_bytes = rows.groupBy("_hash", "_norm").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize_table(by_bytes.select("_hash", "keep_id", "group_size", F.sha2(F.col("_norm"), 256).alias("text_sha256")), "exact-groups")
    shared = groups.groupBy("_hash").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_hash")

    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    narrow = rows.select("doc_id", "_hash")
    if shared.isEmpty():
        return narrow.join(groups, "_hash").select(*out)
    alone = narrow.join(groups.join(shared, "_hash", "left_anti"), "_hash").select(*out)
    texts = rows.join(shared, "_hash", "left_semi")
    again = by_bytes.join(shared, "_hash", "left_semi").withColumn("text_sha256", F.sha2(F.col("_norm"), 256))
    return alone.unionByName(texts.join(again, ["_hash", "_norm"]).select(*out))
