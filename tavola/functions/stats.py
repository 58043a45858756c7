"""Skew-safe per-group statistics.

Per-group values that the reference computes with ``groupby().transform`` are
built here as a grouped aggregate joined back on the keys, never as a window
partitioned by the group key: the aggregate combines map-side before the
shuffle, so a key holding a third of all rows does not land whole in one task,
and the joined side is one row per group (AQE broadcasts it when its measured
size is small, and splits skewed partitions otherwise).

Exact ranks inside a group use a global range-partitioned sort: a hot key is
spread over several range partitions, each partition counts its rows per
group, and a running sum over those (partition, group) counts gives every
partition its offset.  No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.session import cut_lineage

def join_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join a one-row-per-group table back onto the rows.

    Equality join: rows whose key is null get null statistics, as pandas
    ``transform`` does for dropped null groups.
    """
    renamed = stats.select(*[F.col(c).alias(f"_gk_{c}") if c in keys else F.col(c) for c in stats.columns])
    cond = [F.col(k) == F.col(f"_gk_{k}") for k in keys]
    out = df.join(renamed, cond, "left").drop(*[f"_gk_{k}" for k in keys])
    return out


def group_rank(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    rank_col: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact 1-based ``row_number()`` within each group, skew-safe.

    ``order_cols`` must make the order total inside a group (end with a unique
    key).  Rows with a null group key get a null rank.
    """
    order_exprs = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    null_key = F.lit(False)
    for g in group_cols:
        null_key = null_key | F.col(g).isNull()
    keyed = df.filter(~null_key)
    sort_keys = [F.col(g) for g in group_cols] + order_exprs
    ranked = (
        (keyed.repartitionByRange(num_partitions, *sort_keys) if num_partitions else keyed.repartitionByRange(*sort_keys))
        .sortWithinPartitions(*sort_keys)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright(F.col("_pos"), 33))
    )
    # The positions depend on the sampled range bounds, so the sorted data
    # must be computed exactly once: materialise it eagerly (a reliable
    # checkpoint when the cluster names a folder), never lazily, so that two
    # branches of one job, or a retry after a lost executor, cannot re-sample
    # different bounds.
    ranked = cut_lineage(ranked)
    counts = ranked.groupBy("_pid", *group_cols).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # (partition, group) pairs: at most partitions + groups rows.  It comes
    # out of a shuffle, so AQE measures it and broadcasts it when small.
    # One packed key: were partition and group columns keys of their own, the
    # planner might deal the rows by the group alone and bring a hot group
    # together again.
    part = F.struct("_pid", *group_cols).alias("_part")
    offsets = counts.select(part, "_first", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = ranked.select("*", part).join(offsets, "_part", "left")
    out = out.withColumn(rank_col, (F.col("_pos") - F.col("_first") + F.col("_off") + 1).cast("long")).drop("_part", "_pos", "_pid", "_first", "_off")
    rest = df.filter(null_key).withColumn(rank_col, F.lit(None).cast("long"))
    return out.unionByName(rest)


def exact_percentiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: Sequence[float],
    tiebreak: str | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group (pandas ``quantile``).

    Rows are first counted per (group, value), combined before the shuffle;
    the counts are range-partitioned and summed up within each partition, and
    every partition gets its group's rows before it.  A group or a value that
    holds most rows thus never meets in one task.  Null values and groups are
    ignored; without group columns the result is one row (none for no rows).
    ``tiebreak`` is not needed and only accepted.
    """
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    g = list(group_cols)
    keyed = df.select(*g, F.col(value_col).alias("_value")).dropna()
    counts = keyed.groupBy(*g, "_value").agg(F.count(F.lit(1)).alias("_c"))
    # The running sums depend on the sampled range bounds: materialised once.
    counts = cut_lineage(counts.repartitionByRange(*g, "_value").withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_pid", *g).agg(F.sum("_c").alias("_sum"))
    part = F.struct("_pid", *g).alias("_part")
    parts = parts.select(part, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select("*", part).withColumn("_in", F.sum("_c").over(inside)).join(parts, "_part", "left").withColumn("_upto", F.col("_in") + F.col("_off"))
    n = counts.groupBy(*g).agg(F.sum("_c").alias("_n"))
    ranked = join_group_stats(upto, n, g) if g else upto.withColumn("_n", n.select("_n").scalar())
    at = lambda rank, name: F.max(F.when((F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto")), F.col("_value"))).alias(name)
    picks = []
    for p, name in zip(probs, names):
        h = (F.col("_n") - 1) * F.lit(float(p))
        picks += [at(F.floor(h) + 1, f"_{name}_lo"), at(F.ceil(h) + 1, f"_{name}_hi"), F.max(h - F.floor(h)).alias(f"_{name}_f")]
    agg = ranked.groupBy(*g).agg(*picks)
    cut = lambda nm: F.col(f"_{nm}_lo") + (F.col(f"_{nm}_hi") - F.col(f"_{nm}_lo")) * F.col(f"_{nm}_f")
    return agg.select(*g, *[cut(nm).alias(nm) for nm in names])


def exact_medians(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str) -> DataFrame:
    """One row per group: the exact median of its non-null values."""
    return exact_percentiles(df, group_cols, value_col, [0.5], names=[name])


def exact_percentiles_many(
    df: DataFrame,
    group_cols: Sequence[str],
    value_cols: Sequence[str],
    probs: Sequence[float],
    tiebreak: str | None = None,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`exact_percentiles` of several columns with one distributed sort.

    The value columns are unpivoted to ``(group, variable, value)`` rows and
    ranked together; the result is pivoted back with the known variable list
    (no extra job).  Output columns are ``{value_col}_{name}``.
    """
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    long = df.select(*group_cols, *value_cols).unpivot(list(group_cols), list(value_cols), "_var", "_val")
    q = exact_percentiles(long, [*group_cols, "_var"], "_val", probs, names=names)
    wide = q.groupBy(*group_cols).pivot("_var", list(value_cols)).agg(*[F.first(n).alias(n) for n in names])
    # With a single aggregate Spark names the pivoted columns by the value alone.
    return wide.withColumnsRenamed({c: f"{c}_{names[0]}" for c in value_cols}) if len(names) == 1 else wide


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column], sums: Mapping[str, str | Column]) -> DataFrame:
    """Running sums within each group, this row included, skew-safe.

    ``sums``: output column -> value (null adds nothing).  Rows are dealt by
    ranges of (group, order), so a hot group spans several partitions; each
    partition sums up its own stretch of a group, and running sums over the
    (partition, group) totals give what lies before it.  ``order_cols`` must
    make the order total inside a group.  Null is a group like any other;
    without group columns the whole table is one group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    g = list(group_cols)
    value = {out: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for out, v in sums.items()}
    dealt = df.withColumns({f"_v_{out}": v for out, v in value.items()}).repartitionByRange(*g, *order).withColumn("_pid", F.spark_partition_id())
    # Range bounds are sampled: dealt once, for both branches and for retries.
    dealt = cut_lineage(dealt)
    part = F.struct("_pid", *g).alias("_part")
    totals = dealt.groupBy("_pid", *g).agg(*[F.sum(f"_v_{out}").alias(f"_t_{out}") for out in sums])
    before = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *[F.sum(f"_t_{out}").over(before).alias(f"_o_{out}") for out in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", part).withColumns({f"_l_{out}": F.sum(f"_v_{out}").over(inside) for out in sums})
    both = local.join(offsets.withColumnRenamed("_part", "_of"), F.col("_part").eqNullSafe(F.col("_of")), "left")
    return both.select(*df.columns, *[(F.col(f"_l_{out}") + F.coalesce(f"_o_{out}", F.lit(0))).alias(out) for out in sums])


RADIX_BITS = 15


def smallest(df: DataFrame, value: Column, ranks: Sequence[int], bits: int = 60) -> list[int | None]:
    """The k-th smallest of a non-negative ``bits``-bit value, for every k of ``ranks`` (from 1; null beyond the rows).

    Selection by radix: each round counts the values that share the digits
    found so far by their next 15 bits.  No sort; a histogram has at most
    32,768 rows per rank.
    """
    rows = df.select(value.alias("v")).filter("v is not null")
    found = [0 if k >= 1 else None for k in ranks]  # digits so far
    left = list(ranks)
    for shift in range(bits - RADIX_BITS, -1, -RADIX_BITS):
        prefixes = sorted({x for x in found if x is not None})
        if not prefixes:
            break
        head = F.shiftright("v", shift + RADIX_BITS)
        digit = F.shiftright("v", shift).bitwiseAND((1 << RADIX_BITS) - 1)
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows.filter(head.isin(prefixes)).groupBy(head.alias("p"), digit.alias("d")).count().collect():
            counts.setdefault(r["p"], []).append((r["d"], r["count"]))
        for i, prefix in enumerate(found):
            if prefix is None:
                continue
            found[i] = None
            for d, n in sorted(counts.get(prefix, [])):
                if left[i] <= n:
                    found[i] = prefix << RADIX_BITS | d
                    break
                left[i] -= n
    return found
