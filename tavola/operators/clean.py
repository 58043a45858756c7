"""Cleaning, repairs, imputation, projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tavola.functions import text as T
from tavola.functions.repairs import CURRENCY_TO_INR
from tavola.functions.stats import exact_medians, join_group_stats


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def replace_literals(df: DataFrame, pairs: Sequence[tuple[str, str]], cols: Sequence[str] | None = None) -> DataFrame:
    """Literal dictionary repair over every text column, in dictionary order (one projection)."""
    targets = set(cols if cols is not None else string_columns(df))
    return df.select(*[T.replace_literals(F.col(c), pairs).alias(c) if c in targets else F.col(c) for c in df.columns])


def strip_regex(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Remove every match of ``pattern`` from one column."""
    return df.withColumn(col, T.strip_regex(F.col(col), pattern))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant fill of nulls."""
    return df.fillna(dict(values))


def norm_text(df: DataFrame, cols: Sequence[str], default: str = "Unknown", trim: bool = True) -> DataFrame:
    """C4: null -> default, cast to text, trim."""
    return df.withColumns({c: T.norm_text(F.col(c), default, trim) for c in cols})


def to_number(df: DataFrame, cols: Sequence[str], dtype: str = "double") -> DataFrame:
    """Numeric coercion; unparsable values become null (``try_cast``)."""
    return df.withColumns({c: T.to_number(F.col(c), dtype) for c in cols})


def yes_no(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Normalise flags to exactly ``Yes`` / ``No``."""
    return df.withColumns({c: T.yes_no(F.col(c)) for c in cols})


def convert_currency(
    df: DataFrame,
    amount: str = "cost_for_two",
    currency: str = "currency",
    out: str = "average_cost_inr",
    rates: Mapping[str, float] = CURRENCY_TO_INR,
) -> DataFrame:
    """Amount x rate of its currency; currencies missing from the map give null.

    The map is a literal ``map`` expression (no join, no shuffle).
    """
    rate_map = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(float(v)))])
    return df.withColumn(out, F.col(amount) * rate_map[F.col(currency)])


def impute_zero_by_group(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """Replace zeros by the median of the group's non-zero values.

    Groups whose non-zero median is null (only zeros or nulls) keep their
    zeros; rows with a null key are unchanged.  Grouped aggregate + join back.
    """
    m = f"_median_nz_{col}"
    stats = exact_medians(df.filter(F.col(col) != 0), keys, col, m)
    out = join_group_stats(df, stats, keys)
    return out.withColumn(col, F.when((F.col(col) == 0) & F.col(m).isNotNull(), F.col(m)).otherwise(F.col(col))).drop(m)


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls with the column's global median.

    Each median is a scalar subquery over counted values, so no join and no
    single-partition window is needed.
    """
    return df.withColumns({c: F.coalesce(F.col(c), exact_medians(df, [], c, "m").select("m").scalar()) for c in cols})


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


# Columns each rating variant removes (identifiers, unused
# text, and columns derived from the target rating).
LEAKAGE_COLUMNS = {
    "base": ["listing_id", "listing_name", "address", "locality", "locality_verbose", "currency", "rating_color", "rating_text", "switch_to_order_menu", "rating_category", "restaurant_popularity_score"],
    "engineered": ["rating_color", "rating_text", "rating_category", "restaurant_popularity_score", "listing_id", "listing_name", "address", "locality_verbose", "currency", "switch_to_order_menu"],
    "without_votes": ["listing_id", "listing_name", "address", "locality", "locality_verbose", "currency", "rating_color", "rating_text", "switch_to_order_menu", "votes", "log_votes"],
    "onehot": ["rating_color", "rating_text", "rating_category", "restaurant_popularity_score", "listing_id", "listing_name", "address", "locality", "locality_verbose", "currency", "switch_to_order_menu"],
}


def drop_leakage(df: DataFrame, variant: str = "base") -> DataFrame:
    """Drop leakage / unused columns of a rating variant (absent ones are ignored)."""
    return df.drop(*LEAKAGE_COLUMNS[variant])
