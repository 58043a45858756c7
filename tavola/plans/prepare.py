"""Preparation flow: raw listings -> prepared listings (reference notebook order).

scan -> text repairs (one projection) -> fill cuisines -> currency -> two-level
zero imputation -> derived columns -> city quartiles -> geo clusters.  Every
step is lazy; the per-group statistics are grouped aggregates joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import text as T
from tavola.functions.repairs import REPAIRS_1, REPAIRS_2, REPAIRS_TURKISH
from tavola.operators import clean, features, geo
from tavola.session import materialize_table


def repair_text(df: DataFrame, name_col: str = "listing_name") -> DataFrame:
    """C1 + C2 in the reference order, as a single projection over all text columns."""
    cols = set(clean.string_columns(df))
    exprs = []
    for c in df.columns:
        if c not in cols:
            exprs.append(F.col(c))
            continue
        if c == name_col:
            e = T.replace_literals(F.col(c), REPAIRS_1 + REPAIRS_2)
            e = T.replace_literals(T.strip_regex(e, T.NAME_STRIP_PATTERN), REPAIRS_TURKISH)
        else:
            e = T.replace_literals(F.col(c), REPAIRS_1 + REPAIRS_2 + REPAIRS_TURKISH)
        exprs.append(e.alias(c))
    return df.select(*exprs)


def impute_costs(df: DataFrame) -> DataFrame:
    """C7 -> C8 -> C9."""
    out = clean.convert_currency(df)
    out = clean.impute_zero_by_group(out, "average_cost_inr", ["country_code", "city", "price_range"])
    return clean.impute_zero_by_group(out, "average_cost_inr", ["country_code", "price_range"])


def derive(df: DataFrame) -> DataFrame:
    """D1-D12 on the imputed table."""
    out = features.log_cost(df)
    out = features.cost_relative_to_city(out)
    out = features.city_cost_quartile(out)
    out = features.row_features(out)
    return features.city_restaurant_count(out)


def prepare(raw: DataFrame, clusters: bool = True, materialize: bool = True) -> DataFrame:
    """Prepared listings.  ``clusters=False`` leaves out D13-D15 (the
    importer then applies its defaults, as the reference does for a file
    without cluster columns)."""
    out = repair_text(raw)
    out = clean.fill(out, {"cuisines": "Unknown"})
    out = impute_costs(out)
    if materialize:
        # The imputed costs feed five grouped statistics; written once as a
        # table, so the upstream joins are not recomputed for each of them and
        # each reads its own columns only.
        out = materialize_table(out, "imputed")
    out = derive(out)
    if clusters:
        # Read by the cluster counts, the places and the rows themselves: written once, three columns for the rounds.
        out = materialize_table(out, "derived") if materialize else out
        out = geo.kmeans_by_city(out)
        out = features.city_cluster_key(out)
    return out
