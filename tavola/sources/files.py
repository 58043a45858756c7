"""File sources and sinks.

CSV is read with every column as text, then typed with ``try_cast`` so that
malformed values become null instead of failing the job; the pandas null
tokens are mapped to null explicitly (Spark CSV knows one ``nullValue``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tavola.sources.csv_split import read_csv_split

# Text tokens read as null (the pandas CSV reader's default set).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header CSV, quoted multi-line fields, all columns as text, null tokens -> null; a file is read by many tasks."""
    df = read_csv_split(spark, path)
    tokens = F.array(*[F.lit(t) for t in NULL_TOKENS])
    return df.select(
        *[
            F.when(F.array_contains(tokens, F.col(f"`{c}`")), F.lit(None).cast("string")).otherwise(F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ]
    )


def type_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Type text columns with ``try_cast`` (unparsable -> null, like a coercing reader)."""
    return df.withColumns({c: F.trim(F.col(c)).try_cast(t) for c, t in types.items() if c in df.columns})


def read_listings(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Scan, trim headers / apply aliases, type columns, derive missing log columns."""
    from tavola.operators import warehouse

    df = warehouse.normalize_header(read_csv_text(spark, path), aliases)
    if types:
        df = type_columns(df, types)
    return warehouse.derive_missing(df)


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("country_code",)) -> None:
    """Prepared-table sink; parquet partitioned by country (partition pruning later), or CSV with header."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.partitionBy(*partition_by).parquet(path)


def write_results(tables: Mapping[str, DataFrame], directory: str, fmt: str = "csv") -> None:
    """One output folder per report table (CSV with header, or parquet)."""
    for name, t in tables.items():
        out = t
        if fmt == "csv":
            out = t.select(*[F.col(f.name).cast("string") if not isinstance(f.dataType, StringType) else F.col(f.name) for f in t.schema.fields])
            out.write.mode("overwrite").option("header", True).csv(f"{directory.rstrip('/')}/{name}")
        else:
            t.write.mode("overwrite").parquet(f"{directory.rstrip('/')}/{name}")


def prediction_sample(preds: DataFrame, vocab: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` test rows (by row id): true and predicted labels joined with ``", "``.

    ``preds`` is the long ``(row_id, label_idx, truth, pred)`` table; the row
    cut is taken first (top-n ids), so only n rows are expanded.
    """
    ids = preds.select("row_id").distinct().orderBy("row_id").limit(n)
    j = preds.select("row_id", "label_idx", "truth", "pred").join(ids, "row_id").join(vocab, "label_idx")
    return j.groupBy("row_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("truth") == 1, F.col("label")))), ", ").alias("actual"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("pred") == 1, F.col("label")))), ", ").alias("predicted"),
    )
