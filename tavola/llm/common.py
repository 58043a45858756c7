"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# ASCII white space: what separates words in every contract of this package.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text whose bytes equal its characters is ASCII, where ``lower`` does just
    that and is much cheaper than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null and empty texts have none."""
    pieces = F.size(F.split(text, SPACE_CLASS + "+", -1)).cast("long")
    edges = text.rlike("^" + SPACE_CLASS).cast("long") + text.rlike(SPACE_CLASS + r"\z").cast("long")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(pieces - edges)


def text_key(text: Column) -> Column:
    """64-bit hash of a text, null as empty: with the id, the key by which decisions find their rows again."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def id_key(docs: DataFrame, id_col: str) -> list[Column]:
    """(no_id, id): an id without nulls that sorts null ids last."""
    kind = docs.schema[id_col].dataType
    return [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("id")]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_key): whole rows as one column, so that their names meet no other names."""
    return docs.select(F.struct("*").alias("row")).select("row", F.col("row")[id_col].alias("id"), text_key(F.col("row")[text_col]).alias("text_key"))


def one_per_key(rows: DataFrame) -> DataFrame:
    """Of packed rows with equal id and text (null equals null) the least by content."""
    return rows.groupBy("id", "text_key").agg(F.min("row").alias("row")).select("row", "id", "text_key")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition of packed rows with a table of (key_id, key_text)."""
    return left["id"].eqNullSafe(right["key_id"]) & (left["text_key"] == right["key_text"])


def release(*tables: DataFrame) -> None:
    """Delete the files of scratch tables that nothing reads any more.

    Only folders that ``materialize_table`` made under the session's
    checkpoint folder go; a table that was merely persisted is unpersisted.
    """
    for t in tables:
        spark = t.sparkSession
        base = (ensure_checkpoint_dir(spark) or "").rstrip("/")
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        t.unpersist()
        for folder in folders:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            own = fs.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/tables"))
            if base and fs.makeQualified(path).getParent().equals(own):
                fs.delete(path, True)
