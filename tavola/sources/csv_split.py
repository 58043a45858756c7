"""Quoted CSV with multi-line fields, cut into records in parallel.

A reader that must see whole files to find record ends reads a file in one
task.  Here every file block is read by its own task, line by line; whether a
block begins inside a quoted field is the parity of the quotes before it:

1. each block counts its quotes;
2. running sums over the blocks of a file give the parity at every block's begin;
3. each block joins its lines to records; what its first and last lines share
   with the neighbouring blocks is put together by (file, record);
4. Spark's own ``from_csv`` parses the records.

Files follow RFC 4180: a field with a separator, a quote or a line end is
quoted, and quotes inside it are doubled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

WHOLE, TAIL, MIDDLE, HEAD = range(4)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _records(batches: Iterator[pa.RecordBatch], odd: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, text, first): whole records, and the parts of records that cross a block's ends.

    A block's lines come in order, one block after the other.  ``first`` marks
    what begins at the begin of its file.
    """
    here, held, inside, head, opened = None, [], False, False, False
    out: list[tuple] = []

    def emit(kind: int) -> None:
        nonlocal held
        if held:
            out.append((*here, kind, "\n".join(held), opened))
        held = []

    def end_block() -> None:
        if here is not None and held:
            emit(MIDDLE if head else TAIL)

    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != here:
                end_block()
                here, inside = (file, block), (file, block) in odd
                head, opened = inside, block == 0
            held.append(line)
            if line.count('"') % 2:
                inside = not inside
            if not inside:
                emit(HEAD if head else WHOLE)
                head = opened = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))], ["file", "block", "kind", "text", "first"])
            out = []
    end_block()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))], ["file", "block", "kind", "text", "first"])


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(text, first): one row per record; ``first`` marks the first record of a file."""
    lines = _lines(spark, path)
    quotes = lines.groupBy("file", "block").agg(F.sum(F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = quotes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One entry per file block that begins inside a field: a few bytes per block of the input.
    odd = spark.sparkContext.broadcast({(r["file"], r["block"]) for r in begins.filter("before % 2 = 1").select("file", "block").collect()})
    found = lines.mapInArrow(lambda batches: _records(batches, odd.value), "file long, block long, kind int, text string, first boolean")
    parts = found.filter(F.col("kind") != WHOLE)
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("block", F.col("kind").desc()))
    crossing = parts.withColumn("record", number).groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.negative("kind").alias("order"), "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("first").alias("first")
    )
    return found.filter(F.col("kind") == WHOLE).select("text", "first").unionByName(crossing.select("text", "first"))


def read_csv_split(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header CSV with every column as text, an empty unquoted field as null; one file is read by as many tasks as it has blocks."""
    names = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
    schema = ", ".join(f"`{n}` STRING" for n in names)
    records = csv_records(spark, path).filter("not first").select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text <> ''")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return records.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
