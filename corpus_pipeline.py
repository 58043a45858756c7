"""Corpus pipeline: clean, dedup, mix and tokenise the documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.

1. quality rules: documents that the line labeller or the base rule rejects go;
2. line dedup: later copies of repeated line runs are cut out of the texts;
3. SimHash near-dedup: one document of every group stays;
4. mixing: one row per document, pass and shard that takes of it, with the
   text it takes, written by shard;
5. SentencePiece: ids, and digests of ids and decoded text.

Null ids, null and empty texts, repeated rows, empty tables and extra columns
pass through the stages as the operators' docstrings say; ``n_chars``, where
present, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm import line_runs, mixing, quality_crf, sentencepiece_codec, simhash
from tavola.llm.queries import tokenizer_path
from tavola.session import materialize_table


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the labeller, trained on the labelled documents, and the base rule keep."""
    field = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.keep_content(docs, field)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of repeated line runs; a document may be left empty."""
    return _measured(line_runs.dedup_lines(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, as documents, written shard by shard: the part that a shard's slots take of each."""
    mix = mixing.mixed_documents(docs, shards=True)
    return _measured(mix.repartition("shard").sortWithinPartitions("shard", "position").select("row.*"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes and the ids of every row."""
    return sentencepiece_codec.digests(docs, tokenizer_path(), keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

# A trained line labeller, XXH64 and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize_table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
