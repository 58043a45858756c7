"""Tokens, vocabulary and TF-IDF as relational plans (M1-M3).

TF-IDF is computed exactly (smooth idf ``ln((1+n)/(1+df)) + 1``, L2-normalised
rows) as joins and grouped aggregates over a long ``(doc, term, tf)`` table.
The idf table is joined without a hint: adaptive execution broadcasts it when
its measured size is small.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.functions.stats import group_rank
from tavola.functions.text import TOKEN_PATTERN
from tavola.session import cut_lineage

# Bytes of text dealt to one partition: its distinct terms fit the memory of a task.
TEXT_BYTES = 8 << 20

def _decompositions() -> dict[str, str]:
    """Characters and their compatibility decomposition without marks, where that differs, from the rule itself."""
    out = {}
    for code in (*range(0xA0, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):  # Hangul syllables stay whole
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain and plain != c:
            out[c] = plain
    return out


def _class_of(chars: str) -> str:
    """A character class of these characters, as code point ranges."""
    codes, ranges = sorted(map(ord, chars)), []
    for x in codes:
        if ranges and x == ranges[-1][1] + 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


_PLAIN = _decompositions()
# One character to one, inside the basic plane: by translate.  All others, ligatures and letters beyond it, by a map.
ACCENTED = "".join(c for c, p in _PLAIN.items() if len(p) == 1 and c <= "\uffff" and p <= "\uffff")
UNACCENTED = "".join(_PLAIN[c] for c in ACCENTED)
_RARE = {c: p.lower() for c, p in _PLAIN.items() if c not in set(ACCENTED)}
RARE_CLASS = _class_of("".join(_RARE))
# A few ranges that hold all of these: most texts need not be matched with the hundreds of ranges of the exact class.
NEAR_RARE_CLASS = _class_of([c for c in _RARE if c < "\u0100"] + [chr(x) for x in range(0x100, 0xD800)])[:-1] + "\\x{D800}-\\x{10FFFF}]"


def _rare(c: Column) -> Column:
    """Texts with a ligature or a letter beyond the basic plane, character by character through the map."""
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _RARE.items())), F.lit("\x01"), F.lit("\x02"))  # one literal, folded once
    letters = F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.when(c.rlike(NEAR_RARE_CLASS) & c.rlike(RARE_CLASS), F.array_join(letters, "")).otherwise(c)


def normalize(c: Column) -> Column:
    """Lower case without accents: marks that stand alone (or that lower-casing splits off) go, the rest is mapped."""
    low = F.lower(c)
    plain = F.regexp_replace(F.translate(_rare(low), ACCENTED, UNACCENTED), r"\p{M}+", "")
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(plain)


def tokens(c: Column) -> Column:
    """M1: lower-case, fold accents, extract runs of >= 2 letters/digits/underscore."""
    return F.regexp_extract_all(normalize(c), F.lit(TOKEN_PATTERN), 0)


def term_frequencies(df: DataFrame, id_col: str, text_col: str, n_max: int = 1, among: DataFrame | None = None) -> DataFrame:
    """M1: ``(doc_id, term, tf)`` counts (one row per distinct term of a document), of the terms in ``among`` only if given.

    Tokens are a built-in regex extraction; word n-grams come from Spark ML's
    ``NGram`` transformer (JVM code, no Python), one pass per n.
    """
    from pyspark.ml.feature import NGram

    # Hash-partition the documents (the raw text is smaller than the term
    # table it explodes into): the (doc, term) count and the per-document
    # norms downstream are then satisfied by this partitioning, so the term
    # rows are never shuffled.  As many partitions as the texts need, so that
    # the count of a partition's terms stays in memory and is not spilled.
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    size = docs.select(F.sum(F.octet_length(F.col("_text").cast("string")))).first()[0] or 0
    docs = docs.repartition(max(-(-size // TEXT_BYTES), df.sparkSession.sparkContext.defaultParallelism), "doc_id")
    tok = docs.select("doc_id", tokens(F.col("_text")).alias("_g1"))
    for n in range(2, n_max + 1):
        tok = NGram(n=n, inputCol="_g1", outputCol=f"_g{n}").transform(tok)
    grams = F.concat(*[F.col(f"_g{n}") for n in range(1, n_max + 1)]) if n_max > 1 else F.col("_g1")
    terms = tok.select("doc_id", F.explode(grams).alias("term"))
    if among is not None:
        terms = terms.join(among.select("term"), "term", "left_semi")
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("long").alias("tf"))


def fit_vocabulary(tf: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """M2: ``(term, df, cf, term_idx)``: document frequency >= ``min_df``, then the
    ``max_features`` most frequent terms (corpus count desc, term asc)."""
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).cast("long").alias("df"), F.sum("tf").cast("long").alias("cf"))
    stats = stats.filter(F.col("df") >= min_df)
    if max_features is not None:
        # Bounded by the parameter: per-partition top-k, merged (no global
        # sort).  Kept, since the ranking reads its rows twice.
        stats = cut_lineage(stats.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(int(max_features)))
    ranked = group_rank(stats.withColumn("_g", F.lit(0)), ["_g"], ["term"], rank_col="_rn")
    return ranked.select("term", "df", "cf", (F.col("_rn") - 1).cast("int").alias("term_idx"))


def fit_idf(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """Smooth idf of every vocabulary term over all fitted documents, those without a token included."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    return vocab.select("term", "term_idx", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """M3: ``(doc_id, term, term_idx, weight)`` with L2-normalised rows; out-of-vocabulary terms dropped."""
    w = tf.filter("doc_id is not null").join(idf, "term").select("doc_id", "term", "term_idx", (F.col("tf") * F.col("idf")).alias("w"))
    # A window holds the terms of one document; the term table is read once.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return w.select("doc_id", "term", "term_idx", (F.col("w") / norm).alias("weight"))


def vectorizer_stages(vocab_terms: list[str], idf_values: list[float], input_col: str = "tokens", output_col: str = "features"):
    """The same TF-IDF as JVM ML stages for model input (sparse vectors, no UDF).

    ``vocab_terms`` / ``idf_values`` come from :func:`fit_vocabulary` and
    :func:`fit_idf`; their size is bounded by ``max_features``.
    """
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    cv = CountVectorizerModel.from_vocabulary(vocab_terms, inputCol=input_col, outputCol=f"_{output_col}_tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf_values), inputCol=f"_{output_col}_tf", outputCol=f"_{output_col}_w")
    norm = Normalizer(p=2.0, inputCol=f"_{output_col}_w", outputCol=output_col)
    return [cv, scale, norm]
