"""Small documents with the awkward cases every operator must define, and plain-Python helpers."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, near copies."""
    rnd = random.Random(7)
    base = prose(rnd, 120)
    long = prose(rnd, 6000)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.upper(), "en", "b", 1),
        (4, base + " tail", "de", "b", 1),
        (5, None, None, None, None),
        (6, "", "en", "a", 0),
        (7, " \t\n ", "en", "a", 4),
        (8, "one", "fr", None, 3),
        (8, "one", "fr", None, 3),
        (9, long, "en", "c", 1),
        (10, prose(rnd, 40) + "\n" + base + "\n" + prose(rnd, 30), "en", "c", 1),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (11, "Éa b c ÄÖ d\u0085e", "de", "é", 9),
        (12, long + " more", "en", "c", 1),
    ]
    rows += [(100 + i, prose(rnd, rnd.randrange(1, 200)) + "\n" + prose(rnd, 12), "en" if i % 3 else "fr", "abc"[i % 3], 1) for i in range(25)]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(df, *names):
    """The same rows with extra columns of names that operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in names])


def same(a, b):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(a) == order(b)
