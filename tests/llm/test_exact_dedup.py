import hashlib
import sys
import os

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import ASCII_LOWER, awkward, clashing, same, table
from pyspark.sql import functions as F

from tavola.llm.exact_dedup import exact_groups


def brute(rows, keep):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(ASCII_LOWER), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        kept = keep(known) if known else None
        out += [(i, kept, len(ids), i == kept, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def test_against_brute_force(spark):
    for name, keep in (("max", max), ("min", min)):
        assert same(exact_groups(table(spark), keep=name).collect(), brute(awkward(), keep))


def test_bytes_decide_under_a_colliding_hash(spark):
    got = exact_groups(table(spark), keep="max", hash_of=lambda norm: F.lit(b"x"))
    assert same(got.collect(), brute(awkward(), max))


def test_clashing_columns_and_empty_table(spark):
    df = clashing(table(spark), "_hash", "_norm", "keep_id", "kept", "group_size")
    assert same(exact_groups(df, keep="max").collect(), brute(awkward(), max))
    assert exact_groups(table(spark, [])).collect() == []


def test_very_long_texts(spark):
    long = "Wörd X " * 400_000
    rows = [(1, long, None, None, None), (2, long.translate(ASCII_LOWER), None, None, None), (3, long + "y", None, None, None)]
    assert same(exact_groups(table(spark, rows), keep="max").collect(), brute(rows, max))
