"""The merged store and the splittable CSV reader."""

import csv
import os
import random

from pyspark.sql import functions as F

from tavola.sources import csv_split, files, store


def listings(spark, rows):
    return spark.createDataFrame(rows, "listing_id long, votes long, city string")


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_merge_touches_only_parts_with_incoming_ids(spark, tmp_path):
    path, t0, t1 = str(tmp_path / "store"), F.lit("2020-01-01").cast("timestamp"), F.lit("2021-01-01").cast("timestamp")
    old = [(i, i * 10, "a") for i in range(500)]
    store.write_store(listings(spark, old).withColumns({"created_at": t0, "updated_at": t0}), path, parts=16)
    before = files_of(path)
    new = [(3, 1, "b"), (3, 2, "b"), (700, 5, None), (700, 5, None)]
    touched = store.merge_store(spark, path, listings(spark, new), t1, parts=16)
    after = files_of(path)
    assert 1 <= len(touched) <= 2
    for f, time in before.items():
        if not any(f"{store.PART}={p}{os.sep}" in f for p in touched):
            assert after[f] == time
    got = {r.listing_id: (r.votes, r.city, r.created_at.year, r.updated_at.year) for r in store.read_store(spark, path).collect()}
    want = {i: (v, c, 2020, 2020) for i, v, c in old} | {3: (2, "b", 2020, 2021), 700: (5, None, 2021, 2021)}
    assert got == want
    assert store.merge_store(spark, path, listings(spark, []), t1, parts=16) == []
    store.merge_store(spark, path, listings(spark, new), t1, parts=16)  # again: the same store
    assert {r.listing_id: r.votes for r in store.read_store(spark, path).collect()} == {k: v[0] for k, v in want.items()}


def random_rows(n, seed):
    rnd = random.Random(seed)
    pieces = ["a", "b c", '"', '""', "\n", "\n\n", ",", "é", "x" * 40, "\r\n", "'", ""]
    return [[str(i), "".join(rnd.choice(pieces) for _ in range(rnd.randrange(9))), "".join(rnd.choice(pieces) for _ in range(rnd.randrange(3)))] for i in range(n)]


def test_records_are_cut_like_python_s_reader(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for k, size in enumerate(("7", "100", "4096", "134217728")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            n = 60 if size == "7" else 900
            folder = tmp_path / str(k)
            folder.mkdir()
            rows = [random_rows(n, 10 * k + i) for i in range(2)]
            for i, part in enumerate(rows):
                with open(folder / f"{i}.csv", "w", newline="") as f:
                    w = csv.writer(f, lineterminator="\n" if i else "\r\n")
                    w.writerow(["id", "text", "more"])
                    w.writerows(part)
            df = csv_split.read_csv_split(spark, str(folder))
            assert df.columns == ["id", "text", "more"]
            clean = lambda x: x or None
            got = sorted(((r.id, clean(r.text), clean(r.more)) for r in df.collect()), key=repr)
            want = sorted(((a, clean(b), clean(c)) for part in rows for a, b, c in part), key=repr)
            assert got == want
            if size == "100":
                assert csv_split._lines(spark, str(folder / "0.csv")).select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_null_tokens_and_types_as_before(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow([" Name ", "votes"])
        w.writerows([["a\nb", "1"], ["NaN", "x"], ['q"q', ""]])
    df = files.read_csv_text(spark, path)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("a\nb", "1"), (None, "x"), ('q"q', None)], key=repr)
