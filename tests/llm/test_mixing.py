import hashlib
import math
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import awkward, clashing, prose, same, table, words
import random

from tavola.llm import mixing


def brute(rows):
    """The mix by plain loops: targets by repeated sharing, blocks, permutation, uses."""
    size = [len(words(r[1])) for r in rows]
    sources = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(n for r, n in zip(rows, size) if r[3] == s) for s in sources}
    share, capped = 1.5 * sum(total.values()), set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (share - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * total[s]}
        if not above:
            break
        capped |= above
    target = {s: 2.0 * total[s] if s in capped else level * weight[s] for s in sources}
    buckets = mixing.buckets_of(len(rows))
    key = [hashlib.md5(f"{'' if r[0] is None else r[0]}:{n}:{r[1] or ''}".encode()).hexdigest() for r, n in zip(rows, size)]
    n_blocks = {s: -(-total[s] // mixing.BLOCK_WORDS) for s in sources}
    n_slots = {s: math.floor(target[s] * n_blocks[s] / total[s] + 0.5) if total[s] else 0 for s in sources}
    shards = max(1, -(-sum(n_slots.values()) // mixing.SLOTS_PER_SHARD))
    out = []
    for o, s in enumerate(sources):
        own = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (int(key[i][:8], 16) % buckets, key[i]))
        blocks = n_blocks[s]
        uses = [[] for _ in range(blocks)]
        for slot in range(n_slots[s]):
            x, k = slot % blocks, o * 2 + slot // blocks
            for shift, factor, addend in mixing.round_keys():
                partner = ((shift + k * 40_503) % blocks - x + blocks) % blocks
                if (((max(x, partner) % mixing.PRIME) * factor + addend + k * 69_069) % mixing.PRIME) // 65_536 % 2:
                    x = partner
            uses[x].append(int(hashlib.md5(f"{mixing.SHARD_SEED}:{o}:{slot}".encode()).hexdigest()[:8], 16) % shards)
        at = 0
        for i in own:
            taken = sum(len(uses[(at + j) // mixing.BLOCK_WORDS]) for j in range(size[i]))
            where = {x for j in range(size[i]) for x in uses[(at + j) // mixing.BLOCK_WORDS]}
            out.append((rows[i][0], size[i], total[s], target[s], taken, ",".join(map(str, sorted(where)))))
            at += size[i]
    return out


def test_against_brute_force(spark, monkeypatch):
    assert same(mixing.mix_sources(table(spark)).collect(), brute(awkward()))
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 8)
    assert same(mixing.mix_sources(table(spark)).collect(), brute(awkward()))


def test_buckets_are_even_whatever_the_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, F.col("id") * 201).alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), mixing.word_count(F.col("text")).cast("string"), "text"))
    bucket = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % mixing.buckets_of(40_000)).alias("b")
    sizes = sorted(r["count"] for r in docs.groupBy(bucket).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert sum(r.taken for r in mixing.mix_sources(docs).collect()) <= 2 * 80_000


def test_bounds_and_targets(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, rnd.randrange(0, 900)), "en", f"s{min(i % 9, 4)}", 1) for i in range(300)]
    got = mixing.mix_sources(table(spark, rows)).collect()
    assert same(got, brute(rows))
    assert all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    assert all(abs(t[0] - target) <= mixing.BLOCK_WORDS for (_, target), t in by.items())


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 97, 1000):
        df = spark.range(n).selectExpr("id as i", f"{n}L as n", "5L as k")
        assert sorted(r.p for r in mixing.permuted(df, "i", "n", "k", "p").collect()) == list(range(n))


def test_shards_hold_every_slot(spark):
    placed, per = mixing.streams(table(spark))
    slots = mixing.output_slots(placed, per)
    assert slots.count() == per.agg({"slots": "sum"}).first()[0] == mixing.shard_counts(slots).agg({"slots": "sum"}).first()[0]


def test_mixed_documents_hold_the_taken_words(spark):
    rows = [r for r in awkward()]
    got = mixing.mixed_documents(clashing(table(spark, rows), "ord", "at", "size", "pass"))
    assert got.columns == [*table(spark, []).columns, "ord", "at", "size", "pass"]
    taken = {}
    for r in mixing.mix_sources(table(spark, rows)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    have = {}
    for r in got.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(words(r.text))
    assert have == {k: v for k, v in taken.items() if v}


def test_empty_table(spark):
    assert mixing.mix_sources(table(spark, [])).collect() == []
    blank = [(1, None, None, "a", None), (2, "", None, None, None)]
    assert same(mixing.mix_sources(table(spark, blank)).collect(), [(1, 0, 0, 0.0, 0, ""), (2, 0, 0, 0.0, 0, "")])
    assert mixing.mixed_documents(table(spark, [])).collect() == []


def test_shards_are_drawn_at_random(spark):
    from pyspark.sql import functions as F

    n, shards = 50_000, 25
    for ord_ in (0, 3):
        drawn = spark.range(n).select(mixing.drawn_shard(F.lit(ord_), F.col("id"), shards).alias("shard")).groupBy("shard").count().collect()
        chi = sum((r["count"] - n / shards) ** 2 / (n / shards) for r in drawn)
        assert len(drawn) == shards and 7 < chi < 56  # 24 degrees of freedom; an even deal stays near 0


def test_mixed_documents_by_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 8)
    rows = [r for r in awkward()]
    df = clashing(table(spark, rows), "shard", "position", "slot")
    got = mixing.mixed_documents(df, shards=True).collect()
    taken = mixing.mixed_pieces(df)[1].groupBy("shard").agg({"words": "sum"}).collect()
    have, whole = {}, {}
    for r in got:
        have[r.shard] = have.get(r.shard, 0) + len(words(r.row.text))
        whole[r.row.doc_id] = whole.get(r.row.doc_id, 0) + len(words(r.row.text))
    assert len(have) > 3 and have == {r.shard: r["sum(words)"] for r in taken}
    want = {}
    for r in mixing.mixed_documents(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(words(r.text))
    assert whole == want
    assert len({(r.shard, r.position) for r in got}) == len(got)
