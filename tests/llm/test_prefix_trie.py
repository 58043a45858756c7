import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import same

from tavola.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """The trie of plain tuples."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = (role or "").encode(), (text or "").encode()
            tie = hashlib.md5(str(len(role)).encode() + b":" + role + text).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq = tuple(own.get(base, [])[:h] + turns[h:])
        ends.setdefault(seq, []).append(c)
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    children, leaves, savings = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p in members:
        for d in range(len(p) + 1):
            savings[p[:d]] += saved[p]
            leaves[p[:d]] += p not in children
    out = []
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], savings[p], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def chats():
    rnd = random.Random(5)
    pool = [f"text {i} " * (i % 4) + "é" * (i % 3) for i in range(6)]
    rows = []
    for c in range(-3, 90):
        if c % 11 == 0 and c:
            continue
        n = rnd.choice([0, 1, 2, 3, 5, 9, 14])
        rows += [(c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant"]), rnd.choice(pool) if rnd.random() < 0.7 else None) for t in range(n)]
    shared = [("user" if t % 2 == 0 else "assistant", f"long {t}") for t in range(60)]
    for c in (200, 201, 205, 206, 210):  # long shared beginnings
        rows += [(c, t, *x) for t, x in enumerate(shared[: 40 + c % 7])] + [(c, 100, "user", f"tail {c % 2}")] * (c % 3)
    rows += [(300, 1, "user", "same")] * 3 + [(300, None, None, None), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(c, t, "user", f"copy {t}") for c in range(400, 480) for t in range(4)]  # many copies
    rows += [(500 + c, 0, "system", "first") for c in range(60)] + [(500 + c, 1, "user", f"own {c}") for c in range(60)]
    rows += [(2**62, 0, "user", "x" * 200_000), (-(2**62), 0, "a", "bc"), (-(2**62), 1, "ab", "c")]
    return rows


@pytest.mark.parametrize("partitions", [1, 8])
def test_against_brute_force(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(chats(), SCHEMA)
        want = brute(chats())
        assert same(prefix_trie.trie(df).collect(), want)
        if partitions > 1:
            assert same(prefix_trie.trie(df.withColumns({c: F.lit("x") for c in ("depth", "s1", "code", "p", "place")}), sorted_turns=5).collect(), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_and_empty(spark):
    for rows in ([], [(None, 1, "user", "a")], [(1, 0, "user", "a")], [(3, 0, None, None)], chats()[:7]):
        assert same(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_findclose_against_a_stack():
    rnd = random.Random(2)
    for n in (1, 2, 5, 63, 64, 65, 500, 5000):
        for _ in range(20):
            depth = [rnd.randrange(4)]
            for _ in range(n - 1):
                depth.append(rnd.randrange(max(0, depth[-1] - rnd.choice([0, 1, 1, 40])), depth[-1] + 2))
            leaf = [i + 1 < n and depth[i + 1] <= depth[i] for i in range(n)]
            leaf[-1] = rnd.random() < 0.5
            tree = prefix_trie.Parentheses(np.array(depth), np.array(leaf))
            want, open_ = [-1] * n, []
            node = 0
            for at, bit in enumerate(tree.bits.tolist()):
                if bit == 1:
                    open_.append(node)
                    node += 1
                elif open_:
                    want[open_.pop()] = at
            assert tree.findclose().tolist() == want
            assert tree.pairs[-1] == sum(leaf)
