import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import xxhash
from llm_fixtures import ASCII_LOWER, awkward, clashing, prose, same, table, words

from tavola.llm import simhash
from tavola.llm.components import components


def fingerprint(text):
    own = words((text or "").translate(ASCII_LOWER))
    if not own:
        return 0
    hashes = [xxhash.xxh64(" ".join(own[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(own) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, budget=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= budget:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute(rows):
    prints = [fingerprint(r[1]) for r in rows]
    kind = classes(sorted(set(prints)))
    low = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            low[kind[p]] = min(low.get(kind[p], r[0]), r[0])
    return [(r[0], f"{p:016x}", low.get(kind[p])) for r, p in zip(rows, prints)]


def test_against_brute_force(spark):
    assert same(simhash.simhash_components(table(spark)).collect(), brute(awkward()))


def clustered(rnd, clusters):
    out = set()
    for _ in range(clusters):
        base = rnd.getrandbits(64)
        for k in range(rnd.choice([1, 2, 5, 40])):
            x = base
            for _ in range(rnd.randrange(9)):
                x ^= 1 << rnd.randrange(64 if k % 3 else 20)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def test_trie_join_links_every_pair_even_when_nodes_are_split(spark):
    rnd = random.Random(5)
    for node_rows in (simhash.NODE_ROWS, 16):
        values = clustered(rnd, 15)
        links = simhash.trie_links(spark.createDataFrame([(v,) for v in values], "fp bigint"), node_rows=node_rows)
        assert links.count() <= 5 * 2 * len(values) * 16  # forests, not pairs
        got = {r.node: r.component for r in components(links).collect()}
        want = classes(values)
        assert all(got.get(v, v) == want[v] for v in values)


def test_prefix_budgets_miss_no_pair():
    rnd = random.Random(2)
    starts = simhash.block_starts(4)
    for _ in range(2000):
        flips = rnd.sample(range(64), 4)
        ok = False
        for i, s in enumerate(starts):
            allowed = simhash._allowed(4, i)
            at = [(f - s) % 64 for f in flips]
            ok |= all(sum(a < d for a in at) <= allowed[d] for d in range(65))
        assert ok


def test_representatives_keep_one_row_of_each_group(spark):
    rows = awkward()
    got = simhash.representatives(clashing(table(spark, rows), "fp", "row", "id", "text_key", "key_id")).collect()
    group = {}
    for r, b in zip(rows, brute(rows)):
        group.setdefault(b[2], []).append(r)
    assert len(got) == len(group)
    assert {r.doc_id for r in got} == set(group)


def test_components_of_chains_and_empty(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert simhash.simhash_components(table(spark, [])).collect() == []


def test_components_with_clashing_columns(spark):
    names = ("fp", "fingerprint", "component_id", "node", "component", "a", "b", "u", "v", "row", "id")
    key = lambda df: sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())
    assert key(simhash.simhash_components(clashing(table(spark), *names))) == key(simhash.simhash_components(table(spark)))
