import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import awkward, clashing, prose, same, table, words

from tavola.llm import debruijn as D


def brute(rows):
    home, found = {}, []
    for k, r in enumerate(rows):
        own = words(r[1])
        for p in range(len(own) - D.WINDOW + 1):
            key, place = tuple(own[p : p + D.WINDOW]), (r[0] is None, r[0] or 0, p)
            found.append((k, p, key, place))
            home[key] = min(home.get(key, place), place)
    gone = [set() for _ in rows]
    for k, p, key, place in found:
        if place != home[key]:
            gone[k] |= set(range(p, p + D.WINDOW))
    out = []
    for r, g in zip(rows, gone):
        own = words(r[1])
        out.append((r[0], len(own), len(g), " ".join(w for i, w in enumerate(own) if i not in g)))
    return out


def planted():
    """Passages shared in whole and in part, self-repeats, periods, and runs that end at a document's border."""
    rnd = random.Random(4)
    passages = [prose(rnd, n, 30) for n in (20, 21, 35, 60, 150)]
    rows = []
    for i in range(70):
        parts = [prose(rnd, rnd.randrange(0, 60), 30)]
        for _ in range(rnd.randrange(3)):
            own = words(rnd.choice(passages))
            a, b = sorted((rnd.randrange(len(own) + 1), rnd.randrange(len(own) + 1)))
            parts += [" ".join(own if rnd.random() < 0.5 else own[a:b]), prose(rnd, rnd.randrange(0, 20), 30)]
        rows.append((1000 - i, " ".join(parts), "en", "a", 1))
    rows.append((3, "x " * 200, "en", "a", 1))
    rows.append((4, "x y " * 60 + passages[4] + " " + passages[4], "en", "a", 1))
    rows.append((5, passages[4], "en", "a", 1))
    return rows


def test_against_brute_force(spark):
    assert same(D.dedup_windows(table(spark, planted())).collect(), brute(planted()))


def test_awkward_rows(spark):
    df = clashing(table(spark), "bytes", "id", "at", "home", "spans", "kept")
    assert same(D.dedup_windows(df).collect(), brute(awkward()))
    assert D.dedup_windows(table(spark, [])).collect() == []


def test_paths_are_disjoint_and_repeated(spark):
    rows = planted()
    paths = D.repeated_paths(table(spark, rows)).collect()
    count = {}
    for r in rows:
        own = words(r[1])
        for p in range(len(own) - D.WINDOW + 1):
            key = tuple(own[p : p + D.WINDOW])
            count[key] = count.get(key, 0) + 1
    text = {r[0]: words(r[1]) for r in rows}
    seen = set()
    for path in paths:
        for p in range(path["at"], path["at"] + path["windows"]):
            key = tuple(text[path["id"]][p : p + D.WINDOW])
            assert count[key] == path["occurrences"] > 1 and key not in seen
            seen.add(key)
    assert seen == {k for k, n in count.items() if n > 1}
    assert max(p["windows"] for p in paths) > 20


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(9)
    shared = [w.encode() for w in words(prose(rnd, 40))]
    found = []
    for n in (0, 7, 33):
        own = [w.encode() for w in words(prose(rnd, n))] + shared + [w.encode() for w in words(prose(rnd, n))]
        edges, first, size, anchors = D.super_edges(own)
        assert size.sum() == len(edges) == len(own) - D.WINDOW + 1
        per = {int(e): int(a) for f, s, a in zip(first, size, anchors) for e in edges[f : f + s]}
        found.append({e: per[e] for e in map(int, edges[n : n + len(shared) - D.WINDOW + 1])})
    assert found[0] == found[1] == found[2]
