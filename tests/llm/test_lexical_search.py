import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import ASCII_LOWER, awkward, clashing, table

from tavola.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    """Every document scored for every item."""
    rows = [(d, Counter(TERM.findall((t or "").translate(ASCII_LOWER)))) for d, t in docs]
    rows = [(d, c) for d, c in rows if c]
    n_docs, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    out = []
    for item, text in items:
        asked, found = Counter(TERM.findall((text or "").translate(ASCII_LOWER))), []
        for d, c in rows:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in asked.items() if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(docs, items, **kw):
    return sorted(map(tuple, S.search(docs, items, **kw).collect()), key=repr)


def corpus(n, seed=4, words=300):
    rnd = random.Random(seed)
    word = lambda: f"w{min(int(rnd.expovariate(0.02)), words)}"
    rows = [(i, " ".join(word() for _ in range(rnd.choice([1, 5, 40, 200])))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(300)]  # many equal scores
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 30])))) for i in range(40)]
    items += [(100, rows[3][1]), (101, None), (102, "no such thing"), (103, "W1 w1 w1, w2!"), (None, "w5 w6"), (103, "w7")]
    return rows, items


ITEM = "item_id bigint, text string"


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(1500)
    want = brute(docs, items)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEM)
    assert run(d, i) == want
    monkeypatch.setattr(S, "ITEMS", 7)
    assert run(d.repartition(2), i, k=3) == brute(docs, items, 3)


def test_awkward_rows(spark):
    rows = awkward()
    items = [(1, rows[0][1]), (2, "éa ÄÖ one"), (3, ""), (4, None), (5, "w1 w2 tail")]
    want = brute([(r[0], r[1]) for r in rows], items)
    df = clashing(table(spark), "n", "terms", "counts", "item", "score")
    assert run(df, spark.createDataFrame(items, ITEM).withColumn("rank", F.lit(1))) == want
    assert run(table(spark, []), spark.createDataFrame(items, ITEM)) == []
    assert run(df, spark.createDataFrame([], ITEM)) == []


def segment(docs, items, values=None):
    """A segment over numbered terms, and the items' (terms, weights)."""
    terms_ = 1 + max(t for d in docs for t in d)
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.array([t for d in docs for t in sorted(d)], np.int64)
    values = np.array([d[t] for d in docs for t in sorted(d)], np.int64)
    block = S.Items([(np.array(sorted(q), np.int64), np.array([q[t] for t in sorted(q)], np.int64)) for q in items], terms_)
    return S.Segment(np.arange(len(docs)), sizes, flat, values, block)


def test_bounds_hold_with_few_summary_terms_and_long_documents(monkeypatch):
    monkeypatch.setattr(S, "SUMMARY_TERMS", 3)
    monkeypatch.setattr(S, "LONG_DOCUMENT", 30)
    monkeypatch.setattr(S, "BLOCK_DOCS", 8)
    rnd = random.Random(9)
    for _ in range(20):
        docs = [{rnd.randrange(60): rnd.randrange(1, 100) for _ in range(rnd.choice([1, 3, 10, 50]))} for _ in range(400)]
        items = [{rnd.randrange(60): rnd.randrange(1, 9) for _ in range(rnd.choice([1, 5, 25]))} for _ in range(6)]
        items = [{t: w for t, w in q.items() if any(t in d for d in docs)} or {next(iter(docs[0])): 1} for q in items]
        s = segment(docs, items)
        for i, q in enumerate(items):
            top = S.Top(10)
            s.search(i, top, np.zeros(s.items.terms, np.int64))
            scores = [(-sum(w * d.get(t, 0) for t, w in q.items()), j) for j, d in enumerate(docs)]
            assert list(zip((-top.scores).tolist(), top.ids.tolist())) == sorted(x for x in scores if x[0] < 0)[:10]


def test_blocks_are_skipped():
    """Documents of one topic go without those of the others being scored."""
    rnd = random.Random(1)
    docs = []
    for i in range(4000):
        topic = i % 20
        docs.append({0: 1 + rnd.randrange(3)} | {1 + topic * 10 + rnd.randrange(10): rnd.randrange(50, 60) for _ in range(6)})
    docs = [{200 - t if t else 201: v for t, v in d.items()} for d in docs]
    s = segment(docs, [{t: 5 for t in (*range(191, 201), 201)}])
    top = S.Top(10)
    scored = s.search(0, top, np.zeros(s.items.terms, np.int64))
    assert len(top.ids) == 10 and scored < 1000
