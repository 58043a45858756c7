import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import awkward, clashing, same, table, words

from tavola.llm import line_runs


def brute(rows):
    """Every start with the longest power-of-two prefix that stands earlier, and how long it goes on like its first place."""
    seqs = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        seqs.append((lines, [i for i, x in enumerate(lines) if words(x)]))
    place = lambda k, p: (rows[k][0] is None, rows[k][0] or 0, p)
    text = [tuple(lines[i] for i in at) for lines, at in seqs]
    home = {}
    for k, t in enumerate(text):
        for p in range(len(t)):
            m = 1
            while p + m <= len(t):
                home[t[p : p + m]] = min(home.get(t[p : p + m], (place(k, p), k, p)), (place(k, p), k, p))
                m *= 2
    out = []
    for k, (lines, at) in enumerate(seqs):
        gone, longest, t = set(), 0, text[k]
        for p in range(len(t)):
            m, best = 1, None
            while p + m <= len(t):
                first = home[t[p : p + m]]
                best = first if first[0] != place(k, p) else best
                m *= 2
            if best:
                other, q, n = text[best[1]], best[2], 0
                while p + n < len(t) and q + n < len(other) and t[p + n] == other[q + n]:
                    n += 1
                gone |= set(range(p, p + n))
                longest = max(longest, n)
        cut = {at[p] for p in gone}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in cut)
        out.append((rows[k][0], len(at), len(cut), sum(p - 1 not in gone for p in gone), longest, kept))
    return out


def repeated_rows():
    rnd = random.Random(11)
    pool = [" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([1, 2, 4, 12]))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = [rnd.choice(pool) if rnd.random() < 0.7 else f"own {i} {j}" for j in range(rnd.randrange(0, 25))]
        if rnd.random() < 0.3:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(lines), "en", "a", 1))
    rows.append((60, "\n".join(["same line"] * 300), "en", "a", 1))
    rows.append((61, rows[3][1], "en", "a", 1))
    return rows


def test_against_brute_force(spark):
    assert same(line_runs.report(table(spark, repeated_rows())).collect(), brute(repeated_rows()))


def test_awkward_rows(spark):
    df = clashing(table(spark), "row", "id", "at", "kept", "gone", "places")
    assert same(line_runs.report(df).collect(), brute(awkward()))
    out = line_runs.dedup_lines(df)
    assert out.columns == df.columns
    want = {(r[0], t[5]) for r, t in zip(awkward(), brute(awkward()))}
    assert {(r.doc_id, r.text or "") for r in out.collect()} == want
    assert line_runs.report(table(spark, [])).collect() == []


def test_whole_runs_go(spark):
    """Tails of runs and short lines go too."""
    a, b, c = "one two three four five six seven eight nine ten eleven twelve", "b b b b", "c c c"
    rows = [(1, f"{a}\n{b}\n{c}\nfirst", "en", "a", 1), (2, f"{a}\n{b}\n{c}\nsecond", "en", "a", 1)]
    rows += [(10 + i, f"own {i}\nall of us share this", "en", "a", 1) for i in range(500)]
    got = {r.doc_id: r for r in line_runs.report(table(spark, rows)).collect()}
    assert got[2].text == "second" and (got[2].n_removed, got[2].n_runs, got[2].longest_run) == (3, 1, 3)
    assert sum(r.text.endswith("this") for r in got.values()) == 1 and got[10].n_removed == 0


def test_suffix_ranks_order_suffixes(spark):
    rows = repeated_rows()
    lines = line_runs.line_sequences(table(spark, rows), "doc_id", "text")
    levels = line_runs.suffix_ranks(lines)
    ids = {}
    for r in lines.collect():
        ids.setdefault((r.id, r.text_hash), {})[r["at"]] = bytes(r.line_id)
    assert len(levels) >= 9  # 300 equal lines
    for j, level in enumerate(levels):
        got = level.collect()
        prefix = lambda r: tuple(ids[(r.id, r.text_hash)][r["at"] + i] for i in range(1 << j))
        by = sorted((r["rank"], prefix(r)) for r in got)
        assert all((a[0] == b[0]) == (a[1] == b[1]) and a[1] <= b[1] for a, b in zip(by, by[1:]))
