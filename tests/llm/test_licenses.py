import os
import random
import re
import sys
import textwrap

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import ASCII_LOWER, awkward, clashing, prose, same, table

from tavola.llm import licenses as C


def brute(text):
    best, hit = None, set()
    units = [text or "", *(text or "").split("\n")]
    for unit, part in enumerate(units):
        own = re.findall("[a-z0-9]+", part.translate(ASCII_LOWER))
        grams = set(zip(own, own[1:]))
        for name, template in C.TEMPLATES.items():
            other = {tuple(g.split()) for g in C.bigrams_of(template)}
            dice = 2.0 * len(grams & other) / (len(grams) + len(other)) if grams else 0
            if dice >= C.THRESHOLD:
                hit.add(unit)
                best = min(best or (0, 0, ""), (-dice, unit, name))
    return (best[2], -best[0], best[1], len(hit)) if best else (None, None, None, 0)


def test_against_brute_force(spark):
    rnd = random.Random(6)
    rows = awkward()
    for i, t in enumerate(C.TEMPLATES.values()):
        own = t.split()
        own[rnd.randrange(len(own))] = "changed"
        rows.append((300 + i, f"Some text first\n{t}\n{' '.join(own)}", "en", "a", 1))
        rows.append((400 + i, t.upper().replace(" ", "  \t"), "en", "a", 1))
    got = C.scan(clashing(table(spark, rows), "units", "hits", "license")).collect()
    assert same(got, [(r[0], *brute(r[1])) for r in rows])
    assert C.scan(table(spark, [])).collect() == []


def test_size_bounds_lose_no_match():
    for size in range(1, 60):
        low, high = C.admissible(size, C.THRESHOLD)
        for n in range(1, 200):
            reachable = 2 * min(n, size) / (n + size) >= C.THRESHOLD - 1e-12
            assert reachable == (low <= n <= high)


def wrapped(text, width=78):
    return "\n".join(textwrap.wrap(" ".join(text.split()), width))


def test_wrapped_and_embedded_licences(spark):
    rnd = random.Random(8)
    other = "\n".join(prose(rnd, 11) for _ in range(400))
    want = {"MIT": C.TEXTS["MIT"], "ISC": C.TEXTS["ISC"], "GPL-3.0": C.TEXTS["GPL-3.0"], "GPL-3.0 header": C.TEMPLATES["GPL-3.0 header"], "BSD conditions": C.TEMPLATES["BSD conditions"], "BSD-3-Clause": C.TEXTS["BSD-3-Clause"]}
    rows = []
    for name, text in want.items():
        rows.append((name + " wrapped", wrapped(text), "en", "a", 1))
        rows.append((name + " embedded", f"{other}\n{wrapped(text)}\n{other}", "en", "a", 1))
        rows.append((name + " in one line", f"{' '.join(other.split())} {' '.join(text.split())} {other}", "en", "a", 1))
    rows.append(("MIT published", "MIT License\n\nCopyright (c) 2018 A. Holder\n\n" + wrapped(C.TEXTS["MIT"]), "en", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r for r in C.scan(docs).collect()}
    for name in want:
        for how, unit in (("wrapped", 0), ("embedded", 401), ("in one line", 1)):
            r = got[f"{name} {how}"]
            assert (r.license, r.dice, r.unit, r.n_units) == (name, 1.0, unit, 1)
    assert got["MIT published"].license == "MIT" and got["MIT published"].unit == 0


def bounded(own, other):
    """Whether the window begins and ends with bigrams of the template, the first of them not all coming again."""
    pairs = list(zip(own, own[1:]))
    n = next((i for i, p in enumerate(pairs) if p not in other), len(pairs))
    return pairs[-1] in other and not set(pairs[:n]) <= set(pairs[n:])


def test_blocks_reach_the_best_window():
    """Against every bounded window of words that runs over a line's end or lies in a line too long for the template."""
    rnd = random.Random(9)
    hits = 0
    for n in range(1500):
        template = ["a b c d e f", "c d a a b", "e e f"][n % 3]
        other = set(zip(template.split(), template.split()[1:]))
        dice = lambda w: 2.0 * len(set(zip(w, w[1:])) & other) / (len(set(zip(w, w[1:]))) + len(other))
        parts = [rnd.choice([template, template[:5], template[4:], "x", "a b", "y z"]) for _ in range(rnd.randrange(2, 9))]
        lines = [x.split() for x in "".join(c if c != " " or rnd.random() < 0.8 else "\n" for c in " ".join(parts)).split("\n")]
        own, at = [w for x in lines for w in x], [i for i, x in enumerate(lines) for _ in x]
        units = [dice(x) for x in [own, *lines]]
        best = max([d for d in units if d >= C.THRESHOLD], default=None)
        if units[0] < C.THRESHOLD:
            long = [len(set(zip(x, x[1:]))) > C.admissible(len(other), C.THRESHOLD)[1] and d < C.THRESHOLD for x, d in zip(lines, units[1:])]
            found = [dice(own[i : j + 1]) for i in range(len(own)) for j in range(i + 1, len(own)) if (at[i] < at[j] or long[at[i]]) and bounded(own[i : j + 1], other)]
            found = [d for d in found if d >= C.THRESHOLD]
            hits += bool(found) and max(found) > (best or 0)
            best = max(found + [best or 0]) or None
        got = C.Scanner({"T": template}, C.THRESHOLD).scan("\n".join(map(" ".join, lines)))
        assert got[1] == best and (got[3] > 0) == (best is not None), lines
    assert hits > 100


def test_unlike_text_meets_no_template():
    rnd = random.Random(10)
    text = "\n".join(prose(rnd, 30) + " all rights of the holders, reserved" for _ in range(50))
    assert C.Scanner(C.TEMPLATES, C.THRESHOLD).scan(text) == (None, None, None, 0)
