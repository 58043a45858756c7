import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))
import numpy as np
from llm_fixtures import awkward, clashing, same, table

from tavola.llm import language_id as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    got = L.language_id(clashing(table(spark), "held_out", "score", "lang_pred")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in awkward())
    for r in got:
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == want
    by = {r.doc_id: r for r in got}
    assert by[5].lang_pred == by[6].lang_pred == by[7].lang_pred == "und" and by[5].score == 0
    assert by[1].lang_pred in ("en", "de", "fr")
    assert L.language_id(table(spark, [])).collect() == []
    unlabelled = L.language_id(table(spark, [(1, "some text", None, "a", 1)])).collect()
    assert same(unlabelled, [(1, False, "und", 0.0)])


def test_vectors_follow_the_definition():
    keys, counts = L.gram_counts("Abc ab!")
    text = " abc ab "
    want = {}
    for i in range(len(text) - 2):
        want[text[i : i + 3]] = want.get(text[i : i + 3], 0) + 1
    total = np.zeros(L.DIMENSIONS, np.int64)
    for gram, n in want.items():
        bound = np.ones(L.DIMENSIONS, np.int64)
        for place, letter in enumerate(gram):
            bound *= np.roll(L.letter_vector(ord(letter)), place)
        total += n * bound
    assert (L._bundle_exact((keys, counts)) == total).all()
    assert np.allclose(L.bundle([(keys, counts)])[0], total)


def test_texts_without_a_letter_have_no_grams():
    for text in (None, "", "  ", "123 _ \u00b2 !?", "\u0301"):
        assert len(L.gram_counts(text)[0]) == 0


def test_long_texts_are_counted_in_full(monkeypatch):
    text = "lorem ipsum dolor " * 300
    whole = L.gram_counts(text)
    monkeypatch.setattr(L, "BLOCK_CHARS", 64)
    parts = L.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def vector(text):
    """A text's bundle straight from the definition, for texts of ASCII letters and signs."""
    text = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    total = np.zeros(L.DIMENSIONS, np.int64)
    for i in range(len(text) - 2):
        bound = np.ones(L.DIMENSIONS, np.int64)
        for place, letter in enumerate(text[i : i + 3]):
            bound *= np.roll(L.letter_vector(ord(letter)), place)
        total += bound
    return total


def test_predictions_against_plain_recomputation(spark):
    import random

    rnd = random.Random(6)
    letters = {"aa": "abcde rst", "bb": "aeiou mnp", "cc": "xyzqw aeo"}
    rows = [(i, "".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(3, 60))) + rnd.choice(["", "!", " 12"]), lang if i % 7 else None, "s", 1) for i in range(60) for lang in [rnd.choice("abc") * 2]]
    model = {}
    for i, text, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            model[lang] = model.get(lang, 0) + vector(text)
    for r in L.language_id(table(spark, rows)).collect():
        v = vector(rows[r.doc_id][1])
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in model.items()}
        assert np.isclose(r.score, max(0.0, max(cosine.values())), atol=1e-5) and cosine[r.lang_pred] >= max(cosine.values()) - 1e-5


def test_ties_go_to_the_first_language(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:9]
    rows = [(i, "the same words", "zyx"[k % 3], "s", 1) for k, i in enumerate(ids)]
    assert {(r.lang_pred, round(r.score, 4)) for r in L.language_id(table(spark, rows)).collect()} == {("x", 1.0)}
