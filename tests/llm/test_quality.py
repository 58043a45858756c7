import itertools
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import numpy as np
from llm_fixtures import awkward, clashing, prose, same, table, words

from tavola.llm import quality_crf as Q


def base(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    n = len(own)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, own)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rnd = random.Random(1)
    rows = [r for r in awkward() if r[0] not in (9, 12)]
    rows += [(200, "a b c " * 40, "en", "a", 1), (201, prose(rnd, 90, 6), "en", "a", 1), (202, "x\n\nx\n \nÜ# <y>\r\nx", "en", "a", 1)]
    got = Q.quality(clashing(table(spark, rows), "kept", "_v", "verdict"), Q.ALL_CONTENT).collect()
    assert same([r[:7] for r in got], [(r[0], *base(r[1])) for r in rows])
    assert all(r.kept == (not r.base_failed) for r in got)


def test_viterbi_is_the_best_labelling():
    rnd = np.random.default_rng(0)
    for _ in range(30):
        field = Q.Field(rnd.normal(size=(len(Q.FEATURES), 2)), rnd.normal(size=(2, 2)))
        x = rnd.normal(size=(rnd.integers(1, 7), len(Q.FEATURES)))
        scores = x @ field.weights
        total = lambda y: sum(scores[i, a] for i, a in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(x)), key=total)
        assert np.isclose(total(field.decode(x)), total(best))


def test_training_raises_the_exact_likelihood():
    rnd = np.random.default_rng(1)
    seqs, labels = [], []
    for i in range(40):
        x = rnd.normal(size=(rnd.integers(1, 6), len(Q.FEATURES)))
        x[:, 2] += 2 * (i % 2)
        seqs.append(x)
        labels.append(i % 2)
    field = Q.Field.train(seqs, labels)
    assert np.mean([(field.decode(s) == y).mean() for s, y in zip(seqs, labels)]) > 0.9


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.quality(docs, Q.train(docs, labels)).join(labels, "doc_id").filter("not base_failed").collect()
    clean, junk = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(clean) / len(clean) >= 0.98 and sum(junk) / len(junk) <= 0.1


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Q.train(table(spark), none) is Q.ALL_CONTENT
    assert Q.quality(table(spark, []), Q.ALL_CONTENT).collect() == []
    kept = Q.keep_content(clashing(table(spark), "row", "verdict"), Q.ALL_CONTENT)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "verdict"]
    assert kept.count() == sum(not base(r[1])[5] for r in awkward() if r[0] not in (9, 12)) + 2


def test_training_reads_whole_texts(spark):
    rnd = random.Random(4)
    head = "\n".join(prose(rnd, 9) + "." for _ in range(70))
    foot = {0: "\n".join("# | * | # 12 >" for _ in range(70)), 1: "\n".join(prose(rnd, 12) + "." for _ in range(70))}
    rows = [(i, f"{head}\n{foot[i % 2]}" if i else None, "en", "a", 1) for i in range(9)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id bigint, quality int")
    field = Q.train(table(spark, rows), labels)
    features = lambda text: Q.line_features(*Q.content_lines(text.encode()))
    assert not field.decode(features(foot[0])).any() and field.decode(features(foot[1])).all()


def corpus(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = Q.train(docs, labels)
    texts = {q: [r.text for r in docs.join(labels, "doc_id").filter(f"quality = {q}").orderBy("doc_id").collect() if len(words(r.text)) >= 50] for q in (0, 1)}
    return field, texts


def test_the_change_inside_a_document_is_found(spark):
    """Documents half prose, half junk: the decoded change lies within two lines of the true one."""
    field, texts = corpus(spark)
    near = []
    for i, (prose_text, junk) in enumerate(zip(texts[1], texts[0])):
        a, b = ([x for x in t.split("\n") if words(x)] for t in (prose_text, junk))
        n = min(len(a), len(b), 20)
        parts = [a[:n], b[:n]][:: 1 - 2 * (i % 2)]
        label = field.decode(Q.line_features(*Q.content_lines("\n".join(parts[0] + parts[1]).encode())))
        want = [1 - i % 2] * n + [i % 2] * n
        near.append(sum(int(x != y) for x, y in zip(label, want)) <= 2)
    assert len(near) >= 20 and sum(near) / len(near) >= 0.9


def test_share_lies_between_for_mixed_documents(spark):
    field, texts = corpus(spark)
    shares = []
    for prose_text, junk in zip(texts[1], texts[0]):
        a, b = ([x for x in t.split("\n") if words(x)] for t in (prose_text, junk))
        n = min(len(a) // 7, len(b) // 3)
        if n >= 2:
            shares.append(Q.judge("\n".join(a[: 7 * n] + b[: 3 * n]).encode(), field)[7])
    assert shares and sum(0 < s < 1 for s in shares) >= 0.9 * len(shares)


def test_a_repeated_id_is_one_sequence(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(Q.Field, "train", classmethod(lambda cls, sequences, labels: sent.append(sequences) or Q.ALL_CONTENT))
    docs = spark.range(20_000).selectExpr("cast(0 as bigint) as doc_id", "concat('text ', id % 50, ' of many words') as text")
    docs = docs.unionByName(spark.createDataFrame([(1, "# | # junk")], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "doc_id bigint, quality int")
    Q.train(docs, labels)
    assert len(sent[0]) == 1 and len(sent[0][0]) == 2


def test_gold_moves_count_changes():
    rnd = np.random.default_rng(3)
    junk, content = ([rnd.normal(size=(rnd.integers(1, 9), len(Q.FEATURES))) + shift for _ in range(n)] for shift, n in ((-1, 12), (1, 30)))
    sequences, labels = Q.joined(junk, content)
    assert len(sequences) == 30 and all(len(s) == len(y) and abs(np.diff(y)).sum() == 1 for s, y in zip(sequences, labels))
    field = Q.Field.train(sequences, labels)
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]
    assert np.mean(np.concatenate([field.decode(s) == y for s, y in zip(sequences, labels)])) > 0.95
