"""Accents, document counts of the idf, and the independence of splits and folds."""

from pyspark.sql import functions as F

from tavola.operators import split, text
from tavola.session import cut_lineage


def test_accents_are_stripped_for_all_alphabets(spark):
    names = {"Beşiktaş": "besiktas", "Çağlayan": "caglayan", "Škoda": "skoda", "İstanbul": "istanbul", "Łódź": "łodz", "Târgoviște": "targoviste", "Dvořák ñ": "dvorak"}
    got = {r.t: r.k for r in spark.createDataFrame([(n,) for n in names], "t string").select("t", text.tokens(F.col("t")).alias("k")).collect()}
    assert {n: got[n][0] for n in names} == names


def test_ligatures_and_letters_beyond_the_basic_plane(spark):
    import random
    import unicodedata

    rnd = random.Random(1)
    pool = ["ﬁlet", "\U0001d401old", "½", "é", "É", "ﬀ", "①", "Ǆ", "ẞ", "ß", "İ", "x", "㎏", "中", "가", "e\u0301", "\u212b", "ﷺ", "™"]
    rows = [("".join(rnd.choice(pool) for _ in range(4)),) for _ in range(200)] + [("ﬁlet \U0001d401old",)]

    def plain(s):
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))).lower()

    got = spark.createDataFrame(rows, "t string").select("t", text.normalize(F.col("t")).alias("n"), text.tokens(F.col("t")).alias("k")).collect()
    assert all(unicodedata.normalize("NFC", r.n) == plain(r.t) for r in got)
    assert got[-1].k == ["filet", "bold"]


def test_idf_counts_documents_without_tokens(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, ""), (4, None)], "doc_id long, text string")
    tf = text.term_frequencies(docs, "doc_id", "text")
    idf = {r.term: round(r.idf, 6) for r in text.fit_idf(text.fit_vocabulary(tf), docs).collect()}
    assert idf == {"alpha": 1.510826, "beta": 1.916291}


def test_splits_and_folds_are_independent_of_id_patterns(spark):
    df = split.assign_fold(split.assign_split(spark.range(60_000), "id"), "id")
    pattern = (F.col("id") * 104729 % 10007) / 10007
    for key in ("split", "fold"):
        for r in df.groupBy(key).agg(F.avg(pattern).alias("m"), F.count("*").alias("n")).collect():
            assert abs(r.m - 0.5) < 0.02
    share = {r.split: r["count"] / 60_000 for r in df.groupBy("split").count().collect()}
    assert abs(share["test"] - 0.15) < 0.01 and abs(share["val"] - 0.15) < 0.01
    both = {(r.split, r.fold): r["count"] for r in df.groupBy("split", "fold").count().collect()}
    assert all(abs(n / 60_000 - share[s] / 3) < 0.01 for (s, _), n in both.items())


def test_term_counts_are_dealt_by_bytes_and_weights_read_them_once(spark, monkeypatch):
    """As many partitions as the texts need, one scan of the documents for weights and norms, vocabulary terms only before the count."""
    monkeypatch.setattr(text, "TEXT_BYTES", 1000)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 40}" for k in range(50))) for i in range(200)] + [(None, "w1 w2"), (3, "w1 w1"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    tf = text.term_frequencies(docs, "doc_id", "body", 2)
    assert tf.rdd.getNumPartitions() >= sum(len(t or "") for _, t in rows) // 1000
    whole = text.tfidf(tf, idf := cut_lineage(text.fit_idf(text.fit_vocabulary(tf, 2, 30), docs)))
    among = text.tfidf(text.term_frequencies(docs, "doc_id", "body", 2, among=idf), idf)
    plan = among._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1
    key = lambda df: sorted((r.doc_id, r.term, r.term_idx, round(r.weight, 9)) for r in df.collect())
    assert key(whole) == key(among) and len(key(among)) > 1000
    norms = {}
    for d, _, _, w in key(among):
        norms[d] = norms.get(d, 0) + w * w
    assert None not in norms and all(abs(x - 1) < 1e-6 for x in norms.values())


def test_coarse_class_holds_all_rare_letters_and_no_common_ones():
    import re

    coarse = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\U" + m[1].rjust(8, "0"), text.NEAR_RARE_CLASS))
    assert all(coarse.search(c) for c in text._RARE)
    assert not coarse.search("abc XYZ 019 éüñßàÅøæ-_.")
    assert text.NEAR_RARE_CLASS.count("-") < 10 < text.RARE_CLASS.count("-")
