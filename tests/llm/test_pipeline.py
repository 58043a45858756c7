import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import awkward, clashing, table, words

import corpus_pipeline as P
from test_line_runs import brute as line_brute
from test_simhash import brute as simhash_brute
from tavola.llm import mixing, quality_crf
from tavola.llm.queries import tokenizer_path


def test_stages_against_plain_python(spark, tmp_path):
    """Every stage on its own input: the table as each predecessor left it."""
    import sentencepiece

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    field = quality_crf.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, d).write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        docs, columns = spark.read.parquet(path), docs.columns
        after = [tuple(r) for r in docs.collect()]
        if name == "quality rules":
            assert sorted(after) == sorted(r for r in before if quality_crf.judge(r[1].encode(), field)[6])
        elif name == "line dedup":
            assert {r[0]: r[1] for r in after} == {r[0]: r[5] for r in line_brute(before)} and len(after) == len(before)
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "SimHash near-dedup":
            assert {r[0] for r in after} == {r[2] for r in simhash_brute(before)} and len(after) == len({r[0] for r in after})
        elif name.startswith("mixing"):
            taken = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(before, docs.schema)).collect() if r.taken}
            have = {}
            text = {r[0]: r[1] for r in before}
            for r in after:
                have[r[0]] = have.get(r[0], 0) + len(words(r[1]))
                assert set(words(r[1])) <= set(words(text[r[0]]))
            assert have == taken
        else:
            want = sorted((r[0], library.encode(r[1])) for r in before)
            assert sorted((r.doc_id, r.ids) for r in docs.collect()) == want
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns


def test_run_equals_the_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, d).write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(P.run(spark, d)) == key(docs)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for k, rows in enumerate((awkward(), [])):
        for extra in ((), ("row", "id", "fp", "size", "pass", "kept")):
            df = clashing(table(spark, rows), *extra)
            for name, stage in P.STAGES:
                out = stage(spark, df, d)
                out.write.parquet(str(tmp_path / f"{k}{len(extra)}{name}".replace(" ", "-")))
                if name != P.STAGES[-1][0]:
                    assert out.columns == df.columns
