import os
import random
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixtures import awkward, clashing, table

from tavola.llm import packing
from tavola.llm.queries import tokenizer_path

FILE = "word_bpe_49k.json"


def power(n):
    return n & (n - 1) == 0


def check(pieces, want, limits):
    """Every row's ids lie in one piece each, sequences are gapless, within limits and need no padding.

    ``want``: (key, ids, loss marks) per row; pieces hold their ids.
    """
    left = {}
    for key, ids, loss in want:
        left.setdefault((key, tuple(ids)), []).append(loss)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) > 0
    for group in by.values():
        group.sort(key=lambda p: p.offset)
        total = sum(p.length for p in group)
        assert [p.offset for p in group] == [sum(q.length for q in group[:i]) for i in range(len(group))]
        assert total <= limits.tokens and len(group) <= limits.segments and sum(p.loss_tokens for p in group) <= limits.loss
        assert total == limits.tokens or power(total)
    have, need = {}, {}
    for p in pieces:
        for i, x in enumerate(p.ids):
            have.setdefault((p.doc_id, p.doc_tokens, p.start + i, x), 0)
            have[(p.doc_id, p.doc_tokens, p.start + i, x)] += 1
    for key, ids, _ in want:
        for i, x in enumerate(ids):
            need[(key, len(ids), i, x)] = need.get((key, len(ids), i, x), 0) + 1
    assert have == need


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(FILE))


ODD = ["a", "B", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "\n", "\x0b", "\r", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u0301", "e\u0301", "é", "É", "é.", "Σ", "ΑΣ", "1", "23", "!", "..", ". ", "漢字", "ﬁ", "İ", "I\u0307", "ß", "ẞ", "\U0001f600", "µ", "×", "÷", "Ω", "\u212a"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(ODD)).map("".join)))
def test_ids_are_the_library_s(text):
    got = np.frombuffer(packing.tokenizer(tokenizer_path(FILE)).encode(text), "<u4").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


LIBRARY = library()


def test_ids_of_the_documents(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        got = np.frombuffer(packing.tokenizer(tokenizer_path(FILE)).encode(r.text or ""), "<u4").tolist()
        assert got == LIBRARY.encode(r.text or "", add_special_tokens=False).ids


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 10)
    own = packing.WordTokenizer(tokenizer_path(FILE))
    text = " ".join(f"word{i}" for i in range(50)) + " " + "x" * 500
    assert np.frombuffer(own.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(own) <= 10 and "x" * 500 not in own


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 40), packing.Limits(1, 1, 1), packing.Limits(100, 50, 7)])
def test_documents(spark, limits):
    rows = awkward()
    if limits.tokens == 1:
        rows = [r for r in rows if len(r[1] or "") < 5000]
    for df in (table(spark, rows), clashing(table(spark, rows), "ids", "start", "key", "sequence_id")):
        out = packing.pack_documents(df.repartition(3), tokenizer_path(FILE), limits=limits, keep_ids=True).collect()
        want = [(r[0], LIBRARY.encode(r[1] or "", add_special_tokens=False).ids + [2], None) for r in rows]
        check(out, want, limits)
        assert all(p.loss_tokens == p.length - (p.start == 0) for p in out)
    assert packing.pack_documents(table(spark, []), tokenizer_path(FILE)).collect() == []


def test_examples_with_answers(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        n = rnd.choice([0, 1, 5, 30, 90, 300])
        rows.append((i if i % 50 else None, [rnd.randrange(1000) for _ in range(n)], [rnd.random() < 0.4 for _ in range(n)]))
    rows += [(1000, None, None), (1001, [5, 6, 7], [True]), (1002, [8, 9], None)]
    df = spark.createDataFrame(rows, "id bigint, ids array<bigint>, loss array<boolean>")
    limits = packing.Limits(128, 8, 30)
    out = packing.pack_examples(df, loss_col="loss", limits=limits).collect()
    check(out, [(k, ids or [], None) for k, ids, _ in rows], limits)
    marks = {}
    for k, ids, loss in rows:
        loss = (loss or [])[: len(ids or [])]
        marks.setdefault((k, tuple(ids or [])), loss + [False] * (len(ids or []) - len(loss)))
    whole = {tuple(p.ids): p for p in out if p.length == p.doc_tokens}
    assert all(p.loss_tokens == sum(marks[(p.doc_id, ids)]) for ids, p in whole.items() if len(ids) > 2)
    assert packing.pack_examples(df.limit(0), loss_col="loss").collect() == []


def test_the_greatest_dot_product_goes_first():
    limits = packing.Limits(10, 10, 10)
    packer = packing.Packer(limits)
    flat = lambda n, loss: packing.Example(n, np.zeros(n, np.int64), np.minimum(np.arange(n + 1), loss))
    for n, loss in ((3, 0), (6, 6), (4, 4), (2, 2)):
        assert list(packer.add(flat(n, loss))) == []
    assert [e.key for e, _, _ in packer.fill()] == [6, 4]


def test_same_input_same_sequences(spark):
    rows = lambda: sorted(map(tuple, packing.pack_documents(table(spark).coalesce(1), tokenizer_path(FILE)).collect()), key=repr)
    assert rows() == rows()
