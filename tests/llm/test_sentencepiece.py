import hashlib
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import awkward, clashing, same, table

spm = pytest.importorskip("sentencepiece")
from sentencepiece import sentencepiece_model_pb2 as schema  # noqa: E402

from tavola.llm import sentencepiece_codec as S  # noqa: E402
from tavola.llm.queries import tokenizer_path  # noqa: E402

LIBRARY = spm.SentencePieceProcessor(model_file=tokenizer_path())
OWN = S.codec(tokenizer_path())
LETTERS = st.text(st.sampled_from("abcthe  \n\t▁éß日🙂́<>0x&.-\x00") | st.characters(codec="utf-8"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(LETTERS)
def test_ids_text_and_spans_equal_the_library(text):
    ids, borders = OWN.encode(text)
    want = LIBRARY.encode(text)
    assert ids.tolist() == want
    assert OWN.decode(want) == LIBRARY.decode(want)
    data = text.encode()
    assert borders[0] == 0 and borders[-1] == len(data) and (borders[1:] >= borders[:-1]).all()
    for i, b, e in zip(want, borders[:-1], borders[1:]):
        piece = LIBRARY.id_to_piece(i)
        if not piece.startswith("<0x"):
            assert data[b:e].decode().replace(" ", "▁") in (piece, piece[1:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_any_ids_decode_like_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf", "identity"])
def test_compiled_maps_normalise_like_the_library(rule):
    library = spm.SentencePieceNormalizer(rule_name=rule)
    spec = schema.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    own = S.Normalizer(spec)

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from("ｱｲ①Ａ ﬁab  　éßｶﾞ한글가\t\x01㌔"), max_size=25))
    def check(text):
        normal, align = own(text)
        assert normal == library.normalize(text)
        assert len(align) == len(normal.encode()) + 1 and (align[1:] >= align[:-1]).all()

    check()


def test_long_parts():
    for text in ("x" * 5000, "ab" * 3000 + "  " * 500, "the" * 2000):
        assert OWN.encode(text)[0].tolist() == LIBRARY.encode(text)


def test_new_words_go_to_the_library_at_once(monkeypatch):
    """Words that were met are not merged again; ids stay those of the whole text, across a cleared memory as well."""
    own = S.Codec(open(tokenizer_path(), "rb").read())
    merged, merge = [], own.marked.merge
    monkeypatch.setattr(own.marked, "merge", lambda part: merged.append(part) or merge(part))
    monkeypatch.setattr(S, "CACHED_PARTS", 500)
    for k in range(30):
        texts = [" ".join(f"wörd{k * 7 + i + j}<0x41>\x00\n日{i}" for i in range(20)) + " the a▁b" + " " * j + "x" * 60 for j in range(3)] + ["", " ", "▁"]
        own.meet(texts)
        for text in texts:
            assert own.encode(text)[0].tolist() == LIBRARY.encode(text)
    # Only empty and very long words, and what has space marks of its own, are merged one by one.
    assert not [part for part in merged if part.startswith(S.SPACE + "w")]


def test_query_digests(spark):
    got = S.digests(clashing(table(spark), "ids", "begins", "decoded"), tokenizer_path()).collect()
    want = []
    for r in awkward():
        ids = LIBRARY.encode(r[1] or "")
        text = LIBRARY.decode(ids)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)]
        want.append((r[0], len(ids), *digest, len((r[1] or "").encode())))
    assert same(got, want)
    assert S.digests(table(spark, []), tokenizer_path()).collect() == []
