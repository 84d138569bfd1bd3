import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm import encoding

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARIES), reason="no vocabulary files")


@pytest.fixture(scope="module")
def whole():
    t = tokenizers.Tokenizer.from_file(os.path.join(encoding.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "'", "'s", "'re", "a", "bc", "é", "ñ", " ", "　", "中", "🙂", ".", "!?", "0", "12", "<|endoftext|>", "\r\n", "\x00", "Ś"]), max_size=25).map("".join))
def test_ids_equal_the_library(whole, text):
    e = encoding.encoder("byte_bpe_50k")
    assert e.encode(text) == whole(text) and e.count(text) == len(whole(text))
    assert b"".join(e.fragments(text)) == text.encode()


def test_forgetting_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(encoding, "MEMORY_FRAGMENTS", 3)
    e = encoding.FragmentEncoder("byte_bpe_50k")
    text = "La leche entera de la casa, con 3 % de grasa; y más cosas. " * 5
    assert e.encode(text) == whole(text)


def test_corpus(spark, whole):
    texts = ["Hola, ¿qué tal?", "", None, " ", "x" * 50_000, "palabra " * 20_000]
    rows = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()}
    assert rows == {i: whole(t) if t else [] for i, t in enumerate(texts)}
