import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Bpe(open(PATH).read())
TEXTS = [
    "", " ", "Hello  World, it's 3.14!\n\tÉMILE's déjà-vu", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "ΣΑΣ Σ ß İ ﬁ", "a\x1cb\x1d c\x85d\xa0e", "日本語 текст العربية 👩‍👩‍👧 é ́x",
    "'s 't're we've I'll'd", "x" * 500, "abc" * 300, "é" * 200, " a b　c", "²½Ⅷ٣", "a_b__c--d...", "�\u0000​", "Ⱥ ȾZ İx ŉ ǅ", "it's  x\x1fy²³a½ªº",
]


def ids(text):
    return np.frombuffer(b"".join(OWN.encode(text)), "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text_as_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x3FF)))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_fragments_join_to_the_word_and_cut_only_where_no_token_passes():
    byte = {s: b for b, s in enumerate(bpe.byte_symbols())}
    for word in (b"hello", "éàü".encode(), b"a", "naïve".encode()):
        parts = OWN.fragments(word)
        assert b"".join(p for p, _ in parts) == word and [e for _, e in parts] == [False] * (len(parts) - 1) + [True]
    assert len(byte) == 256 and not OWN.inside.all()


def test_long_texts_are_taken_in_pieces(monkeypatch):
    text = "the quick brown fox <|endoftext|> " * 50
    assert "".join(bpe.pieces(text, 100)) == text and len(list(bpe.pieces(text, 100))) > 10


def test_dataframes(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, TEXTS[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(got, key=str) == sorted(bpe.encode(docs, PATH, decoded="decoded").collect(), key=str)
    assert len(got) == len(rows)
    want = {t or "": LIBRARY.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows}
    for r in got:
        source = TEXTS[r.doc_id] if r.doc_id is not None else ""
        assert np.frombuffer(r.ids, "<u4").tolist() == want[source] and r.decoded == LIBRARY.decode(want[source], skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["z\u0307o\u0142ty", "e\u0307 c\u0307 g\u0307", "Z\u0307ebbug\u0307", "I\u0307 \u0130 i\u0307", "\u0307x", "a\u0323\u0307b \u0130"])
def test_a_dot_above_of_the_text_composes_as_in_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)
