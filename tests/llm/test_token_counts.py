import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = tc.Counter(LIBRARY.to_str())
ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "1", "23", ".", "é", "京", "word", " word", "<|endoftext|>", "<|endo", "ftext|>", "　", "\x1c"]


def n(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def holds(tree, text):
    size = tree.leaves
    for heap in (tree.chars, tree.tokens):
        assert all(heap[k] == heap[2 * k] + heap[2 * k + 1] for k in range(1, size))
    assert tree.chars[1] == len(text) and tree.total == n(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 12), st.lists(st.sampled_from(ALPHABET), max_size=8)), max_size=6))
def test_edits_give_what_counting_anew_gives(parts, changes):
    text = "".join(parts)
    tree = tc.build(text, OWN, leaf=2)
    holds(tree, text)
    for start, size, put in changes:
        want = text[: min(start, len(text))] + "".join(put) + text[min(start + size, len(text)) :]
        text, tree, _ = tc.edit(text, tree, [(start, start + size, "".join(put))], OWN, leaf=2)
        assert text == want
        holds(tree, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=80), st.lists(st.tuples(st.integers(0, 150), st.integers(0, 9), st.lists(st.sampled_from(ALPHABET), max_size=6)), max_size=12))
def test_many_edits_at_once_give_what_counting_anew_gives(parts, changes):
    text, at, want = "".join(parts), 0, ""
    edits = [(start, start + size, "".join(put)) for start, size, put in changes]
    for start, end, put in sorted(edits):
        start = min(max(start, at), len(text))
        end = min(max(start, end), len(text))
        want, at = want + text[at:start] + put, end
    want += text[at:]
    got, tree, _ = tc.edit(text, tc.build(text, OWN, leaf=2), edits, OWN, leaf=2)
    assert got == want
    holds(tree, want)


def test_very_many_edits_in_a_very_long_text_are_one_pass():
    import time

    draw = random.Random(2)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(850_000))
    every = sorted(draw.sample(range(len(text) - 10), 100_000))
    edits = [(a, a + draw.randint(0, 5), draw.choice(["", "x", " new "])) for a in every]
    tree = tc.build(text, OWN)
    began = time.perf_counter()
    after, tree, _ = tc.edit(text, tree, edits, OWN)
    assert time.perf_counter() - began < 30
    holds(tree, after)


def test_an_edit_in_a_long_text_encodes_little():
    draw = random.Random(1)
    text = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(40_000))
    tree = tc.build(text, OWN)
    for _ in range(50):
        at = draw.randrange(len(text))
        text, tree, encoded = tc.edit(text, tree, [(at, at + draw.randint(0, 30), draw.choice(["", "x", " new words here ", "  "]))], OWN)
        assert encoded < 2500
    holds(tree, text)


@pytest.mark.parametrize("text", ["", "x", "a" * 5000, " " * 3000, "京" * 300, None])
def test_dataframes(spark, text):
    rows = [(1, text, "t"), (None, "two words", "t"), (1, text, "t"), (2, "phone 123456 and 98765 end", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    trees = tc.build_trees(docs, PATH, keep=("text",))
    assert sorted((r.doc_id or 0, r.n) for r in trees.select("doc_id", tc.count().alias("n")).collect()) == sorted((d or 0, n(t or "")) for d, t, _ in rows)
    edits = F.when(F.col("doc_id") == 2, F.array(F.struct(F.lit(6).alias("start"), F.lit(12).alias("end"), F.lit("#").alias("put")), F.struct(F.lit(17).alias("start"), F.lit(22).alias("end"), F.lit("").alias("put"))))
    got = {r.text: r.n for r in tc.apply_edits(trees.withColumn("edits", edits), PATH).select("text", tc.count().alias("n")).collect()}
    assert got["phone # and  end"] == n("phone # and  end") and got[text or ""] == n(text or "")
    assert tc.build_trees(docs.limit(0), PATH).count() == 0


def test_the_query_against_counting_masked_texts_anew(spark):
    import re

    from tidemark.llm.queries import MASK, MASKED, documents, op6_token_counts

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    got = op6_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        masked, times = re.subn(MASKED, MASK, texts[r.doc_id])
        assert (r.n_tokens, r.n_edits, r.n_tokens_after) == (n(texts[r.doc_id]), times, n(masked))
