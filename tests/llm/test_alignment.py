"""Token alignment against whole-text encodings by the libraries and groups from common ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries
from tidemark.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", " house", "  two", " ", "   ", "\n", " \n ", "\t", "\r\n", "don't", " we'll", "straße", "École", "12345", " 3.14", "<|endoftext|>", "<s>", " <0x41>", "日本語", "नमस्ते", "🙂", "é", "\xa0", " ", "\x1c", "\x85", "​", "...", " !!!", "x" * 70, "_under_score", "\x00"]


def tokens(library, model, vocabulary, text):
    """(id, end) of both sides by whole-text encoding, or nothing where either does not give the bytes back."""
    if not text:
        return [], []
    byte = {s: b for b, s in enumerate(byte_symbols())}
    want, sides = (" " + text).encode(), []
    for ids, data in (
        (library.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in vocabulary[i])),
        (model.encode(text), lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, side = 0, []
        for i in ids:
            at += len(data(i))
            side.append((i, at))
        if b"".join(map(data, ids)) != want:
            return [], []
        sides.append(side)
    return sides


def brute(texts, links):
    library, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    vocabulary = {i: t for t, i in library.get_vocab().items()}
    groups, linked = {}, {}
    for doc, text in texts.items():
        a, b = tokens(library, model, vocabulary, text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups[doc] = [([(i, e) for i, e in a if lo < e <= hi], [(i, e) for i, e in b if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        starts = lambda side: [(i, lo, e) for (i, e), lo in zip(side, [0, *(e for _, e in side)])]
        if links == "all":
            linked[doc] = [(i, j) for x, y in groups[doc] for i, _ in x for j, _ in y]
        else:
            meets = (lambda p, q: p[2] == q[2]) if links == "ends" else (lambda p, q: p[1] < q[2] and q[1] < p[2])
            x, y = starts(a), starts(b)
            linked[doc] = [(p[0], q[0]) for p in x for q in y if meets(p, q)]
    count = Counter(x for pairs in linked.values() for x in pairs)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = {}
    for doc in texts:
        text = ";".join(",".join(str(i) for i, _ in x) + "|" + ",".join(str(j) for j, _ in y) for x, y in groups[doc])
        out[doc] = (sum(len(x) for x, _ in groups[doc]), sum(len(y) for _, y in groups[doc]), len(groups[doc]), len(linked[doc]), sum(count[x] == best[x[1]] for x in linked[doc]), sum(count[x] for x in linked[doc]), hashlib.sha256(text.encode()).hexdigest() if text else "", text)
    return out, count, best


def some_texts(seed, n=150):
    draw = random.Random(seed)
    texts = ["".join(draw.choices(PARTS, k=draw.choice([1, 2, 6, 30]))) for _ in range(n)]
    return {i: t for i, t in enumerate([*texts, "", None, "a ▁ b", "▁", texts[0], texts[0], "▁x fine", " lead", "trail ", "plain words only here", "a" * 900])}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("links,limit", [("ends", 1 << 20), ("ends", 200), ("overlaps", 500), ("all", 500)])
def test_alignment(spark, links, limit):
    texts = some_texts(len(links))
    want, count, best = brute(texts, links)
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x", "y") for i, t in texts.items()], "doc_id long, text string, batch string, n_a string").repartition(3)
    found = alignment.align(docs, A, B, links=links, keep_groups=True, batch_bytes=limit)
    got = {3 if r.doc_id is None else r.doc_id: tuple(r[c] for c in (*COLUMNS, "groups")) for r in found.documents.collect()}
    assert got == want
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(found).collect()}
    assert pairs == {x: (n, best[x[1]]) for x, n in count.items()}


def test_query(spark, tmp_path):
    texts = some_texts(7)
    want, *_ = brute(texts, "ends")
    spark.createDataFrame([(i, t, "z") for i, t in texts.items()], "doc_id long, text string, n_best string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, str(tmp_path)).collect()} == {d: x[:-1] for d, x in want.items()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 2000")
    want, *_ = brute({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, "ends")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, A, B).documents.collect()} == {d: x[:-1] for d, x in want.items()}


@pytest.mark.parametrize("texts", [[], [None, None], ["", None, "▁"]])
def test_nothing_to_align(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = alignment.align(docs, A, B).documents.withColumn("total", sum((F.col(c) for c in COLUMNS[:-1]), F.lit(0))).collect()
    assert len(got) == len(texts) and all(r.total == 0 and r.groups_sha256 == "" for r in got)


@pytest.mark.parametrize("ends_a,ends_b,want", [([2, 3, 7, 9], [1, 3, 8, 9], [0, 0, 2, 2, 0, 0, 2, 2]), ([4], [1, 2, 4], [0] * 4), ([1, 2, 3], [1, 2, 3], [0, 1, 2, 0, 1, 2])])
def test_components_by_union_find(ends_a, ends_b, want):
    left, right = alignment.overlaps(np.array(ends_a), np.array(ends_b))
    assert alignment.components(len(ends_a) + len(ends_b), left, right + len(ends_a)).tolist() == want
