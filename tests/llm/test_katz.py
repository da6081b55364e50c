"""Katz backoff against a plain version, and probabilities that sum to one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import katz, queries


class Plain:
    """The same model with dictionaries of word tuples."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order)]
        for words in texts:
            words = [*words, "</s>"]
            self.counts[0].update((w,) for w in words)
            for k in range(2, order + 1):
                padded = ["<s>", *words]
                self.counts[k - 1].update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
        self.taken = [katz.discounts([sum(n == r for n in c.values()) for r in range(1, katz.CUTOFF + 2)]) for c in self.counts]
        self.after = [defaultdict(dict) for _ in range(order)]
        for k, counts in enumerate(self.counts):
            for gram, n in counts.items():
                self.after[k][gram[:-1]][gram[-1]] = n

    def off(self, k, n):
        return self.taken[k][min(n, katz.CUTOFF + 1) - 1]

    def p(self, word, history):
        k = len(history)
        seen = self.after[k].get(history)
        if seen is None:
            return self.p(word, history[1:]) if k else 1.0
        total, left = sum(seen.values()), sum(self.off(k, n) for n in seen.values())
        rest, total = (left, total) if left > 0 else (1.0, total + 1)
        if word in seen:
            return (seen[word] - self.off(k, seen[word])) / total
        if not k:
            return rest / total
        return rest / total / (1 - sum(self.p(w, history[1:]) for w in seen)) * self.p(word, history[1:])

    def score(self, words, order):
        padded, out = ["<s>", *words, "</s>"], 0.0
        for i in range(1, len(padded)):
            out += math.log10(self.p(padded[i], tuple(padded[max(0, i - order + 1) : i]) if order > 1 else ()))
        return out


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def some_texts(seed, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 2, 5, 40]))) for _ in range(n)]
    return [*texts, texts[0], texts[0].upper(), "", None, " \t\n", "never seen before", "w1\xa0w2 é É"]


@pytest.mark.parametrize("order,whole", [(1, 1 << 20), (2, 1 << 20), (2, 20), (3, 50), (4, 1 << 20)])
def test_scores(spark, order, whole):
    texts = some_texts(order)
    rows = [(i if i != 5 else None, t, i % 4 != 1 if i != 7 else None, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learns boolean, batch string, id string").repartition(3)
    model = katz.katz(docs, F.col("learns"), order=order, batch_bytes=400, whole_history=whole)
    split = {i: words(t) for i, t in enumerate(texts)}
    learnt = [split[i] for i, _, learns, *_ in rows if learns]
    plain = Plain(learnt, order)
    known = {g[0] for g in plain.counts[0]}
    got = {r.doc_id if r.doc_id is not None else 5: r for r in model.scores.collect()}
    assert sorted(got) == list(range(len(texts)))
    total, types = sum(plain.counts[0].values()), len(known)
    for i, r in got.items():
        tokens = [*split[i], "</s>"]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(w in known for w in tokens))
        assert r.base_score == pytest.approx(sum(math.log10((plain.counts[0][w,] + 1) / (total + types + 1)) for w in tokens), abs=1e-9)
        assert r.score == pytest.approx(plain.score(split[i], order), abs=1e-8), i
    assert (model.stats[0].tokens, model.stats[0].types) == (total, types)
    names = {r.gram: r.word if r.word != "\n" else "</s>" for r in katz.ngrams(model, 1).collect()}
    assert {(names[r.gram],): r.n for r in katz.ngrams(model, 1).collect()} == dict(plain.counts[0])
    if order > 1:
        names[katz.START] = "<s>"
        assert {(names[r.history], names[r.word]): r.n for r in katz.ngrams(model, 2).collect()} == dict(plain.counts[1])


def test_probabilities_sum_to_one():
    texts = list(map(words, some_texts(9)))
    plain = Plain(texts, 3)
    every = [*{g[0] for g in plain.counts[0]}, "unknown"]
    for history in [(), ("w0",), ("w59",), ("<s>",), ("<s>", "w1"), ("w0", "w1"), ("not", "there"), ("w3", "w3")]:
        assert sum(plain.p(w, history) for w in every) == pytest.approx(1, abs=1e-9)


def test_discounts():
    found = katz.discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < a < r for r, a in enumerate(found[:5], 1)) and found[5] == 0
    assert sum(a * n for a, n in zip(found, [1000, 400, 220, 140, 100])) == pytest.approx(1000)  # what is left is the share of the single ones
    assert set(katz.discounts([2, 900, 0, 0, 0, 0])) == {2 / 1802} and not katz.discounts([0, 5, 0, 0, 0, 0]).any()


@pytest.mark.parametrize("texts", [[], [None, None], [None, "", "a"]])
def test_nothing_to_learn_from(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = katz.katz(docs, F.lit(False)).scores.collect()
    assert len(found) == len(texts) and all((r.score, r.base_score, r.n_known) == (0, 0, 0) for r in found)


def test_query(spark, tmp_path):
    texts = some_texts(3)
    spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, held_out int").write.parquet(f"{tmp_path}/documents.parquet")
    learns = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))}
    split = {i: words(t) for i, t in enumerate(texts)}
    plain = Plain([split[i] for i in learns if learns[i]], katz.ORDER)
    got = queries.op12_katz(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        assert r.held_out == (not learns[r.doc_id]) and r.train_tokens == sum(plain.counts[0].values())
        assert r.score == pytest.approx(plain.score(split[r.doc_id], katz.ORDER), abs=1e-8)


def test_held_out_texts_are_told_better_than_by_single_words(spark):
    got = [r for r in queries.op12_katz(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(got) > 100 and sum(r.score for r in got) > sum(r.base_score for r in got)
