import random

import numpy as np
import pytest

from tidemark.llm import langid

SYLLABLES = {"aa": "ka to mi re su no".split(), "bb": "ber schü gen ßen ter au".split(), "cc": "ção las nhe do os qué".split()}
COLUMNS = "doc_id long, text string, lang string, score string"


def text(draw, lang, words, syllables=SYLLABLES):
    return " ".join("".join(draw.choice(syllables[lang]) for _ in range(draw.randint(1, 4))) for _ in range(words)) + "."


def corpus(n=240, seed=1, syllables=SYLLABLES):
    draw = random.Random(seed)
    return [(i, text(draw, lang, draw.randint(3, 60), syllables), lang, "clash") for i in range(n) for lang in [draw.choice(sorted(syllables))]]


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(corpus(), COLUMNS))


def symbols(t):
    out = [int(langid.SYMBOL[b]) for b in t.encode()]
    return [s for i, s in enumerate(out) if i == 0 or s != 32 or out[i - 1] != 32]


def brute_chances(training, order):
    """PPM with escapes and exclusion, from counts taken anew: the chance of every byte after a context."""
    every = sorted({int(s) for s in langid.SYMBOL})
    assert len(every) == langid.ALPHABET
    counts = {}
    for t in training:
        s = [32] * order + symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen = counts.setdefault(tuple(s[i - k : i]), {})
                seen[s[i]] = seen.get(s[i], 0) + 1

    def chances(context):
        below = chances(context[1:]) if context else {s: 1 / len(every) for s in every}
        seen = counts.get(context)
        if not seen:
            return below
        escape = len(seen) if len(seen) < len(every) else 0
        total, rest = sum(seen.values()) + escape, sum(p for s, p in below.items() if s not in seen)
        return {s: seen[s] / total if s in seen else escape / total * below[s] / rest for s in every}

    return chances


def test_code_lengths_are_those_of_a_plain_coder():
    training, order = [t for _, t, l, _ in corpus() if l == "bb"], 3
    codes, times = np.unique(np.concatenate([langid.symbol_codes(t, order) for t in training]), return_counts=True)
    own = langid.Model(["bb"], [langid.Tree(codes, times, order)], order)
    chances = brute_chances(training, order)
    draw = random.Random(9)
    for document in (text(draw, "aa", 8), text(draw, "bb", 8), "Zürich 2024, 東京!", "x", "Привет мир", ""):
        s = [32] * order + symbols(document)
        assert all(abs(sum(chances(tuple(s[i - order : i])).values()) - 1) < 1e-9 for i in range(order, len(s)))
        want = -sum(np.log2(chances(tuple(s[i - order : i]))[s[i]]) for i in range(order, len(s)))
        bits, sizes = own.code_lengths([document])
        assert bits[0, 0] == pytest.approx(want, rel=1e-9) and sizes[0] == len(s) - order


def test_many_texts_at_once_are_as_one_by_one(model, monkeypatch):
    texts = [t for _, t, _, _ in corpus(40, 3)] + ["", "ka" * 5000]
    alone = np.concatenate([model.code_lengths([t])[0] for t in texts])
    monkeypatch.setattr(langid, "LOOKUPS", 700)
    assert np.allclose(model.code_lengths(texts)[0], alone)


def test_held_out_accuracy(spark, model):
    rows = corpus(300, 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, COLUMNS), model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang, _ in rows]) > 0.97
    assert all(0 <= s <= 1 for _, s in got.values())


def test_twenty_languages_of_three_scripts(spark):
    """The order stays and no bytes are merged, however many languages there are."""
    draw = random.Random(5)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ", "αβγδεζηθικλμνξοπρστυφχψω", "東京大阪名古屋神戸横浜福岡札幌仙台広島"]
    syllables = {f"l{i:02}": ["".join(draw.choice(scripts[i % 4]) for _ in range(2)) for _ in range(12)] for i in range(20)}
    model = langid.fit(spark.createDataFrame(corpus(1600, 1, syllables), COLUMNS))
    assert model.order == 3 and len(model.languages) == 20
    rows = corpus(400, 2, syllables)
    found, _ = model.predict([t for _, t, _, _ in rows])
    assert np.mean([a == lang for a, (_, _, lang, _) in zip(found, rows)]) > 0.97


def test_the_score_falls_where_two_languages_share_a_text(model):
    draw = random.Random(6)
    alone, both = text(draw, "aa", 40), text(draw, "aa", 20) + text(draw, "bb", 20)
    _, (sure, unsure) = model.predict([alone, both])
    assert sure > 0.95 and unsure < sure
    assert model.shares(np.array([[7.0, 7.0, 7.0]]), np.array([3]))[0].tolist() == pytest.approx([1 / 3] * 3)


def test_what_has_no_letter_is_und(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "京"), (None, "ka to"), (4, "京"), (5, "ka" * 300_000)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und")
    assert all(r.lang_pred in model.languages for r in got if r.doc_id not in (1, 2, 3))
    kept = langid.accepted(spark.createDataFrame(rows, "doc_id long, text string"), model, 0.6)
    assert {r.doc_id for r in kept.collect()} - {4} == {None, 5}
    assert langid.accepted(spark.createDataFrame(rows, "doc_id long, text string"), None).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "aa"), (None, "a", "aa")], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert [r.lang_pred for r in langid.identify(docs, None).collect()] == ["und", "und", "und"]
    assert langid.identify(docs.limit(0), None).count() == 0
    only = langid.fit(spark.createDataFrame([(1, "", "aa"), (2, "b", "bb")], "doc_id long, text string, lang string"))
    assert only.predict(["b", "zz"])[0][0] == "bb"


def test_the_query_learns_from_rows_that_are_not_held_out_alone(spark, tmp_path):
    from zlib import crc32

    from tidemark.llm.queries import op7_language_id

    rows = [(i, t, lang) for i, t, lang, _ in corpus(300, 4)]
    held = {i: crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    rows = [(i, t, "trap" if held[i] else lang) for i, t, lang in rows] + [(1000, None, "aa"), (1001, "", None), (1001, "12", None)]
    spark.createDataFrame([(*r, "s", 1.0, "x") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {"doc_id", "held_out", "lang_pred", "score"} <= set(got[0].asDict())
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and r.lang_pred in {"aa", "bb", "cc", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id >= 1000)
