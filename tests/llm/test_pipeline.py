import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_langid import text
from tidemark.llm.simhash import jaccard

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def raw():
    draw = random.Random(4)
    rows = []
    for i in range(120):
        lang = draw.choice(["aa", "bb", "cc"])
        words = text(draw, lang, draw.randint(60, 160))
        rows.append((len(rows), words, lang, draw.choice(["s", "t", None])))
        if i % 6 == 0:
            rows.append((len(rows), words, lang, "s"))
        if i % 5 == 0:
            edited = words.split(" ")
            edited[draw.randrange(len(edited))] = "zzz"
            rows.append((len(rows), " ".join(edited), lang, "t"))
    rows += [(len(rows) + k, t, "aa", "s") for k, t in enumerate(["12 34 !", "", None])]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages_one_by_one(spark, raw):
    docs, seen = spark.createDataFrame(raw, COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "bpe":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = [r.asDict() for r in docs.collect()]
    told = {r["doc_id"]: r["text"] for r in seen["language_id"]}
    assert set(told) == {d for d, t, *_ in raw if t and any(c.isalpha() for c in t)}
    largest = {t: d for d, t in sorted(told.items())}
    exact = {r["doc_id"]: r["text"] for r in seen["exact_dedup"]}
    assert set(exact) == set(largest.values())
    gone = {b for b in exact for a in exact if a < b and jaccard(exact[a], exact[b], 5) >= 0.8}
    near = {r["doc_id"] for r in seen["near_dedup"]}
    assert near == set(exact) - gone
    sizes = Counter()
    for r in seen["near_dedup"]:
        sizes[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in seen["mixing"]:
        taken[r["source"]] += len(r["text"].split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1)))
    assert {r["doc_id"] for r in seen["mixing"]} <= near and set(taken) <= set(weights)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.1 * sum(sizes.values())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter(r["doc_id"] for r in seen["bpe"]) == Counter(r["doc_id"] for r in seen["mixing"])
    for r in seen["bpe"]:
        ids = library.encode(exact[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark, raw, tmp_path):
    spark.createDataFrame(raw, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and got.count() > 50
