"""The registered queries over small tables with nulls, empty and repeated rows and columns whose names clash with those of the results."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import brute_code, brute_components
from tests.llm.test_substring_dedup import brute as brute_substrings
from tidemark.llm import queries as q

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fingerprint string, keep_id string, ids string, _text string, _id string, size string, start string"
WORDS = "the of house garden straße école niño running 2024 don't <|endoftext|> ė İstanbul".split(" ")


def rows(seed=1):
    draw = random.Random(seed)
    line = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.choice([1, 4, 90]))) for _ in range(50)]
    texts += [texts[1], texts[2], texts[2].upper(), "", None, " \t", line, line + " tail", "x " + line, "ab" * 4000, texts[3] + "\n" + texts[4]]
    return [(i, t, draw.choice(["en", "de", None]), draw.choice(["a", "b", "b", "b", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    found = rows()
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(*r, *["x"] * 8) for r in found], COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, {d: t or "" for d, t, *_ in found}, found


def packed_sha(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_op1(spark, table):
    path, texts, _ = table
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = q.op1_bpe(spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), packed_sha(ids), hashlib.sha256(text.encode()).hexdigest())


def test_op2(spark, table):
    path, texts, _ = table
    code = {d: brute_code(t, 3) for d, t in texts.items()}
    least = {c: min(d for d in code if code[d] in g) for g in map(set, brute_components(sorted(set(code.values())), 3)) for c in g}
    got = q.op2_simhash(spark, path).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{c:016x}", least[c]) for d, c in code.items()} and len(got) == len(texts)


def test_op3(spark, table):
    path, _, found = table
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in brute_substrings([(d, t) for d, t, *_ in found], 50).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in q.op3_substring_dedup(spark, path).collect()} == want


def test_op4(spark, table):
    path, texts, found = table
    got = q.op4_mixing(spark, path).collect()
    assert sorted(got) == sorted(q.op4_mixing(spark, path).collect())
    size = {d: len(t.split()) for d, t in texts.items()}
    by_source = defaultdict(int)
    for d, _, _, source, _ in found:
        by_source[source] += size[d]
    source = {d: s for d, _, _, s, _ in found}
    targets = {source[r.doc_id]: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(size.values())) and all(targets[s] <= 3 * by_source[s] + 1e-6 for s in targets)
    taken = Counter()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - targets[s]) <= max(size.values()) for s in targets)


def test_op5(spark, table):
    path, texts, _ = table
    groups = defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    want = {d: (max(groups[t]), len(groups[t]), d == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts.items()}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in q.op5_exact_dedup(spark, path).collect()} == want


def test_op8(spark, table):
    path, texts, _ = table
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for d in sorted(texts):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 0]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in q.op8_token_store(spark, path).collect()} == want


def test_op10(spark, tmp_path):
    draw = np.random.default_rng(2)
    vectors = [list(map(float, x)) for x in draw.normal(size=(300, 8)).astype(np.float32)]
    vectors[7], vectors[8], vectors[9], vectors[41] = None, [0.0] * 8, [float("nan")] + [1.0] * 7, vectors[40]
    vectors[20] = [None] + [1.0] * 7
    spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank string, query_id string").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = {i: np.array(v, np.float64) for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    got = defaultdict(dict)
    for r in q.op10_nearest(spark, str(tmp_path)).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in good if i % 20 == 0}
    hits = total = 0
    for i, found in got.items():
        true = sorted(((-float((good[i] * v).sum()), j) for j, v in good.items() if j != i))[:20]
        assert sorted(found) == list(range(1, 21))
        for j, score in found.values():
            assert j != i and score == pytest.approx(float((good[i] * good[j]).sum()), abs=1e-12)
        hits, total = hits + len({j for j, _ in found.values()} & {j for _, j in true}), total + 20
    assert hits / total >= 0.9


@pytest.mark.parametrize("texts", [[], [None, None], ["", None, "12"]])
def test_queries_and_stages_over_nothing_to_work_on(spark, tmp_path, texts):
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_bpe", "op2_simhash", "op3_substring_dedup", "op4_mixing", "op5_exact_dedup", "op6_token_counts", "op7_language_id", "op8_token_store"):
        assert q.QUERIES[name](spark, str(tmp_path)).count() == len(texts), name
    words = sum(bool((t or "").split()) for t in texts)
    distinct = len({t or "" for t in texts})
    want = {"language_id": 0, "exact_dedup": distinct, "near_dedup": distinct, "bpe": len(texts)}
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, str(tmp_path)).count()
        assert n == want.get(name, len(texts) if words else 0), name  # a source without words is no part of a mix
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_texts_and_many_sources(spark):
    """A text of 400,000 words, a URL of a megabyte, and 300 sources of which one holds a third of all rows."""
    from tidemark.llm import mixing, simhash, url_filter

    draw = random.Random(4)
    long = " ".join(f"w{draw.randrange(5000)}" for _ in range(400_000))
    texts = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text")], "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_components(texts).collect()}
    assert got[1][0] == brute_code(long, 3) and got[2][1] == got[1][1] == 1 and got[3][1] == 3
    urls = spark.createDataFrame([(1, "http://casino." + "a" * 1_000_000 + ".example/x"), (2, "http://a.example/" + "b/" * 500_000)], "page_id long, url string")
    assert {r.page_id: (len(r.host), len(r.path)) for r in url_filter.judge(urls, q.URL_RULES, url_filter.default_model(spark)).collect()} == {1: (1_000_015, 2), 2: (9, 1_000_001)}
    rows = [(i, " ".join("w" * draw.randint(1, 60)), "hot" if i % 3 == 0 else f"s{i % 299:03}") for i in range(6000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket=200).collect()
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    source = {i: s for i, _, s in rows}
    for r in mixed:
        s = source[r.doc_id]
        size[s], taken[s], target[s], largest[s] = size[s] + r.size, taken[s] + r.taken, r.target, max(largest[s], r.size)
    assert len(target) == 300 and sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
