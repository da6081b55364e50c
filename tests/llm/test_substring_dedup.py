import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup as sd


def brute(rows, window):
    first, out = {}, {}
    words = {d: (t or "").split() for d, t in rows}
    for d in sorted(x for x in words if x is not None):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def rows(seed, window):
    draw = random.Random(seed)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage = fresh(3 * window)
    out = []
    for i in range(60):
        words = fresh(draw.choice([0, 3, window, 2 * window, 5 * window]))
        for _ in range(draw.randint(0, 2)):
            at, size = draw.randrange(window), draw.choice([window - 1, window, window + 1, 2 * window])
            cut = draw.randint(0, len(words))
            words[cut:cut] = passage[at : at + size]
        out.append((draw.randrange(10**6) * 100 + i, draw.choice([" ", "\n", " \t"]).join(words)))
    out.append((10**9, out[5][1]))
    out += [(10**9 + 1, "é " * 3 * window), (10**9 + 2, "é " * 2 * window), (5, None), (None, out[7][1])]
    return out


@pytest.mark.parametrize("window", [50, 20, 7, 1])
def test_matches_brute_force(spark, window):
    data = rows(window, window)
    docs = spark.createDataFrame([(d, t, "x") for d, t in data], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.substring_dedup(docs, window).collect()}
    assert got == brute(data, window)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.substring_dedup(docs).collect()) == [(1, 0), (1, 0), (2, 80)]
    assert sd.substring_dedup(docs.limit(0)).count() == 0


def test_covers_hold_every_difference():
    for period, cover in sd.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def shared_batch(*rows):
    return pa.record_batch({"_key": pa.array([r[0] for r in rows], pa.int64()), "_doc": pa.array([r[1] for r in rows], pa.int64()), "_place": pa.array([r[2] << 2 for r in rows], pa.int64())})


def test_shared_passes_hold_across_batches():
    got = [r for b in sd._shared([shared_batch((1, 1, 0), (2, 1, 1)), shared_batch((2, 1, 5)), shared_batch((2, 3, 2)), shared_batch((2, 4, 9), (3, 1, 1))]) for r in zip(*b.to_pydict().values())]
    assert got == [(1, 1), (1, 5), (3, 2), (4, 9)]


def test_a_passage_that_most_documents_have_loads_its_task_with_one_row_a_batch(spark, monkeypatch):
    draw = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(i, " ".join([*(f"w{draw.randrange(10**6)}" for _ in range(20)), *([passage] if i % 3 else [])])) for i in range(1, 400)]
    doc = np.array([d for d, t in data if passage in t])
    dealt = sd._dealt(doc, np.full(len(doc), 20), np.full(len(doc), 77), np.full(len(doc), 5))
    assert (dealt["_key"] == 77).sum() == 1 and len(set(dealt["_key"].tolist())) == len(doc)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), 50).collect()}
    assert got == brute(data, 50)


def test_a_very_long_text(spark):
    draw = random.Random(9)
    words = [f"w{draw.randrange(10**5)}" for _ in range(300_000)]
    data = [(1, " ".join(words[200_000:200_070])), (2, " ".join(words)), (3, " ".join(words[100:155]))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), 50).collect()}
    assert got == {1: (70, 0), 2: (300_000, 70), 3: (55, 55)}
