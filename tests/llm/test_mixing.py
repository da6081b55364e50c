import random

import numpy as np
import pytest

from tidemark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        target = {s: limit * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > limit * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(seed, n=900):
    draw = random.Random(seed)
    names = ["a", "b", "é", "Z", None, "zz", "", "tiny"]
    rows = []
    for i in range(n):
        source = draw.choices(names, [1, 2, 3, 30, 5, 1, 2, 0.02])[0]
        rows.append((i, source, None if i % 50 == 0 else " ".join("w" for _ in range(int(draw.paretovariate(1)) % 400)), "x"))
    return rows


@pytest.mark.parametrize(("seed", "bucket"), [(1, 2_000), (2, 40), (3, 5)])
def test_targets_and_taken_words(spark, seed, bucket):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target string")
    got = mixing.mix(docs, bucket=bucket).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    size = {d: len((t or "").split()) for d, _, t, _ in rows}
    source = {d: s for d, s, _, _ in rows}
    sizes = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    want = brute_targets(sizes)
    for s, target in want.items():
        own = [r for r in got if source[r.doc_id] == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target, rel=1e-9) for r in own)
        longest = max([r.size for r in own], default=0)
        assert abs(sum(r.taken for r in own) - target) <= longest
        expected = (target / sizes[s] if sizes[s] else 0) * len(own)
        assert abs(sum(r.times for r in own) - expected) <= 2
    assert all(r.size == size[r.doc_id] and r.taken == r.times * r.size and 0 <= r.times <= 3 for r in got)
    again = mixing.mix(docs.repartition(7), bucket=bucket).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_flight_keeps_both_totals_and_leaves_two():
    draw = np.random.default_rng(1)
    for sizes in (draw.integers(0, 1000, 500), np.full(300, 7), np.array([5, 5, 5, 9, 9])):
        p = draw.random(len(sizes))
        after = mixing.flight(sizes, p, 0)
        assert after.sum() == pytest.approx(p.sum()) and (after * sizes).sum() == pytest.approx((p * sizes).sum())
        assert ((after > 0) & (after < 1)).sum() <= 2


def test_inclusion_follows_the_chances():
    sizes, p = np.arange(1, 41), np.full(40, 0.3)
    hits = np.mean([mixing.landing(sizes, mixing.flight(sizes, p, k), k) for k in range(600)], axis=0)
    assert abs(hits.mean() - 0.3) < 0.02 and hits.min() > 0.15 and hits.max() < 0.45


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a", "x y"), (1, "a", "x y"), (None, "b", "z"), (None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and all(r.times <= 3 for r in got)


def test_mixed_repeats_rows(spark):
    rows = [(i, s, "w " * (i % 9), 1, 2) for i in range(200) for s in ["a" if i < 20 else "b"]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, times int, _copy int")
    times = {r.doc_id: r.times for r in mixing.mix(docs).collect()}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, n in times.items() for _ in range(n))
