import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score double"


def brute(rows, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 5 == 0:
            scored = sorted(((-float((good[q] * good[c]).sum()), c) for c in good if c != q))
            out[q] = [(c, -s) for s, c in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def vectors(n=400, seed=1):
    draw = np.random.default_rng(seed)
    rows = [(i, (draw.normal(size=8) * draw.uniform(0.5, 2)).astype(np.float32).tolist(), 0.0) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same, 0.0) for i in range(60)] + [(1000, None, 0.0), (1005, [0.0] * 8, 0.0), (1010, [float("nan")] * 8, 0.0), (1015, [None] + [1.0] * 7, 0.0), (1020, [float("inf")] * 8, 0.0), (1025, [1.0] * 3, 0.0), (None, same, 0.0), rows[0]]
    return rows


def test_whole_windows_are_exact(spark):
    rows = vectors()
    got, want = found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, k=7, half_width=10_000, block=64)), brute(rows, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [c for c, _ in got[q]] == [c for c, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_measured_windows_reach_the_recall(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.1 * draw.normal(size=8)).astype(np.float32).tolist(), 0.0) for i in range(1200)]
    got, want = found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, k=10, block=64)), brute(rows, 10)
    hits = [len({c for c, _ in got[q]} & {c for c, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9


def test_few_or_no_vectors(spark):
    search = lambda rows: found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, k=5))
    assert search([]) == {} and search([(5, [1.0] * 8, 0.0)]) == {}
    assert search([(5, [1.0] * 8, 0.0), (6, [2.0] * 8, 0.0)]) == {5: [(6, 16.0)]}


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_visits_every_cell_by_single_steps(dims):
    side = np.arange(8)
    cells = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = ann.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(8**dims))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_queries_come_in_bounded_slices_and_chunks(spark):
    rows = vectors()
    got, want = found(ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, k=7, half_width=10_000, block=64, queries_at_once=10)), brute(rows, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    q, x = np.random.default_rng(3).normal(size=(50, 8)), np.random.default_rng(4).normal(size=(30, 8))
    near = list(ann.products(q, x, 100))
    assert np.allclose(near, q @ x.T) and max(n.base.size for n in near) <= 100
