import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import STRIDE, meeting
from tidemark.llm.components import components


def brute_code(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius):
    parent = {c: c for c in codes}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in codes:
        for b in codes:
            if a < b and bin(a ^ b).count("1") <= radius:
                parent[root(b)] = root(a)
    groups = {}
    for c in codes:
        groups.setdefault(root(c), set()).add(c)
    return sorted(map(sorted, groups.values()))


def planted(n=600, seed=1):
    draw = random.Random(seed)
    base = [draw.getrandbits(64) for _ in range(n)]
    for c in base[: n // 3]:
        for _ in range(3):
            for b in draw.sample(range(64), draw.randint(1, 4)):
                c ^= 1 << b
            base.append(c)
    hub = draw.getrandbits(64)
    base += [hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    return sorted(set(base))


@pytest.mark.parametrize("limit", [simhash.GROUP_LIMIT, 50])
def test_links_connect_exactly_what_brute_force_connects(spark, limit):
    codes = planted()
    rows = spark.createDataFrame([(simhash.signed(c),) for c in codes], "_code long")
    links = simhash.hamming_links(rows, 3, simhash.runs(list(range(64)), 4), group_limit=limit).collect()
    parent = {c: {c} for c in codes}
    for r in links:
        a, b = r.src % 2**64, r.dst % 2**64
        if parent[a] is not parent[b]:
            parent[a] |= parent[b]
            for c in parent[b]:
                parent[c] = parent[a]
    assert sorted({tuple(sorted(g)) for g in parent.values()}) == [tuple(g) for g in brute_components(codes, 3)]


def test_pairs_in_a_group():
    codes = np.array(planted(200), dtype=np.uint64)
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    codes = codes[np.argsort(rank)]
    got = {tuple(sorted((int(codes[u]), int(codes[v])))) for us, vs, _ in simhash.close_pairs(np.array([0]), codes, 5) for u, v in zip(us, vs)}
    assert got == {(int(a), int(b)) for a in codes for b in codes if a < b and bin(int(a) ^ int(b)).count("1") <= 5}


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def texts(seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(40):
        words = [draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(draw.choice([2, 30, 120]))]
        rows.append(" ".join(words))
        if i % 4 == 0 and len(words) > 100:
            words[50] = "edited"
            rows += [" ".join(words), " ".join(words).upper()]
    return rows + ["", None, " \t", "one two", "One  TWO", "É é"]


def test_components_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, texts()[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.near_components(docs).collect()
    assert len(got) == len(rows)
    code = {i: brute_code(t, 3) for i, t, _ in rows}
    groups = brute_components(sorted(set(code.values())), 3)
    least = {c: min(i for i in code if code[i] in g) for g in map(set, groups) for c in g}
    for r in got:
        assert r.fingerprint == f"{code[r.doc_id]:016x}" and r.component_id == least[code[r.doc_id]]
    assert simhash.near_components(docs.limit(0)).count() == 0
    nulls = simhash.near_components(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).collect()
    assert [r.component_id for r in nulls] == [None, None]


def test_near_dedup_keeps_one_of_each_group_and_all_others(spark):
    draw = random.Random(5)
    base = [[draw.choice(WORDS) + str(draw.randint(0, 999)) for _ in range(200)] for _ in range(30)]
    rows, kept = [], []
    for i, words in enumerate(base):
        kept.append(100 * i)
        rows.append((100 * i, " ".join(words), 1))
        for j in range(i % 3):
            copy = list(words)
            copy[draw.randrange(200)] = "changed"
            rows.append((100 * i + j + 1, " ".join(copy), 1))
        far = words[:100] + [draw.choice(WORDS) for _ in range(100)]
        rows.append((100 * i + 50, " ".join(far), 1))
        kept.append(100 * i + 50)
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, _gone int"))
    assert got.columns == ["doc_id", "text", "_gone"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)


def test_jaccard():
    assert simhash.jaccard("a b c d e f", "A b c d e f", 5) == 1.0
    assert simhash.jaccard("", None, 5) == 1.0 and simhash.jaccard("a", "", 5) == 0.0
    assert simhash.jaccard("a b c d e f", "a b c d e g", 5) == pytest.approx(1 / 3)


def test_gray_rank_orders_like_the_gray_sequence(spark):
    codes = [i ^ (i >> 1) for i in range(64)]
    got = spark.createDataFrame([(c,) for c in codes], "c long").select(simhash.gray_rank(F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == list(range(64))


def near_rows(spark, rows, **how):
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def brute_near(rows):
    """Root of every row that shares 0.8 or more with another, over all pairs."""
    sets = {i: simhash.shingle_set(t, 5) for i, t in rows}
    root = {i: i for i, _ in rows}
    for a in root:
        for b in root:
            if a < b and root[a] != root[b] and simhash.alike(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: r for i, r in root.items() if list(root.values()).count(r) > 1}


def test_every_pair_at_the_threshold_is_found(spark):
    """Pairs from just below to just above 0.8, as many edits as that takes, are told apart as all pairs tell them."""
    draw, rows = random.Random(11), []
    for i in range(300):
        words = [f"{draw.choice(WORDS)}{draw.randint(0, 9999)}" for _ in range(draw.choice([12, 60, 200]))]
        copy = list(words)
        for j in draw.sample(range(len(words)), max(1, round(len(words) * draw.choice([0.015, 0.02, 0.025])))):
            copy[j] = f"edit{i}x{j}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    assert near_rows(spark, rows) == brute_near(rows)


@pytest.mark.parametrize("cell", [simhash.CELL, 20])
def test_copies_that_only_the_template_joins_are_found(spark, cell):
    """Many edited copies of one template, each alike to it alone: the template is not crowded out of the proposals."""
    draw = random.Random(12)
    words = [f"{draw.choice(WORDS)}{draw.randint(0, 9999)}" for _ in range(200)]
    rows = [(70, " ".join(words))]
    for i in range(150):
        copy = list(words)
        for j in draw.sample(range(200), 4):
            copy[j] = f"edit{i}x{j}"
        rows.append((i if i < 70 else i + 1, " ".join(copy)))
    want = brute_near(rows)
    assert len(want) == len(rows) and near_rows(spark, rows, cell=cell) == want


def together(*args, **how):
    return [np.concatenate(x) for x in zip(*simhash.proposals(*args, **how))]


def test_proposals_that_do_not_fit_a_round_are_left_for_the_next():
    group, part = np.zeros(9, np.int64), np.arange(9)
    u, v, more = together(group, group, group + 10, part, 2, 0.8)
    assert len(u) == 15 and (v < u).all() and more.tolist() == [0]
    u, v, more = together(group, group, group + 10, part, 8, 0.8)
    assert len(u) == 36 and not len(more)
    u, v, more = together(group, group, group + 10, part // 5, 8, 0.8)
    assert len(u) == 20 and not len(more)


def test_proposals_of_a_large_group_come_in_slices():
    """16,000 members that may all be alike: no slice has more than some 300,000 of the pairs."""
    group = np.zeros(16_000, np.int64)
    slices, total = 0, 0
    for u, v, more in simhash.proposals(group, group, group + 10, np.arange(16_000), 300, 0.8):
        slices, total = slices + 1, total + len(u)
        assert len(u) == len(v) <= simhash.PAIRS_AT_ONCE + 16_000
    assert total == sum(min(300, i) for i in range(16_000)) and slices > 10 and more.tolist() == [0]


def test_a_text_with_many_partners(spark):
    """300 copies at the same distance from one text, which are compared with five copies of it, and rows that repeat an id."""
    draw = random.Random(21)
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(120)]
    rows = [(0, " ".join(words))] + [(i, " ".join([*words[:-2], f"end{i}", f"last{i}"])) for i in range(1, 301)] + [(1, "another text altogether with words of its own"), (400, "another text altogether with words of its own")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 0) for i in [*range(301), 400]}


def test_texts_that_share_a_fingerprint_are_compared_with_each_other(spark):
    """One frequent line gives unlike texts one fingerprint; copies that repeat passages differ in theirs. Both are told by their sets."""
    draw = random.Random(13)
    line = " ".join(f"line{i}" for i in range(13))
    unlike = [[f"w{draw.randint(0, 10**6)}" for _ in range(60)] for _ in range(3)]
    rows = [(0, " ".join([line] * 400 + unlike[0]))]
    rows += [(i, " ".join([line] * 400 + unlike[1][: 60 - i])) for i in (1, 2)]
    rows += [(10, " ".join(unlike[2])), (11, " ".join(unlike[2] + unlike[2][:30] * 20))]
    assert len({simhash.fingerprint(t, 2) for _, t in rows[:3]}) == 1
    assert near_rows(spark, rows) == brute_near(rows) == {1: 1, 2: 1, 10: 10, 11: 10}


def test_rows_without_company_are_left_out():
    """However the rows are dealt to batches, those whose shingle another row has stay, and no others."""
    draw = random.Random(14)
    for _ in range(60):
        shingles = [draw.randrange(40) for _ in range(draw.randint(0, 60))]
        rows = []
        for start in range(0, len(shingles), 12):  # as the map tasks see them
            part = np.array(shingles[start : start + 12])
            key, state = meeting([part], np.arange(len(part)), np.arange(len(part)) * STRIDE)
            rows += list(zip(key.tolist(), state.tolist(), part.tolist()))
        rows.sort(key=lambda r: r[0])
        cuts = sorted(draw.sample(range(len(rows) + 1), min(len(rows), 4)))
        batches = [pa.record_batch({"_place": pa.array([r[1] for r in b], pa.int64()), "_shingle": pa.array([r[2] for r in b], pa.int64())}) for x, y in zip([0, *cuts], [*cuts, len(rows)]) for b in [rows[x:y]]]
        got = Counter(s for b in simhash._company(batches) for s in b.column("_shingle").to_pylist())
        assert got == Counter({s: n for s, n in Counter(shingles).items() if n > 1})


def test_parities_never_show_more_than_the_sets_differ_in():
    draw = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 3), (1, 1), (300, 290), (1000, 1100), (5000, 400), (70_000, 30_000)):
        a = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: m // 2], draw.integers(0, 2**64, m - m // 2, dtype=np.uint64)]))
        assert simhash.shown(simhash.parity(a), simhash.parity(b)) <= len(np.setxor1d(a, b))
        assert simhash.shown(simhash.parity(a), simhash.parity(a)) == 0


def test_a_third_of_the_rows_in_one_group_of_copies(spark):
    """One task meets a cell of the group, not all of it, and the result is that of all pairs."""
    draw = random.Random(15)
    words = [f"{draw.choice(WORDS)}{draw.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(180):
        copy = list(words) if i < 60 else [f"{draw.choice(WORDS)}{draw.randint(0, 9999)}" for _ in range(40)]
        copy[draw.randrange(40)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    want = brute_near(rows)
    assert len(want) == 60 and near_rows(spark, rows, cell=8) == want


def test_a_hub_of_links(spark):
    """Fingerprints that all link to one are one component, as are chains; the hub's links lie in many partitions."""
    edges = [(7, n) for n in range(100, 2100)] + [(n, n + 1) for n in range(3000, 3100)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(roots[n] == 7 for n in [7, *range(100, 2100)]) and all(roots[n] == 3000 for n in range(3000, 3101))
