"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tidemark.llm import queries, resample


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    """rows of (id, text) to a list of (id, n_features, weight, score, rank)."""

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    def found(text):
        w = split(text)
        return [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(b for _, x in rows for b in found(x)), Counter(b for x in target for b in found(x))
    n_s, n_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        f = found(text)
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r, (_, x) in zip(out, rows) if len(split(x)) >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k for k, r in enumerate(enough[: percent * len(enough) // 100], 1)}
    return [(*r, rank.get(id(r))) for r in out]


def order(rows):
    return sorted(rows, key=str)


def some_rows(seed, n=400):
    draw = random.Random(seed)
    vocabulary = ["The", "of", "straße", "École", "x1", "2024", "don't", "über-all", "日本", "a_b"] + [f"w{i}" for i in range(200)]
    texts = [draw.choice(["", " ", "\n"]).join([" ".join(draw.choices(vocabulary, k=draw.choice([1, 19, 20, 21, 60])))]) for _ in range(n)]
    texts += [texts[0]] * 150 + ["", None, " .,; ", "word " * 5000]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    return rows, [" ".join(draw.choices(vocabulary[:60], k=30)) for _ in range(40)] + [None, "", texts[0]]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 50, 33), (3, 1000, 100)])
def test_resample(spark, longest, buckets, percent):
    rows, target = some_rows(longest)
    rows = [(i if i != 7 else None, t) for i, t in rows]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, weight string, rank long").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, goal, percent=percent, longest=longest, buckets=buckets).collect()
    want = brute(rows, target, longest, buckets, percent=percent)
    assert order(map(tuple, got)) == order(want)
    kept = resample.drawn(docs, goal, percent=percent, longest=longest, buckets=buckets)
    assert kept.columns == docs.columns and order(r.doc_id for r in kept.collect()) == order(r[0] for r in want if r[4])


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(resample, "noise", lambda id_col, seed: resample.F.lit(0).cast("long"))
    docs = spark.createDataFrame([(i, "same words " * 15) for i in range(60)], "doc_id long, text string").repartition(7)
    got = resample.resample(docs, docs.select("text").limit(1), percent=25).where("rank is not null").collect()
    assert {r.doc_id: r.rank for r in got} == {i: i + 1 for i in range(15)}


def test_query(spark, tmp_path):
    rows, target = some_rows(8)
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = queries.op13_resample(spark, str(tmp_path))
    assert dict(df.dtypes) == dict.fromkeys(df.columns, "bigint") and order(map(tuple, df.collect())) == order(brute(rows, target))


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert order(map(tuple, queries.op13_resample(spark, sf).collect())) == order(brute(rows, target))


@pytest.mark.parametrize("texts", [[], [None], ["", None, "few words"]])
def test_nothing_to_draw(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = resample.resample(docs, docs.where("false")).collect()
    assert len(got) == len(texts) and all(r.rank is None for r in got)
