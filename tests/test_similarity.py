"""Similarity joins against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import matching_ratio
from tidemark.operators import identity as idt
from tidemark.operators import similarity as sim


def spoilt(name, draw, edits):
    """A name with letters inserted, dropped and changed anywhere, both ends included."""
    for _ in range(edits):
        at = draw.choice([0, len(name), draw.randrange(len(name) + 1)])
        name = draw.choice([name[:at] + draw.choice("abcxyz ") + name[at:], name[:at] + name[at + 1 :], name[: max(0, at - 1)] + draw.choice("aeiou") + name[at:]])
    return name


def pools(seed, n=60):
    draw = random.Random(seed)
    first, last = ["john", "ann", "maria", "joao", "li", "o"], ["smith", "smithson", "garcia", "fernandes", "ng", "van dijk", "aaaaaaaa", "aaaabaaaa"]
    names = [f"{draw.choice(first)} {draw.choice(last)}" for _ in range(n)]
    return [*names, "", None, "a", "ab", "smith"], [*(spoilt(x, draw, draw.randrange(4)) for x in names), "", None, "a", "b", "smith"]


def frames(spark, seed):
    left, right = pools(seed)
    return left, right, spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def every(left, right):
    return {(x, y) for x in left if x for y in right if y}


@pytest.mark.parametrize("edits,limit,rounds", [(0, 1000, 1), (1, 1000, 3), (2, 4, 3), (2, 2, 1), (3, 3, 2)])
def test_within_edits(spark, edits, limit, rounds):
    left, right, a, b = frames(spark, edits)
    got = {(r.a, r.b): r.distance for r in sim.within_edits(a, b, "a", "b", edits, group_limit=limit, rounds=rounds).collect()}
    assert got == {(x, y): d for x, y in every(left, right) if (d := distance(x, y)) <= edits} and len(got) > 20


@pytest.mark.parametrize("minimum,limit", [(0.7, 1000), (0.8, 3), (0.9, 1000), (0.9, 2), (1.0, 5)])
def test_similar_pairs(spark, minimum, limit):
    left, right, a, b = frames(spark, 9)
    got = {(r.a, r.b): r.ratio for r in sim.similar_pairs(a, b, "a", "b", minimum, group_limit=limit).collect()}
    assert got == {(x, y): r for x, y in every(left, right) if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= minimum} and len(got) > 5


def test_low_ratio_is_refused():
    with pytest.raises(ValueError):
        sim.within_ratio(0.6)


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_contained_pairs(spark, share):
    left, right, a, b = frames(spark, 3)
    got = {tuple(r) for r in sim.contained_pairs(a, b, "a", "b", share).collect()}
    assert got == {(x, y) for x, y in every(left, right) if (x in y or y in x) and min(len(x), len(y)) >= share * max(len(x), len(y)) - 1e-9}


def test_letter_bound_is_above_the_ratio(spark):
    _, _, a, b = frames(spark, 4)
    rows = a.where("length(a) > 0").crossJoin(b.where("length(b) > 0")).select(sim.letter_bound("a", "b").alias("bound"), matching_ratio("a", "b").alias("ratio"))
    assert rows.where("bound < ratio - 1e-12").isEmpty() and not rows.where("bound < 0.5").isEmpty()


@pytest.mark.parametrize("minimum,limit", [(0.9, 3), (0.8, 1000)])
def test_scored_pairs_equal_those_over_all_pairs(spark, minimum, limit):
    left, right = pools(5)
    a = spark.createDataFrame([(i, x) for i, x in enumerate(left)], "l long, name string")
    b = spark.createDataFrame([(i, x) for i, x in enumerate(right)], "r long, other string")
    a, b = idt.with_variants(a, "name"), idt.with_variants(b, "other").withColumnRenamed("variants", "others")
    got = idt.scored_pairs(a, b, "l", "r", "variants", "others", minimum, group_limit=limit)
    full = idt.variant_score(a.crossJoin(b), "variants", "others", ["l", "r"]).where(F.col("name_score") >= minimum)
    as_set = lambda df: {(r.l, r.r, round(r.name_score, 9)) for r in df.collect()}
    assert as_set(got) == as_set(full) and got.count() == full.count()
