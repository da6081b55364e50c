"""Exact quantiles against numpy, with sketches too coarse to give them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import summaries
from tidemark.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def some_rows(n=6000):
    draw = random.Random(3)
    rows = []
    for _ in range(n):
        g = draw.choice(["a"] * 6 + ["b", None])
        v = {"a": draw.choice([7.5] * 3 + [draw.lognormvariate(0, 4)]), "b": draw.gauss(0, 1), None: float(draw.randrange(5))}[g]
        rows.append((g, draw.choice([1, 1, 1, None]), None if draw.random() < 0.05 else v))
    return [*rows, ("one", 1, 4.0), ("none", 1, None), ("two", 2, 1.0), ("two", 2, 2.0)]


@pytest.mark.parametrize("accuracy", [50, 400, 100_000])
def test_quantiles(spark, accuracy):
    rows = some_rows()
    got = exact_quantiles(spark.createDataFrame(rows, "g string, k int, x double").repartition(9), ["g"], "x", SHARES, accuracy).collect()
    values = {}
    for g, _, x in rows:
        values.setdefault(g, []).extend([] if x is None else [x])
    assert len(got) == len(values)
    for r in got:
        assert r.n == len(values[r.g]) and (r.quantiles is None if not r.n else r.quantiles == pytest.approx(list(np.quantile(values[r.g], SHARES)), rel=1e-12))


def test_no_range_holds_a_whole_group(spark):
    """What the second pass gathers of a group of 20,000 values is a small part of it."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.rand(1).alias("x"))
    out = exact_quantiles(df, ["g"], "x", (0.5,), accuracy=1000)
    want = df.agg(F.percentile("x", 0.5)).first()[0]
    assert out.first().quantiles == [pytest.approx(want)]
    near = df.agg(F.percentile_approx("x", [0.495, 0.505], 1000)).first()[0]
    assert df.where(F.col("x").between(*near)).count() < 400


def test_same_rows_as_the_built_in_functions(spark):
    df = spark.createDataFrame(some_rows(2000), "g string, k int, x double")
    as_rows = lambda d: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in d.collect())
    assert as_rows(summaries.group_medians(df, ["g", "k"], ["x"])) == as_rows(df.groupBy("g", "k").agg(F.count("*"), F.median("x")))
    assert as_rows(summaries.distribution(df, ["g"], "x")) == as_rows(df.groupBy("g").agg(F.count("x"), F.min("x"), F.median("x"), F.avg("x"), F.max("x")))
