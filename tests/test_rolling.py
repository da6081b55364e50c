import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rolling as r

ROWS = [("a", 1, 10, 90), ("a", 2, 20, 0), ("a", 3, 30, 60), ("b", 1, 1, 0), ("b", 2, 2, 0), ("b", 3, 3, 45), ("c", 1, 5, 5)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "who string, t long, x long, m long")


def values(df, c):
    return {(x.who, x.t): x[c] for x in df.collect()}


def test_windows_stay_in_their_entity_and_before_the_row(frame):
    got = values(frame.withColumn("y", r.trailing_mean("x", ["who"], ["t"], 3)), "y")
    assert got == {("a", 1): None, ("a", 2): 10, ("a", 3): 15, ("b", 1): None, ("b", 2): 1, ("b", 3): 1.5, ("c", 1): None}


def test_rate_denominators(frame):
    slots = values(frame.withColumn("y", r.trailing_rate(F.col("m") > 0, ["who"], ["t"], 5)), "y")
    seen = values(frame.withColumn("y", r.trailing_rate(F.col("m") > 0, ["who"], ["t"], 5, "observed")), "y")
    assert slots[("a", 2)] == 0.5 and seen[("a", 2)] == 1.0 and slots[("a", 3)] == pytest.approx(1 / 3) and seen[("a", 3)] == 0.5


def test_since_last_zero_and_absence(spark):
    rows = spark.createDataFrame([("a", t, m) for t, m in enumerate([3, 2, 0, 1, 1, 0, 4], 1)], "who string, t long, m long")
    out = r.numbered(rows, ["who"], ["t"]).select("who", "t", r.since_last_zero("m", ["who"], ["t"], 8).alias("s"), r.entering_absence("m", ["who"], ["t"]).alias("e"))
    assert [(x.s, x.e) for x in out.orderBy("t").collect()] == [(None, False), (2, False), (3, False), (0, True), (1, False), (2, False), (0, True)]


def test_deviation_needs_two_rows(frame):
    got = values(frame.withColumn("y", r.trailing_std("x", ["who"], ["t"], 5)), "y")
    assert got[("a", 2)] is None and got[("a", 3)] == pytest.approx(math.sqrt(50))


def test_percent_rank_with_ties(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("g", 3, 7), ("g", 4, 1)], "who string, t long, x long")
    assert values(rows.withColumn("y", r.percent_rank_ties("x", ["who"])), "y") == {("g", 1): 0.625, ("g", 2): 0.625, ("g", 3): 1.0, ("g", 4): 0.25}


def test_rolling_form_drops_first_rows(frame):
    got = r.rolling_form(frame, ["who"], ["t"], ["x"], (3,))
    assert sorted((x.who, x.t, x.x_last1) for x in got.collect()) == [("a", 2, 10), ("a", 3, 20), ("b", 2, 1), ("b", 3, 2)]


def test_active_mean_and_empty(frame):
    got = r.active_mean(frame, frame, ["who"], "t", "x", 3, 2)
    assert sorted((x.who, x.predicted) for x in got.collect()) == [("a", 15.0), ("b", 1.5), ("c", 5.0)]
    assert r.rolling_form(frame.limit(0), ["who"], ["t"], ["x"]).count() == 0
