"""Data-quality checks as rows: name, passed, value. A suite reads each table a fixed number of times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_checks(df: DataFrame, label: str, violations: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule (a null condition breaks none), in one pass over the table."""
    counts = df.agg(F.count("*").alias("_rows"), *(F.count_if(c).alias(n) for n, c in violations.items()))
    entry = lambda n: F.struct(F.lit(f"{label}.{n}").alias("name"), (F.col(n) == 0).alias("passed"), F.col(n).alias("value"))
    return counts.select(F.inline(F.array(*map(entry, violations))))


def count_at_least(df: DataFrame, label: str, minimum: int = 1) -> DataFrame:
    n = df.agg(F.count("*").alias("value"))
    return n.select(F.lit(f"{label}.rows").alias("name"), (F.col("value") >= minimum).alias("passed"), "value")


def unique_keys(df: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """How many keys are repeated."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("value"))
    return n.select(F.lit(f"{label}.duplicate_keys").alias("name"), (F.col("value") == 0).alias("passed"), "value")


def orphans(df: DataFrame, parent: DataFrame, label: str, key: str, parent_key: str) -> DataFrame:
    """How many rows point to no parent."""
    lost = df.join(parent.select(F.col(parent_key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_anti")
    return lost.agg(F.count("*").alias("value")).select(F.lit(f"{label}.orphans").alias("name"), (F.col("value") == 0).alias("passed"), "value")


def period_coverage(df: DataFrame, label: str, period: str, first: int, last: int) -> DataFrame:
    """How many periods of a range have no row."""
    n = df.where(F.col(period).between(first, last)).agg((F.lit(last - first + 1) - F.count_distinct(period)).alias("value"))
    return n.select(F.lit(f"{label}.missing_periods").alias("name"), (F.col("value") == 0).alias("passed"), "value")


def same_keys(a: DataFrame, b: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """How many keys only one of the two tables has."""
    one = a.select(*keys).distinct().withColumn("_a", F.lit(True)).join(b.select(*keys).distinct().withColumn("_b", F.lit(True)), list(keys), "full")
    n = one.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("value"))
    return n.select(F.lit(f"{label}.key_differences").alias("name"), (F.col("value") == 0).alias("passed"), "value")


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def column_spec(df: DataFrame, label: str, unique: Sequence[str] = (), constant: Mapping[str, object] | None = None, all_true: Sequence[str] = (), all_false: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """Checks declared by column: required without nulls, unique keys, one constant value, all true or all false."""
    rules = {f"{c}_null": F.col(c).isNull() for c in required}
    rules |= {f"{c}_not_constant": ~F.col(c).eqNullSafe(F.lit(v)) for c, v in (constant or {}).items()}
    rules |= {f"{c}_not_true": ~F.coalesce(c, F.lit(False)) for c in all_true} | {f"{c}_not_false": F.coalesce(c, F.lit(True)) for c in all_false}
    return suite(row_checks(df, label, rules), *([unique_keys(df, label, unique)] if unique else []))


def prediction_rules(appearance: str, start: str, minutes: str, points: str) -> dict[str, Column]:
    """Ranges and order of the parts of a prediction."""
    share = lambda c: ~F.col(c).between(0, 1)
    return {"appearance_range": share(appearance), "start_range": share(start), "start_above_appearance": F.col(start) > F.col(appearance), "minutes_range": ~F.col(minutes).between(0, 90), "points_null": F.col(points).isNull()}


def chance_rules(*chances: str, tolerance: float = 1e-5) -> dict[str, Column]:
    """Chances from 0 to 1 that sum to one, all there or none."""
    total = reduce(lambda a, b: a + b, map(F.col, chances))
    outside = reduce(lambda a, b: a | b, (~F.col(c).between(0, 1) for c in chances))
    nulls = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in chances))
    return {"chance_range": outside, "chance_sum": F.abs(total - 1) > tolerance, "chances_partly_null": (nulls > 0) & (nulls < len(chances))}


def output_rules(price: str, cost: str, triple: Sequence[str], low: str, value: str, high: str) -> dict[str, Column]:
    """A cost that is ten times the price up to rounding, three values that are all there or none, and a value within its bounds."""
    nulls = reduce(lambda a, b: a + b, (F.col(c).isNull().cast("int") for c in triple))
    return {"price_and_cost": F.abs(F.col(price) * 10 - F.col(cost)) > 0.51, "triple_partly_null": (nulls > 0) & (nulls < len(triple)), "outside_bounds": (F.col(value) < F.col(low)) | (F.col(value) > F.col(high))}


def coverage(df: DataFrame, parent: DataFrame, label: str, key: str, parent_key: str, least: float) -> DataFrame:
    """Which share of the parent's keys the table has, and whether it is enough. value is the share in per mille, rounded down."""
    seen = parent.select(F.col(parent_key).alias("_key")).distinct().join(df.select(F.col(key).alias("_key"), F.lit(True).alias("_seen")).distinct(), "_key", "left")
    share = seen.agg((F.count_if("_seen") / F.count("*")).alias("_share"))
    return share.select(F.lit(f"{label}.coverage").alias("name"), F.coalesce(F.col("_share") >= least, F.lit(False)).alias("passed"), F.floor(F.coalesce("_share", F.lit(0.0)) * 1000).alias("value"))
