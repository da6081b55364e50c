"""Leakage-safe trailing features of entities over ordered periods.

Every window lies inside one entity and ends before the current row, so no row sees itself or another
entity. Orderings must end in a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def ordered(entity: Keys, order: Keys) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(*order)


def trailing(entity: Keys, order: Keys, width: int | None) -> WindowSpec:
    """The `width` rows before the current one (None: all of them)."""
    return ordered(entity, order).rowsBetween(Window.unboundedPreceding if width is None else -width, -1)


def trailing_mean(x: str | Column, entity: Keys, order: Keys, width: int) -> Column:
    return F.avg(x).over(trailing(entity, order, width))


def trailing_sum(x: str | Column, entity: Keys, order: Keys, width: int | None) -> Column:
    return F.sum(x).over(trailing(entity, order, width))


def trailing_count_if(condition: Column, entity: Keys, order: Keys, width: int) -> Column:
    """How many of the rows before meet the condition; null on an entity's first row."""
    return F.sum(F.when(condition, 1).otherwise(0)).over(trailing(entity, order, width))


def trailing_rate(condition: Column, entity: Keys, order: Keys, width: int, denominator: str = "slots") -> Column:
    """Share of the rows before that meet the condition.

    `slots` counts the empty place before an entity's first row as a row, as a rolling apply over
    shifted values does: least(width, row number). `observed` divides by the rows that are there.
    """
    met = trailing_count_if(condition, entity, order, width)
    if denominator == "observed":
        return met / F.count(F.lit(1)).over(trailing(entity, order, width))
    return met / F.least(F.lit(width), F.row_number().over(ordered(entity, order)))


def trailing_std(x: str | Column, entity: Keys, order: Keys, width: int) -> Column:
    """Sample deviation; null on fewer than two rows."""
    return F.stddev_samp(x).over(trailing(entity, order, width))


def trend(x: str | Column, entity: Keys, order: Keys, short: int, long: int) -> Column:
    """Short mean less long mean."""
    return trailing_mean(x, entity, order, short) - trailing_mean(x, entity, order, long)


def entering_absence(x: str, entity: Keys, order: Keys) -> Column:
    """The row before is zero and the one before it was not."""
    w = ordered(entity, order)
    return F.coalesce((F.lag(x, 1).over(w) == 0) & (F.lag(x, 2).over(w) > 0), F.lit(False))


def since_last_zero(x: str, entity: Keys, order: Keys, width: int) -> Column:
    """Rows since the last zero among the `width` rows before; the number of slots if there is none, null on the first row."""
    rn = F.row_number().over(ordered(entity, order))
    last = F.max(F.when(F.col(x) == 0, F.col("_rn"))).over(trailing(entity, order, width))
    return F.when(rn > 1, F.coalesce(rn - 1 - last, F.least(F.lit(width), rn)))


def numbered(df: DataFrame, entity: Keys, order: Keys) -> DataFrame:
    """`df` with _rn, the row number within the entity."""
    return df.withColumn("_rn", F.row_number().over(ordered(entity, order)))


def rolling_form(df: DataFrame, entity: Keys, order: Keys, measures: Sequence[str], widths: Sequence[int] = (3, 5, 8)) -> DataFrame:
    """`df` with `<measure>_last1` and `<measure>_mean<w>` of each measure; the rows without a row before are dropped."""
    w = ordered(entity, order)
    out = df.withColumns({f"{m}_last1": F.lag(m, 1).over(w) for m in measures} | {f"{m}_mean{n}": trailing_mean(m, entity, order, n) for m in measures for n in widths})
    return out.na.drop(subset=[f"{m}_last1" for m in measures])


def last_per_group(df: DataFrame, group: Keys, order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") == 1).drop("_place")


def top_per_group(df: DataFrame, group: Keys, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits each group before the shuffle too."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def ranked(df: DataFrame, score: str, tie: Keys, rank: str = "rank", ranges: int = 64) -> DataFrame:
    """`df` with the place of each row among all, highest score first, ties by the columns `tie`; scores are not null.

    Rows are dealt to ranges of the score, whose bounds are quantiles; a row's place is that in its range and
    the size of the ranges above it. So no task sorts the whole table, and the bounds need not be exact.
    """
    bounds = df.agg(F.array_distinct(F.percentile_approx(score, F.array(*(F.lit(i / ranges) for i in range(1, ranges))))).alias("_bounds"))  # one row
    dealt = df.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b > F.col(score)))).drop("_bounds")
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", F.coalesce(F.sum("_size").over(above), F.lit(0)).alias("_above"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc(score), *tie))
    return dealt.withColumn("_place", place).join(F.broadcast(sizes), "_range").withColumn(rank, F.col("_above") + F.col("_place")).drop("_range", "_above", "_place")


def percent_rank_ties(x: str, group: Keys) -> Column:
    """Rank over size with the mean rank for ties: (rank + (ties - 1) / 2) / n."""
    w = Window.partitionBy(*group)
    return (F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, x)) - 1) / 2) / F.count(F.lit(1)).over(w)


def duplicate_flag(keys: Keys) -> Column:
    """Whether another row has the same keys; all members are marked."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def days_between(earlier: Column, later: Column) -> Column:
    """Days and parts of days between two timestamps, with or without a zone."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000)


def rest_days(ts: str, entity: Keys, order: Keys) -> Column:
    """Days since the entity's event before."""
    before = F.lag(ts, 1).over(ordered(entity, order))
    return days_between(before, F.col(ts))


def budget_share(x: str | Column, group: Keys, budget: float, sharpness: float = 1.0) -> Column:
    """Softmax weights within the group, scaled to a budget."""
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*group)
    weight = F.exp(sharpness * (x - F.max(x).over(w)))
    return F.lit(budget) * weight / F.sum(weight).over(w)


def gap_to_next(score: str, group: Keys, tie: Keys) -> Column:
    """How far the score lies above the next best in its group; null for the last."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *tie)
    return F.col(score) - F.lead(score).over(w)


def follows_directly(period: str, entity: Keys) -> Column:
    """Whether the entity's period before is the one directly before."""
    return F.coalesce(F.col(period) - F.lag(period).over(ordered(entity, [period])) == 1, F.lit(False))


def active_mean(df: DataFrame, periods: DataFrame, entity: Keys, period: str, measure: str, target: int, width: int) -> DataFrame:
    """Mean of a measure over the last `width` known periods before the target, for each entity seen in them.

    `periods` has a row for each known period; an entity that is absent in one does not count it.
    """
    recent = periods.where(F.col(period) < target).select(period).distinct().orderBy(F.desc(period)).limit(width)
    return df.join(F.broadcast(recent), period, "left_semi").groupBy(*entity).agg(F.avg(measure).alias("predicted"), F.count("*").alias("observed"))
