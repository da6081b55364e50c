"""Group summaries: bands, medians, profiles, coverage, priors, tables of counts and the collapse of repeated periods."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero or either is null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b)


def zero_sum(x: str | Column) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(x), F.lit(0))


def quantile_bands(df: DataFrame, group: Sequence[str], x: str, labels: Sequence[str] = ("low", "mid", "high", "top")) -> DataFrame:
    """`df` with q25, q50, q75 of its group (linear between values) and the band that its value falls in."""
    q = exact_quantiles(df, group, x, (0.25, 0.5, 0.75))
    q = q.select(*group, *(F.col("quantiles")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))))
    band = F.when(F.col(x) <= F.col("q25"), labels[0]).when(F.col(x) <= F.col("q50"), labels[1]).when(F.col(x) <= F.col("q75"), labels[2]).otherwise(labels[3])
    return df.join(q, list(group)).withColumn("band", F.when(F.col(x).isNotNull(), band))


def _medians(df: DataFrame, group: Sequence[str], x: str, into: str) -> DataFrame:
    found = exact_quantiles(df, group, x, (0.5,))
    return found.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("quantiles")[0].alias(into))


def _with_median(summary: DataFrame, df: DataFrame, group: Sequence[str], x: str, into: str) -> DataFrame:
    """A summary by `group` with the median of one measure; null groups are groups."""
    medians = _medians(df, group, x, into)
    same = reduce(lambda a, b: a & b, (summary[g].eqNullSafe(medians[f"_g{i}"]) for i, g in enumerate(group)))
    return summary.join(medians, same, "left").select(*summary.columns, into)


def group_medians(df: DataFrame, group: Sequence[str], measures: Sequence[str]) -> DataFrame:
    out = df.groupBy(*group).agg(F.count("*").alias("n"))
    for m in measures:
        out = _with_median(out, df, group, m, f"{m}_median")
    return out


def distribution(df: DataFrame, group: Sequence[str], x: str) -> DataFrame:
    """Count, least, median, mean and largest of each group."""
    out = df.groupBy(*group).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.avg(x).alias("mean"), F.max(x).alias("high"))
    return _with_median(out, df, group, x, "median").select(*group, "n", "low", "median", "mean", "high")


def value_counts(df: DataFrame, column: str, null_label: str = "null") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(null_label)).alias("value")).agg(F.count("*").alias("n"))


def cross_table(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts of each row value against a pinned list of column values."""
    return df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0, [str(v) for v in values])


def flag_counts(df: DataFrame, flags: Column) -> DataFrame:
    """How often each element of an array column occurs."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def coverage(df: DataFrame, group: Sequence[str], period: str) -> DataFrame:
    """First and last period, number of periods, and whether none between is missing."""
    out = df.groupBy(*group).agg(F.min(period).alias("first"), F.max(period).alias("last"), F.countDistinct(period).alias("periods"))
    return out.withColumn("complete", F.col("last") - F.col("first") + 1 == F.col("periods"))


def season_summary(df: DataFrame, group: Sequence[str], period: str, minutes: str, points: str, value: str, threshold: int) -> DataFrame:
    """Totals, extremes, last value by period, and counts over a threshold of each entity."""
    return df.groupBy(*group).agg(
        F.count("*").alias("rows"),
        zero_sum(minutes).alias("minutes"),
        zero_sum(points).alias("points"),
        F.min(value).alias("value_low"),
        F.max(value).alias("value_high"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(period))).alias("value_last"),
        F.count_if(F.col(minutes) > 0).alias("appearances"),
        F.count_if(F.col(minutes) >= threshold).alias("long_appearances"),
    )


def priors(df: DataFrame, group: Sequence[str], minutes: str, totals: Sequence[str], per: int = 90, enough: int = 0) -> DataFrame:
    """Totals of the source season with rates per `per` minutes and per appearance; `reliable` from so many minutes on."""
    out = df.groupBy(*group).agg(zero_sum(minutes).alias("minutes"), F.count_if(F.col(minutes) > 0).alias("appearances"), *(zero_sum(t).alias(t) for t in totals))
    rates = {f"{t}_per_{per}": safe_divide(F.col(t) * per, "minutes") for t in totals} | {f"{t}_per_appearance": safe_divide(t, "appearances") for t in totals}
    return out.withColumns(rates).withColumn("reliable", F.col("minutes") >= enough)


def collapse_periods(df: DataFrame, keys: Sequence[str], sums: Sequence[str], single: Sequence[str], joined: Sequence[str], order: str) -> DataFrame:
    """One row per key: sums; a value if all rows agree on it, else null; sorted distinct values joined by |; first and last by order."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        *(zero_sum(c).alias(c) for c in sums),
        *(F.when(F.count_distinct(c) == 1, F.max(c)).alias(c) for c in single),
        *(F.concat_ws("|", F.array_sort(F.collect_set(F.col(c).cast("string")))).alias(c) for c in joined),
        *(f(c, order).alias(f"{c}_{n}") for c in sums for n, f in (("first", F.min_by), ("last", F.max_by))),
    )


def profile(df: DataFrame, distinct: Sequence[str] = (), sums: Sequence[str] = (), counts: dict[str, Column] | None = None) -> DataFrame:
    """One row about a table: rows, distinct counts, sums and conditional counts."""
    return df.agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"{c}_distinct") for c in distinct), *(zero_sum(c).alias(f"{c}_sum") for c in sums), *(F.count_if(c).alias(n) for n, c in (counts or {}).items()))


def season_report(fixtures: DataFrame, stats: DataFrame, season: str = "season", period: str = "period") -> DataFrame:
    """A row for each season of either table: rows, periods and what they span, what is finished, sides, players, totals, repeated keys, and what can be built from it.

    `fixtures` has match_id, home_id, away_id, finished; `stats` has player_id, minutes, points. `ready_for_priors` needs player rows, `ready_for_matches` fixtures.
    """
    n = lambda c: F.coalesce(F.count_distinct(c), F.lit(0))
    spans = lambda p: (F.min(period).alias(f"{p}_first"), F.max(period).alias(f"{p}_last"), n(period).alias(f"{p}_periods"))
    games = fixtures.groupBy(season).agg(F.count("*").alias("fixtures"), *spans("fixture"), F.count_if("finished").alias("finished"), (n("home_id") + n("away_id")).alias("sides"))
    rows = stats.groupBy(season).agg(F.count("*").alias("player_rows"), n("player_id").alias("players"), *spans("player"), zero_sum("minutes").alias("minutes"), zero_sum("points").alias("points"))
    repeated = lambda df, keys, name: df.groupBy(season, *keys).count().where("count > 1").groupBy(season).agg(F.count("*").alias(name))
    out = games.join(rows, season, "full").join(repeated(fixtures, ["match_id"], "repeated_fixtures"), season, "left").join(repeated(stats, [period, "player_id"], "repeated_player_rows"), season, "left")
    counts = [c for c in out.columns if c not in (season, "fixture_first", "fixture_last", "player_first", "player_last")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumns({"ready_for_priors": F.col("player_rows") > 0, "ready_for_matches": F.col("fixtures") > 0})
