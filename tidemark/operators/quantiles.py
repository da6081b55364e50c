"""Exact quantiles of groups, without a group in one task.

A mergeable sketch gives each group, in one aggregation, a range of values that must hold the ranks that are asked for. The next pass counts
what lies below a range and gathers only what lies in it, equal values as one row. So a task sorts the distinct values of a range,
some thousandths of a group; and the counts prove that the rank lies in the range, or the query fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counters of a group's sketch. Groups up to this size are their own range.
ACCURACY = 10_000
#: The sketch's error in ranks is n / ACCURACY at most; a range spans so many of these to either side.
MARGIN = 5


def exact_quantiles(df: DataFrame, group: Sequence[str], x: str | Column, shares: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """The group's columns, n (values that are not null) and quantiles (array of doubles, one for each share, linear between values).

    A group of nulls alone has n = 0 and null quantiles; a null in `group` is a group of its own; NaN counts as the largest value.
    """
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    rows = df.select(F.struct(*group).alias("_g"), value.alias("_x"))
    margin = MARGIN / accuracy
    around = [min(1.0, max(0.0, s + m)) for s in shares for m in (-margin, margin)]
    stats = rows.groupBy("_g").agg(F.count("_x").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.percentile_approx("_x", around, accuracy).alias("_near"))
    small = F.col("n") <= accuracy
    place = lambda s: F.lit(float(s)) * (F.col("n") - 1)
    wanted = [
        F.struct(
            F.lit(i).alias("i"),
            F.floor(place(s)).alias("first"),
            F.ceil(place(s)).alias("second"),
            (place(s) - F.floor(place(s))).alias("rest"),
            F.when(small, F.col("_low")).otherwise(F.col("_near")[2 * i]).alias("low"),
            F.when(small, F.col("_high")).otherwise(F.col("_near")[2 * i + 1]).alias("high"),
        )
        for i, s in enumerate(shares)
    ]
    targets = stats.where("n > 0").select("_g", F.explode(F.array(*wanted)).alias("_t")).select("_g", "_t.*")
    met = rows.where("_x IS NOT NULL").join(targets, "_g").where(F.col("_x") <= F.col("high"))
    inside = F.when(F.col("_x") >= F.col("low"), F.col("_x"))
    counted = met.groupBy("_g", "i", "first", "second", "rest", inside.alias("_x")).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(Window.partitionBy("_g", "i").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("_x")))
    found = counted.withColumn("upto", upto).groupBy("_g", "i").agg(at("first").alias("a"), at("second").alias("b"), F.max("rest").alias("rest"), F.sum(F.when(F.col("_x").isNull(), F.col("times"))).alias("below"), F.max("first").alias("first"), F.max("upto").alias("all"), F.max("second").alias("second"))
    held = (F.coalesce("below", F.lit(0)) <= F.col("first")) & (F.col("all") > F.col("second"))
    quantile = F.when(held, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("rest"))).otherwise(F.raise_error(F.lit("a rank lies outside its range")).cast("double"))
    each = found.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", quantile.alias("q")))).alias("_q"))  # one entry a share
    each = each.select("_g", F.col("_q")["q"].alias("quantiles"))
    return stats.select("_g", "n").join(each, "_g", "left").select("_g.*", "n", "quantiles")
