"""Probability models and heuristics as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def softmax(scores: Sequence[Column], temperature: float = 1.0) -> list[Column]:
    """Shares of exp(score / temperature), shifted by the largest score."""
    top = F.greatest(*scores)
    weights = [F.exp((s - top) / temperature) for s in scores]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def argmax_label(chances: dict[str, Column]) -> Column:
    """The label of the largest chance; of equals the first."""
    names = list(chances)
    top, out = F.greatest(*chances.values()), F.lit(names[-1])
    for name in reversed(names[:-1]):
        out = F.when(chances[name] == top, name).otherwise(out)
    return out


def weighted_blend(a: Column, b: Column, weight: float) -> Column:
    """weight * a + (1 - weight) * b; where one side is missing the other alone."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(weight * a + (1 - weight) * b)


def match_baseline(df: DataFrame, home: str, away: str, threshold: float) -> DataFrame:
    """Chances from the difference of form, and the label by a threshold on it."""
    d = F.col(home) - F.col(away)
    chances = softmax([d, -F.abs(d), -d])
    label = F.when(d > threshold, "H").when(d < -threshold, "A").otherwise("D")
    return df.withColumns(dict(zip(("p_home", "p_draw", "p_away"), chances))).withColumn("pred", label)


def poisson(mean: Column, k: Column) -> Column:
    return F.exp(-mean) * F.pow(mean, k) / F.factorial(k)


def score_grid(df: DataFrame, keys: Sequence[str], home: str, away: str, most: int = 10) -> DataFrame:
    """A row for each scoreline up to `most` goals a side with its chance, both sides Poisson and independent."""
    goals = lambda: F.explode(F.sequence(F.lit(0), F.lit(most)))
    rows = df.select(*keys, home, away, goals().alias("h")).select(*keys, home, away, "h", goals().alias("a"))
    return rows.withColumn("p", poisson(F.col(home), F.col("h")) * poisson(F.col(away), F.col("a"))).select(*keys, "h", "a", "p")


def outcome_chances(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Home, draw and away chances normalised over the grid, and the mass beyond it."""
    part = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    out = grid.groupBy(*keys).agg(F.sum("p").alias("mass"), part(F.col("h") > F.col("a")).alias("H"), part(F.col("h") == F.col("a")).alias("D"), part(F.col("h") < F.col("a")).alias("A"))
    return out.select(*keys, *((F.col(c) / F.col("mass")).alias(f"p_{n}") for c, n in (("H", "home"), ("D", "draw"), ("A", "away"))), (1 - F.col("mass")).alias("tail"))


def top_scores(grid: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k likeliest scorelines with a label; of equals the lower score."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), "h", "a"))
    return grid.withColumn("place", place).where(F.col("place") <= k).withColumn("score", F.format_string("%d-%d", "h", "a"))


def scored_grid(df: DataFrame, home: str, away: str, most: int = 10) -> DataFrame:
    """`df` with the chances and tail of `outcome_chances` and the score of `top_scores` of its own score grid, which stays within the row: nothing is grouped."""
    side = lambda mean: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: poisson(F.col(mean), k))
    cell = lambda x, h: lambda y, a: F.struct((x * y).alias("p"), (-h).alias("h"), (-a).alias("a"))
    rows = df.withColumns({"_home": side(home), "_away": side(away)})
    rows = rows.withColumn("_grid", F.flatten(F.transform("_home", lambda x, h: F.transform("_away", cell(x, h)))))
    part = lambda c: F.aggregate("_grid", F.lit(0.0), lambda total, x: total + F.when(c(x), F.coalesce(x["p"], F.lit(0.0))).otherwise(0.0))
    mass = F.aggregate("_grid", F.lit(0.0), lambda total, x: total + x["p"])
    # goals are negative in the grid, so of equal chances the lower score is the larger
    rows = rows.withColumns({"_mass": mass, "_H": part(lambda x: x["h"] < x["a"]), "_D": part(lambda x: x["h"] == x["a"]), "_A": part(lambda x: x["h"] > x["a"]), "_top": F.array_max("_grid")})
    chances = {f"p_{n}": F.col(f"_{c}") / F.col("_mass") for c, n in (("H", "home"), ("D", "draw"), ("A", "away"))}
    out = rows.withColumns(chances | {"tail": 1 - F.col("_mass"), "score": F.format_string("%d-%d", -F.col("_top.h"), -F.col("_top.a"))})
    return out.select(*df.columns, *chances, "tail", "score")


def availability_ceiling(chance: Column, *scaled: Column) -> list[Column]:
    """The official chance (0 to 1, null: none given) as a ceiling on the first column; the others shrink by the same factor."""
    first, *rest = scaled
    factor = F.when(chance.isNotNull() & (chance < first), chance / F.nullif(first, F.lit(0.0))).otherwise(F.lit(1.0))
    factor = F.coalesce(factor, F.lit(1.0))
    return [F.least(first, F.coalesce(chance, first)), *(c * factor for c in rest)]


def prior_weight(gw: Column, last: int = 5) -> Column:
    """How much the prior counts: all in the first period, none after `last`, a line between."""
    return F.when(gw <= 1, 1.0).when(gw > last, 0.0).otherwise((last + 1 - gw) / last)


def tier(minutes: Column, rows: Column) -> Column:
    """Sample tiers from minutes and appearances; the first that fits."""
    few = F.when(minutes <= 0, "zero_sample").when((minutes < 180) | (rows < 3), "very_low_sample").when((minutes < 450) | (rows < 5), "low_sample")
    return few.when(minutes < 900, "moderate_sample").when(minutes < 1800, "reliable_sample").otherwise("high_sample")


def risk_flags(flags: dict[str, Column]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.filter(F.array(*(F.when(c, n) for n, c in flags.items())), lambda x: x.isNotNull())
