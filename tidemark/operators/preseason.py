"""Pre-season estimates: effective features of newcomers, a three-way signal, expected goals, player proxies and risk-adjusted utility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.models import argmax_label, clamp, softmax


def cohort_fallback(df: DataFrame, cohort: Column, needs: Column, features: Sequence[str]) -> DataFrame:
    """`effective_<feature>` of every row: its own value, or the cohort's mean where the row needs it; `fallback` says which.

    The cohort's means are one row.
    """
    means = df.where(cohort).agg(*(F.avg(c).alias(f"_mean_{c}") for c in features))
    out = df.crossJoin(F.broadcast(means)).withColumn("fallback", F.coalesce(needs, F.lit(False)))
    return out.withColumns({f"effective_{c}": F.when(F.col("fallback"), F.col(f"_mean_{c}")).otherwise(F.col(c)) for c in features}).drop(*(f"_mean_{c}" for c in features))


def with_sides(matches: DataFrame, features: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Matches with the features of both sides as home_<c> and away_<c>."""
    for side in ("home", "away"):
        own = features.select(F.col(key).alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        matches = matches.join(own, f"{side}_id", "left")
    return matches


@dataclass(frozen=True)
class Signal:
    """What a difference between home and away counts for, and how chances follow from the sum."""

    home: float = 0.18
    weights: tuple[tuple[str, float], ...] = (("points", 0.85), ("scored", 0.35), ("conceded", -0.30), ("clean", 0.20), ("goal_diff", 0.01))
    limit: float = 2.2
    temperature: float = 1.35
    draw: float = 0.08
    draw_slope: float = 0.34
    fallback_penalty: float = 0.04
    least: float = 0.001


def match_signal(rules: Signal = Signal()) -> Column:
    """Weighted differences of home_<c> and away_<c>, limited; null if one is missing."""
    parts = (w * (F.col(f"home_{c}") - F.col(f"away_{c}")) for c, w in rules.weights)
    total = reduce(lambda a, b: a + b, parts, F.lit(rules.home))
    return F.when(total.isNotNull(), clamp(total, -rules.limit, rules.limit))


def signal_chances(df: DataFrame, signal: str, fallback: str, rules: Signal = Signal()) -> DataFrame:
    """p_home, p_draw, p_away and the label; where a fallback was used, the likeliest outcome gives a little to the draw."""
    s = F.col(signal)
    raw = dict(zip("HDA", softmax([s / rules.temperature, rules.draw - rules.draw_slope * F.abs(s), -s / rules.temperature])))
    top = argmax_label(raw)
    moved = {k: c - F.when(F.col(fallback) & (top == k), rules.fallback_penalty).otherwise(0.0) + (F.when(F.col(fallback), rules.fallback_penalty).otherwise(0.0) if k == "D" else 0.0) for k, c in raw.items()}
    out = df.withColumns({f"_{k}": F.greatest(c, F.lit(rules.least)) for k, c in moved.items()})
    total = F.col("_H") + F.col("_D") + F.col("_A")
    out = out.withColumns({f"p_{n}": F.when(s.isNotNull(), F.col(f"_{k}") / total) for k, n in zip("HDA", ("home", "draw", "away"))})
    return out.withColumn("label", F.when(s.isNotNull(), argmax_label({"H": F.col("p_home"), "D": F.col("p_draw"), "A": F.col("p_away")}))).drop("_H", "_D", "_A")


def expected_goals(points: tuple[str, str] = ("home_points", "away_points"), scored: tuple[str, str] = ("home_scored", "away_scored"), conceded: tuple[str, str] = ("home_conceded", "away_conceded"), clean: tuple[str, str] = ("home_clean", "away_clean")) -> tuple[Column, Column]:
    """Expected goals of both sides: own attack and the other's defence, a home factor and small edges, within limits."""
    edge = 0.08 * (F.col(points[0]) - F.col(points[1])) + 0.12 * (F.col(clean[0]) - F.col(clean[1]))
    home = (F.col(scored[0]) + F.col(conceded[1])) / 2 * 1.08 * (1 + clamp(edge, -0.18, 0.18))
    away = (F.col(scored[1]) + F.col(conceded[0])) / 2 * 0.92 * (1 + clamp(-edge, -0.18, 0.18))
    return F.when(home.isNotNull(), clamp(home, 0.25, 3.5)), F.when(away.isNotNull(), clamp(away, 0.20, 3.3))


def prior_proxies(df: DataFrame, matches: int, totals: Sequence[str]) -> DataFrame:
    """Chances and minutes a match, and totals per 90 minutes, from a season's minutes, appearances and starts."""
    share = lambda c, top: clamp(F.col(c) / matches, 0.0, top)
    out = df.withColumns({"appearance_chance": share("appearances", 1.0), "start_chance": share("starts", 1.0), "expected_minutes": share("minutes", 90.0), "minutes_if_playing": F.when(F.col("appearances") > 0, clamp(F.col("minutes") / F.col("appearances"), 0.0, 90.0))})
    return out.withColumns({f"{t}_per_90": F.when(F.col("minutes") > 0, F.col(t) * 90 / F.col("minutes")) for t in totals})


def utility(points: Column, minutes: Column, start: Column, fallback_level: Column, width: Column, price: Column, policy: Mapping[str, float]) -> Column:
    """Points less charges for missing minutes, doubtful starts, fallback (null level: none) and uncertainty, plus a bonus for value."""
    charge = (
        F.greatest(F.lit(0.0), policy["minutes_target"] - minutes) * policy["per_minute"]
        + F.greatest(F.lit(0.0), policy["start_target"] - start) * policy["start"]
        + F.when(fallback_level.isNotNull(), policy["fallback"] + fallback_level * policy["fallback_level"]).otherwise(0.0)
        + F.coalesce(width * policy["width"], F.lit(policy["no_width"]))
    )
    return points - charge + points / F.greatest(price, F.lit(1)) * policy["value"]


def discounted_total(df: DataFrame, keys: Sequence[str], period: str, value: str, discounts: Mapping[int, float]) -> DataFrame:
    """Sum of discounted values of each key, and whether every discounted period is there."""
    table = F.create_map(*(F.lit(x) for pair in discounts.items() for x in pair))
    rows = df.withColumn("_d", F.try_element_at(table, F.col(period).cast("int"))).where("_d IS NOT NULL")
    return rows.groupBy(*keys).agg(F.sum(F.col(value) * F.col("_d")).alias("discounted"), (F.count_distinct(F.when(F.col(value).isNotNull(), F.col(period))) == len(discounts)).alias("complete"))
