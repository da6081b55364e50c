"""Expected points of a player's next match, from a prior that is trusted as far as its sample allows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.models import availability_ceiling, clamp

ROLE = ("appearance", "start", "minutes_if_playing", "minutes")
RATES = ("points_per_90", "goals_per_90", "assists_per_90", "bonus_per_90")


@dataclass(frozen=True)
class Policy:
    """Weights of a prior by sample tier, what unknown players lose, and what a fixture changes."""

    role_weight: Mapping[str, float] = field(default_factory=lambda: {"high_sample": 0.85, "reliable_sample": 0.70, "moderate_sample": 0.45, "low_sample": 0.20, "very_low_sample": 0.10, "zero_sample": 0.0})
    rate_weight: Mapping[str, float] = field(default_factory=lambda: {"high_sample": 0.85, "reliable_sample": 0.70, "moderate_sample": 0.35, "low_sample": 0.0, "very_low_sample": 0.0, "zero_sample": 0.0})
    half_width: Mapping[str, float] = field(default_factory=lambda: {"high_sample": 14.0, "reliable_sample": 20.0, "moderate_sample": 26.0, "low_sample": 32.0, "very_low_sample": 36.0, "zero_sample": 40.0})
    unknown_workload: Mapping[str, float] = field(default_factory=lambda: {"high_sample": 1.0, "reliable_sample": 1.0, "moderate_sample": 0.85, "low_sample": 0.65, "very_low_sample": 0.50, "zero_sample": 0.35})
    unknown: float = 0.75
    unsafe_half_width: float = 38.0
    unknown_half_width: float = 40.0
    position_only_half_width: float = 6.0
    no_goals_half_width: float = 3.0
    position_only: Mapping[str, float] = field(default_factory=lambda: {"GKP": 0.35, "DEF": 0.65, "MID": 0.65, "FWD": 0.65})
    keeper_budget: float = 0.98
    keeper_price: float = 1.40
    attack: Mapping[str, float] = field(default_factory=lambda: {"GKP": 0.0, "DEF": 0.15, "MID": 0.40, "FWD": 0.50})
    defence: Mapping[str, float] = field(default_factory=lambda: {"GKP": 0.35, "DEF": 0.35, "MID": 0.05, "FWD": 0.0})
    goal: Mapping[str, float] = field(default_factory=lambda: {"GKP": 6.0, "DEF": 6.0, "MID": 5.0, "FWD": 4.0})
    clean_sheet: Mapping[str, float] = field(default_factory=lambda: {"GKP": 4.0, "DEF": 4.0, "MID": 1.0, "FWD": 0.0})
    assist: float = 3.0
    signal: tuple[float, float] = (0.75, 1.25)
    multiplier: tuple[float, float] = (0.85, 1.15)
    points: tuple[float, float] = (0.0, 15.0)


def _of(table: Mapping[str, float], key: str, default: float | None = None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def keeper_share(policy: Policy = Policy()) -> Column:
    """How much of a club's matches each of its goalkeepers can have, by price and prior; null for other positions."""
    w = Window.partitionBy("club", "position")
    price, prior = F.coalesce("price", F.lit(0.0)), clamp(F.coalesce("appearance", F.lit(0.0)), 0.0, 1.0)
    weight = F.greatest(F.lit(1e-9), F.exp(policy.keeper_price * (price - F.max(price).over(w))) * (0.65 + 0.35 * prior))
    return F.when(F.col("position") == "GKP", policy.keeper_budget * weight / F.sum(weight).over(w))


def _trusted(own: str, weight: Column) -> Column:
    """The player's value and the fallback's by weight; one alone where the other is missing, 0 where both are."""
    mine, other = F.col(own), F.col(f"fallback_{own}")
    return F.when(other.isNull(), F.coalesce(mine, F.lit(0.0))).when(mine.isNull(), other).otherwise(weight * mine + (1 - weight) * other)


def project(df: DataFrame, mean_goals: float, mean_clean: float, policy: Policy = Policy()) -> DataFrame:
    """`df` with the projected match: chances, minutes with bounds, points, and the parts that add up to them.

    `df` has position, club, price, tier, safe_prior, unknown_role, the values in ROLE and RATES and
    their `fallback_` counterparts, minutes_signal, rate_signal (prices against the position's), chance
    (official, 0 to 1 or null), team_goals and opponent_goals (null: the league's mean), and, if the fallback may be that
    of the position alone, `position_only`: such a fallback's chances and minutes are reduced. Points are
    limited to a range; what the known parts leave of them is `other_points`, so that parts always add up.
    """
    safe = F.coalesce("safe_prior", F.lit(False))
    role, rate = (F.when(safe, _of(t, "tier", 0.0)).otherwise(0.0) for t in (policy.role_weight, policy.rate_weight))
    unknown, keeper = F.coalesce("unknown_role", F.lit(False)), F.col("position") == "GKP"
    workload = F.when(unknown, F.when(safe, _of(policy.unknown_workload, "tier", policy.unknown)).otherwise(policy.unknown) * F.coalesce("minutes_signal", F.lit(1.0))).otherwise(1.0)
    by_price = F.when(unknown, F.coalesce("rate_signal", F.lit(1.0))).otherwise(1.0)

    thin = F.coalesce("position_only", F.lit(False)) if "position_only" in df.columns else F.lit(False)
    less = F.when(thin, F.coalesce(_of(policy.position_only, "position"), F.lit(1.0))).otherwise(1.0)
    df = df.withColumns({f"fallback_{c}": F.col(f"fallback_{c}") * less for c in ("appearance", "start", "minutes")})
    out = df.withColumn("keeper_share", keeper_share(policy))
    out = out.withColumns({f"_{c}": _trusted(c, role) for c in ROLE} | {f"_{c}": _trusted(c, rate) * by_price for c in RATES})
    out = out.withColumns({f"_{c}": F.col(f"_{c}") * workload for c in ("appearance", "start", "minutes")})
    out = out.withColumn("_appearance", clamp(F.when(keeper, F.least("_appearance", F.coalesce("keeper_share", "_appearance"))).otherwise(F.col("_appearance")), 0.0, 1.0))
    out = out.withColumn("_start", F.greatest(F.lit(0.0), F.least("_start", "_appearance")))
    out = out.withColumn("_minutes", F.when(keeper, 90.0 * F.col("_appearance")).otherwise(clamp(F.col("_minutes"), 0.0, 90.0)))
    names = ("appearance_chance", "start_chance", "expected_minutes")
    out = out.withColumns(dict(zip(names, availability_ceiling(F.col("chance"), F.col("_appearance"), F.col("_start"), F.col("_minutes")))))
    out = out.withColumn("minutes_if_appearing", F.when(keeper, 90.0).otherwise(clamp(F.col("_minutes_if_playing"), 0.0, 90.0)))

    known = F.col("team_goals").isNotNull() & F.col("opponent_goals").isNotNull()
    ours, theirs = (F.when(known, F.col(c)).otherwise(mean_goals) for c in ("team_goals", "opponent_goals"))
    out = out.withColumn("clean_chance", F.exp(-theirs)).withColumn("attack_signal", clamp(ours / mean_goals, *policy.signal))
    defence_signal = clamp(F.col("clean_chance") / mean_clean, *policy.signal)
    attack, defence = _of(policy.attack, "position"), _of(policy.defence, "position")
    out = out.withColumn("fixture_multiplier", clamp(1 - attack - defence + attack * F.col("attack_signal") + defence * defence_signal, *policy.multiplier))

    share = F.col("expected_minutes") / 90.0
    out = out.withColumn("_raw", F.col("_points_per_90") * share * F.col("fixture_multiplier"))
    out = out.withColumn("points", clamp(F.col("_raw"), *policy.points)).withColumn("guardrail", F.col("points") - F.col("_raw"))
    parts = {
        "appearance_points": F.col("appearance_chance") + F.col("start_chance"),
        "goal_points": F.col("_goals_per_90") * share * F.col("attack_signal") * _of(policy.goal, "position"),
        "assist_points": F.col("_assists_per_90") * share * F.col("attack_signal") * policy.assist,
        "clean_sheet_points": F.col("clean_chance") * F.col("start_chance") * _of(policy.clean_sheet, "position"),
        "bonus_points": F.col("_bonus_per_90") * share,
    }
    out = out.withColumns(parts).withColumn("other_points", F.col("points") - sum((F.col(p) for p in parts), F.lit(0.0)))
    width = F.when(safe, _of(policy.half_width, "tier", policy.unknown_half_width)).otherwise(policy.unsafe_half_width)
    width = width + F.when(thin, policy.position_only_half_width).otherwise(0.0) + F.when(known, 0.0).otherwise(policy.no_goals_half_width)
    out = out.withColumns({"minutes_low": clamp(F.col("expected_minutes") - width, 0.0, 90.0), "minutes_high": clamp(F.col("expected_minutes") + width, 0.0, 90.0)})
    return out.drop(*(f"_{c}" for c in (*ROLE, *RATES)), "_raw")
