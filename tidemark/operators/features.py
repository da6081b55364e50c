"""Feature frames that join several sources: players with team and opponent context, matches with both sides' history, pre-season players."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events
from tidemark.operators.learned import one_hot
from tidemark.operators.relational import guarded_join
from tidemark.operators.rolling import ordered, trailing_count_if, trailing_mean, trailing_rate, trailing_sum

TEAM_PERIOD = ["season", "team_id", "period"]
OWN = ["rank_before", "points_per_match", "goal_diff_per_match", "attack_recent", "defence_recent"]


def period_context(sides: DataFrame) -> DataFrame:
    """One row for each team and period: its own standing before it, and the means over the opponents that it faces in it."""
    context = events.team_context(sides)
    faced = events.fixture_context(sides, context)
    means = [f"opponent_{c}" for c in events.OPPONENT] + ["difficulty_attack", "difficulty_defence"]
    by_team = faced.groupBy(*TEAM_PERIOD).agg(F.count("*").alias("fixtures"), F.avg(F.col("is_home").cast("int")).alias("home_ratio"), *(F.avg(c).alias(c) for c in means))
    return by_team.join(context.select(*TEAM_PERIOD, *OWN), TEAM_PERIOD)


def player_features(rows: DataFrame, sides: DataFrame, positions: Sequence[str], statuses: Sequence[str], long_minutes: int = 60, entity: Sequence[str] = ("season", "player_id")) -> DataFrame:
    """Trailing form of every player and period with the context of the team and of its opponents; no row sees its own period.

    `rows` has player_id, season, period, team_id, position, status, price, points, minutes, goals,
    assists and clean_sheets. Rows without a row before are dropped. Position and status become a column for each
    category; a team without a match in the period has null context and counts as away.
    """
    order = ["period"]
    lag = lambda c: F.lag(c).over(ordered(entity, order))
    sums = {f"{c}_sum5": trailing_sum(c, entity, order, 5) for c in ("goals", "assists", "clean_sheets")}
    form = {"points_last1": lag("points"), "minutes_last1": lag("minutes")}
    form |= {f"points_mean{w}": trailing_mean("points", entity, order, w) for w in (3, 5, 8)} | {f"minutes_mean{w}": trailing_mean("minutes", entity, order, w) for w in (3, 5)}
    form |= {"minutes_nonzero_rate5": trailing_rate(F.col("minutes") > 0, entity, order, 5), "long_matches5": trailing_count_if(F.col("minutes") >= long_minutes, entity, order, 5)}
    out = rows.withColumns(form | sums).where("points_last1 IS NOT NULL AND minutes_last1 IS NOT NULL")
    out = out.join(period_context(sides), TEAM_PERIOD, "left").withColumn("is_home", (F.coalesce("home_ratio", F.lit(0.0)) >= 0.5).cast("int"))
    return out.select(*(c for c in out.columns if c not in ("position", "status")), *one_hot("position", positions), *one_hot("status", statuses))


SIDE = ["rank_before", "points_per_match", "goal_diff_per_match", "scored_recent", "conceded_recent", "attack_recent", "defence_recent", "rest_days", "difficulty", "difficulty_attack", "difficulty_defence"]


def match_features(matches: DataFrame, meetings: int = 3, digits: int | None = None) -> DataFrame:
    """One row for each match, in 40 columns: result, both sides' standing, recent strength, rest and difficulty before it, their differences, and the last meetings in the season.

    A difference is home less away, that of the ranks away less home, so that more is always better for the home team.
    With `digits`, what is no whole number is rounded, after the differences are taken. What a team's period says is worked out and rounded once for
    the period, not for each of its matches; only the days of rest go through the sides.
    """
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c.cast("double"), digits))
    sides = events.two_sided(matches)
    context = events.team_context(sides).select(*TEAM_PERIOD, *OWN)
    own = {"rank_before": F.col("rank_before")} | {c: rounded(F.col(c)) for c in OWN[1:]}
    faced = {c: rounded(v) for c, v in events.difficulty("attack_recent", "defence_recent").items()}
    context = context.select(*TEAM_PERIOD, F.struct(*(v.alias(c) for c, v in own.items())).alias("own"), F.struct(*(v.alias(c) for c, v in faced.items())).alias("faced"), F.struct(*OWN[1:4]).alias("exact"))
    rest = events.side_rest(sides.select("match_id", "season", "team_id", "is_home", "kickoff"), ("season", "team_id"))
    rest = rest.groupBy("match_id").agg(*(F.max(F.when(F.col("is_home") == home, F.col("rest_days"))).alias(f"{side}_rest") for side, home in (("home", True), ("away", False))))
    out = events.pair_history(matches, meetings, ["season"]).join(rest, "match_id")
    for side in ("home", "away"):
        out = out.join(context.select("season", F.col("team_id").alias(f"{side}_id"), "period", *(F.col(c).alias(f"{side}_{c}") for c in ("own", "faced", "exact"))), ["season", f"{side}_id", "period"], "left")
    out = out.where("home_own IS NOT NULL OR away_own IS NOT NULL")
    nobody = {c: rounded(v) for c, v in events.difficulty(F.lit(None).cast("double"), F.lit(None).cast("double")).items()}

    def of_side(side: str, other: str) -> dict[str, Column]:
        found = {c: F.col(f"{side}_own.{c}") for c in OWN}
        found |= {"scored_recent": found["attack_recent"], "conceded_recent": found["defence_recent"]}
        known = F.col(f"{side}_own").isNotNull()
        found |= {c: F.when(known, F.coalesce(F.col(f"{other}_faced.{c}"), v)) for c, v in nobody.items()}
        return found | {"difficulty": found["difficulty_attack"], "rest_days": rounded(F.when(known, F.col(f"{side}_rest")))}

    values = {"home": of_side("home", "away"), "away": of_side("away", "home")}
    difference = lambda name, c: rounded(F.col(f"home_exact.{c}") - F.col(f"away_exact.{c}")).alias(name)
    return out.select(
        "season", "match_id", "period", "kickoff", "home_id", "away_id", "home_score", "away_score",
        F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"), events.result_label("home_score", "away_score").alias("label"),
        *(values[side][c].alias(f"{side}_{c}") for c in SIDE for side in ("home", "away")),
        difference("strength_diff", "attack_recent"), difference("points_per_match_diff", "points_per_match"), difference("goal_diff_per_match_diff", "goal_diff_per_match"),
        (values["away"]["rank_before"] - values["home"]["rank_before"]).alias("rank_diff"),
        "meetings", *(rounded(F.col(c)).alias(c) for c in ("home_points_mean", "home_goal_diff_mean")),
    )


def preseason_players(players: DataFrame, teams: DataFrame, fixtures: DataFrame, mapping: DataFrame, priors: DataFrame, strengths: DataFrame, promoted: Sequence[str], prior_columns: Sequence[str], strength_columns: Sequence[str], fixed: Mapping[str, object] | None = None) -> DataFrame:
    """One row for each player before the season's first match: five guarded joins, and flags for all that is missing.

    `players` has player_id, team_id, position, status, price; `teams` team_id, team, short; `fixtures` one row for each team that plays:
    team_id, fixture_id, opponent_id, opponent_short; `mapping` player_id, raw_key, mapping_status of accepted matches; `priors` raw_key, prior_source, minutes_prior and
    `prior_columns`; `strengths` fixture_id, team_id, team_fallback, opponent_fallback and `strength_columns`. A join whose other side repeats its key fails.
    `fixed` are constants that every row names, such as seasons and versions.
    """
    out = guarded_join(players, teams.select("team_id", "team", "short"), ["team_id"])
    out = guarded_join(out, fixtures.select("team_id", "fixture_id", "opponent_id", "opponent_short", F.lit(True).alias("has_fixture")), ["team_id"])
    out = guarded_join(out, mapping.select("player_id", "raw_key", "mapping_status"), ["player_id"], cardinality="one_to_one")
    out = guarded_join(out, priors.select("raw_key", "prior_source", "minutes_prior", *prior_columns), ["raw_key"])
    out = guarded_join(out, strengths.select("fixture_id", "team_id", "team_fallback", "opponent_fallback", *strength_columns), ["fixture_id", "team_id"])
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    has_prior = F.col("raw_key").isNotNull() & F.col("prior_source").isNotNull() & F.col("minutes_prior").isNotNull()
    price = F.col("price").try_cast("double")
    missing = F.lit(False)
    for c in strength_columns:
        missing = missing | F.col(c).isNull()
    flags = {
        "has_fixture": yes("has_fixture"),
        "blank": ~yes("has_fixture"),
        "mapping_status": F.coalesce("mapping_status", F.lit("no_safe_accepted_mapping")),
        "has_prior": has_prior,
        "no_prior": ~has_prior,
        "prior_reliability": has_prior.cast("double"),
        "promoted": F.coalesce(F.col("short").isin(*promoted), F.lit(False)),
        "opponent_promoted": F.coalesce(F.col("opponent_short").isin(*promoted), F.lit(False)),
        "uncertain_status": F.lower(F.coalesce("status", F.lit(""))) != "a",
        "missing_price": F.coalesce(price <= 0, F.lit(True)),
        "missing_position": F.trim(F.coalesce("position", F.lit(""))) == "",
        "missing_strength": missing,
        "missing_fixture": ~yes("has_fixture") | F.col("fixture_id").isNull() | F.col("opponent_id").isNull(),
        "team_fallback": yes("team_fallback"),
        "opponent_fallback": yes("opponent_fallback"),
        "write_allowed": F.lit(False),
        "production_ready": F.lit(False),
    }
    return out.withColumns(flags | {k: F.lit(v) for k, v in (fixed or {}).items()})
