"""Two-sided events: one row per side, period totals, standings, opponent context, last-N and pair history.

`matches` has match_id, season, period, kickoff, home_id, away_id, home_score, away_score. A match is
unpivoted once, and history is read with windows over the sides, never with a self-join on time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rolling import days_between, ordered, trailing

WIN, DRAW = 3, 1


def points(scored: str | Column, conceded: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (scored, conceded))
    return F.when(a > b, WIN).when(a == b, DRAW).otherwise(0)


def result_label(home: str | Column, away: str | Column) -> Column:
    """H, D or A; null without both scores."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (home, away))
    return F.when(a > b, "H").when(a == b, "D").when(a < b, "A")


def two_sided(matches: DataFrame, keep: Sequence[str] = ("match_id", "season", "period", "kickoff")) -> DataFrame:
    """Two rows per match: team_id, opponent_id, is_home, scored, conceded, points."""

    def side(own: str, other: str, home: bool) -> Column:
        return F.struct(F.col(f"{own}_id").alias("team_id"), F.col(f"{other}_id").alias("opponent_id"), F.lit(home).alias("is_home"), F.col(f"{own}_score").alias("scored"), F.col(f"{other}_score").alias("conceded"))

    rows = matches.select(*keep, F.inline(F.array(side("home", "away", True), side("away", "home", False))))
    return rows.withColumn("points", points("scored", "conceded"))


def by_period(sides: DataFrame, entity: Sequence[str] = ("season", "team_id")) -> DataFrame:
    """Totals and means of each team and period."""
    return sides.groupBy(*entity, "period").agg(
        F.count("*").alias("matches"),
        F.avg(F.col("is_home").cast("int")).alias("home_ratio"),
        F.sum("scored").alias("scored"),
        F.sum("conceded").alias("conceded"),
        F.avg("scored").alias("scored_mean"),
        F.avg("conceded").alias("conceded_mean"),
        F.sum("points").alias("points"),
    )


def team_context(sides: DataFrame, width: int = 5) -> DataFrame:
    """What is known of each team before each of its periods: recent strength, totals, rates and its rank in the period."""
    entity, order = ["season", "team_id"], ["period"]
    before = trailing(entity, order, None)
    out = by_period(sides).withColumns({
        "attack_recent": F.avg("scored_mean").over(trailing(entity, order, width)),
        "defence_recent": F.avg("conceded_mean").over(trailing(entity, order, width)),
        "points_before": F.sum("points").over(before),
        "matches_before": F.sum("matches").over(before),
        "goal_diff_before": F.sum(F.col("scored") - F.col("conceded")).over(before),
    })
    out = out.withColumn("points_per_match", F.col("points_before") / F.col("matches_before")).withColumn("goal_diff_per_match", F.col("goal_diff_before") / F.col("matches_before"))
    return out.withColumn("rank_before", standing(["season", "period"]))


def standing(group: Sequence[str]) -> Column:
    """Rank by points a match, goal difference a match and points, unknown last, then by id."""
    low = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-9999.0)).desc()
    return F.row_number().over(Window.partitionBy(*group).orderBy(low("points_per_match"), low("goal_diff_per_match"), low("points_before"), F.col("team_id")))


OPPONENT = ["rank_before", "points_per_match", "goal_diff_per_match", "attack_recent", "defence_recent"]


def attach_opponent(sides: DataFrame, context: DataFrame) -> DataFrame:
    """Sides with the opponent's context of the same period."""
    other = context.select("season", "period", F.col("team_id").alias("opponent_id"), *(F.col(c).alias(f"opponent_{c}") for c in OPPONENT))
    return sides.join(other, ["season", "period", "opponent_id"], "left")


def difficulty(attack: str | Column, defence: str | Column) -> dict[str, Column]:
    """How hard an opponent of such recent strength is to score against and to keep from scoring."""
    return {"difficulty_attack": 1.0 / (F.coalesce(defence, F.lit(1.0)) + 0.5), "difficulty_defence": F.coalesce(attack, F.lit(0.0))}


def fixture_context(sides: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Sides with opponent context and difficulty: 1 / (conceded + 0.5) against attack, goals scored against defence."""
    rows = attach_opponent(sides, team_context(sides) if context is None else context)
    return rows.withColumns(difficulty("opponent_attack_recent", "opponent_defence_recent"))


def recent_form(sides: DataFrame, n: int, prior: float | None = None, entity: Sequence[str] = ("season", "team_id")) -> DataFrame:
    """Sides with the mean points of the team's last n matches before, ties of kickoff by match id; `prior` if there are none."""
    form = F.avg("points").over(trailing(entity, ["kickoff", "match_id"], n))
    return sides.withColumn("form", form if prior is None else F.coalesce(form, F.lit(prior)))


def form_table(sides: DataFrame, n: int, entity: Sequence[str] = ("team_id",)) -> DataFrame:
    """Each team's last n matches: means, clean-sheet rate and the matches in order."""
    latest = Window.partitionBy(*entity).orderBy(F.desc("kickoff"), F.desc("match_id"))
    rows = sides.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n)
    return rows.groupBy(*entity).agg(
        F.count("*").alias("matches"),
        F.avg("points").alias("points_mean"),
        F.avg("scored").alias("scored_mean"),
        F.avg("conceded").alias("conceded_mean"),
        F.avg(F.when(F.col("conceded") == 0, 1.0).otherwise(0.0)).alias("clean_sheet_rate"),
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "match_id"))), lambda x: x["match_id"]).alias("match_ids"),
    )


def side_rest(sides: DataFrame, entity: Sequence[str] = ("team_id",)) -> DataFrame:
    """Sides with the days since the team's match before."""
    before = F.lag("kickoff").over(ordered(entity, ["kickoff", "match_id"]))
    return sides.withColumn("rest_days", days_between(before, F.col("kickoff")))


def pair_history(matches: DataFrame, n: int, within: Sequence[str] = ()) -> DataFrame:
    """Of each match the n meetings of the same two teams before it (in its season, say), whoever was at home, seen from its home team.

    The pair is keyed by its smaller and larger id; scores are kept from the smaller id's view, so one
    window over the pair serves both directions. Meetings at the same time are ordered by id.
    """
    low_home = F.col("home_id") < F.col("away_id")
    rows = matches.withColumns({
        "_low": F.least("home_id", "away_id"),
        "_high": F.greatest("home_id", "away_id"),
        "_diff": F.when(low_home, F.col("home_score") - F.col("away_score")).otherwise(F.col("away_score") - F.col("home_score")),
    })
    w = trailing([*within, "_low", "_high"], ["kickoff", "match_id"], n)
    wins = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w), F.lit(0))
    low_wins, high_wins = wins(F.col("_diff") > 0), wins(F.col("_diff") < 0)
    return rows.select(
        *matches.columns,
        F.count(F.lit(1)).over(w).alias("meetings"),
        F.when(low_home, low_wins).otherwise(high_wins).alias("home_wins"),
        wins(F.col("_diff") == 0).alias("draws"),
        F.when(low_home, high_wins).otherwise(low_wins).alias("away_wins"),
        F.avg(F.col("home_score") + F.col("away_score")).over(w).alias("goals_mean"),
        F.when(low_home, F.avg(points("_diff", F.lit(0))).over(w)).otherwise(F.avg(points(F.lit(0), "_diff")).over(w)).alias("home_points_mean"),
        (F.avg("_diff").over(w) * F.when(low_home, 1).otherwise(-1)).alias("home_goal_diff_mean"),
    )


def season_table(sides: DataFrame) -> DataFrame:
    """Played, won, drawn, lost, goals, points, clean sheets and rates of each team and season, home and away apart."""
    at = lambda home, c: F.sum(F.when(F.col("is_home") == home, F.col(c)).otherwise(0))
    out = sides.groupBy("season", "team_id").agg(
        F.count("*").alias("played"),
        F.count_if(F.col("points") == WIN).alias("won"),
        F.count_if(F.col("points") == DRAW).alias("drawn"),
        F.count_if(F.col("points") == 0).alias("lost"),
        F.sum("scored").alias("scored"),
        F.sum("conceded").alias("conceded"),
        F.sum("points").alias("points"),
        F.count_if(F.col("conceded") == 0).alias("clean_sheets"),
        at(True, "points").alias("home_points"),
        at(False, "points").alias("away_points"),
    )
    return out.withColumn("points_per_match", F.col("points") / F.col("played")).withColumn("clean_sheet_rate", F.col("clean_sheets") / F.col("played"))
