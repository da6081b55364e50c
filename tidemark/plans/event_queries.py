"""Queries of two-sided events over nations and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events as e
from tidemark.plans.frames import MATCHES, SIDES, matches, sides
from tidemark.plans.registry import query

BY_PERIOD = (
    SIDES
    + """,
    by_period AS (
        SELECT season, team_id, period, count(*) AS matches, avg(CASE WHEN is_home THEN 1 ELSE 0 END) AS home_ratio, CAST(sum(scored) AS BIGINT) AS scored,
               CAST(sum(conceded) AS BIGINT) AS conceded, avg(scored) AS scored_mean, avg(conceded) AS conceded_mean, CAST(sum(points) AS BIGINT) AS points
        FROM sides GROUP BY season, team_id, period
    )"""
)
CONTEXT = (
    BY_PERIOD
    + """,
    totals AS (
        SELECT *, avg(scored_mean) OVER five AS attack_recent, avg(conceded_mean) OVER five AS defence_recent, CAST(sum(points) OVER b AS BIGINT) AS points_before,
               CAST(sum(matches) OVER b AS BIGINT) AS matches_before, CAST(sum(scored - conceded) OVER b AS BIGINT) AS goal_diff_before
        FROM by_period
        WINDOW five AS (PARTITION BY season, team_id ORDER BY period ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
               b AS (PARTITION BY season, team_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    context AS (
        SELECT *, points_before / matches_before AS points_per_match, goal_diff_before / matches_before AS goal_diff_per_match,
               row_number() OVER (PARTITION BY season, period ORDER BY coalesce(points_before / matches_before, -9999) DESC, coalesce(goal_diff_before / matches_before, -9999) DESC,
                                  coalesce(points_before, -9999) DESC, team_id) AS rank_before
        FROM totals
    )"""
)


@query("u01_two_sided", f"WITH {SIDES} SELECT match_id, team_id, opponent_id, is_home, scored, conceded, points FROM sides")
def two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("match_id", "team_id", "opponent_id", "is_home", "scored", "conceded", "points")


@query("a03_totals_by_period", f"WITH {BY_PERIOD} SELECT * FROM by_period")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.by_period(sides(spark, sf_dir))


@query("p04_team_context", f"WITH {CONTEXT} SELECT * REPLACE (round(attack_recent, 6) AS attack_recent, round(defence_recent, 6) AS defence_recent) FROM context")
def team_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = e.team_context(sides(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("attack_recent", "defence_recent")}).withColumn("rank_before", F.col("rank_before").cast("long"))


@query(
    "p05_fixture_context",
    f"""WITH {CONTEXT} SELECT s.match_id, s.team_id, s.opponent_id, c.rank_before AS opponent_rank_before, c.points_per_match AS opponent_points_per_match,
            c.goal_diff_per_match AS opponent_goal_diff_per_match, round(1.0 / (coalesce(c.defence_recent, 1.0) + 0.5), 6) AS difficulty_attack, round(coalesce(c.attack_recent, 0.0), 6) AS difficulty_defence
        FROM sides s LEFT JOIN context c ON c.season = s.season AND c.period = s.period AND c.team_id = s.opponent_id""",
)
def fixture_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side with its opponent's context before the period."""
    out = e.fixture_context(sides(spark, sf_dir))
    return out.select(
        "match_id", "team_id", "opponent_id", F.col("opponent_rank_before").cast("long").alias("opponent_rank_before"), "opponent_points_per_match", "opponent_goal_diff_per_match", F.round("difficulty_attack", 6).alias("difficulty_attack"), F.round("difficulty_defence", 6).alias("difficulty_defence")
    )


FORM = "avg(points) OVER (PARTITION BY season, team_id ORDER BY kickoff, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query("j09_recent_form", f"WITH {SIDES} SELECT match_id, team_id, {FORM} AS form FROM sides")
def recent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.recent_form(sides(spark, sf_dir), 5).select("match_id", "team_id", "form")


@query(
    "p06_match_dataset_v0",
    f"""WITH {SIDES}, form AS (SELECT match_id, is_home, coalesce({FORM}, 1.0) AS form FROM sides)
    SELECT m.match_id, m.period, h.form AS home_form, a.form AS away_form, h.form - a.form AS form_diff,
           CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS label
    FROM matches m JOIN form h ON h.match_id = m.match_id AND h.is_home JOIN form a ON a.match_id = m.match_id AND NOT a.is_home""",
)
def match_dataset_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of both sides, brought back to one row per match by one conditional aggregation."""
    form = e.recent_form(sides(spark, sf_dir), 5, prior=1.0)
    side = lambda home, c: F.max(F.when(F.col("is_home") == home, F.col(c)))
    rows = form.groupBy("match_id", "period").agg(side(True, "form").alias("home_form"), side(False, "form").alias("away_form"), side(True, "scored").alias("h"), side(True, "conceded").alias("a"))
    return rows.select("match_id", "period", "home_form", "away_form", (F.col("home_form") - F.col("away_form")).alias("form_diff"), e.result_label("h", "a").alias("label"))


@query(
    "j10_pair_history",
    f"""WITH {MATCHES}, p AS (SELECT match_id, home_id, away_id, kickoff, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi, home_score + away_score AS goals,
            CASE WHEN home_score > away_score THEN home_id WHEN home_score < away_score THEN away_id END AS winner FROM matches),
    q AS (SELECT *, count(*) OVER w AS meetings, coalesce(count(*) FILTER (winner = lo) OVER w, 0) AS lo_wins, coalesce(count(*) FILTER (winner = hi) OVER w, 0) AS hi_wins,
            coalesce(count(*) FILTER (winner IS NULL) OVER w, 0) AS draws, avg(goals) OVER w AS goals_mean
          FROM p WINDOW w AS (PARTITION BY lo, hi ORDER BY kickoff, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
    SELECT match_id, meetings, CASE WHEN home_id = lo THEN lo_wins ELSE hi_wins END AS home_wins, draws, CASE WHEN home_id = lo THEN hi_wins ELSE lo_wins END AS away_wins, goals_mean FROM q""",
)
def pair_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.pair_history(matches(spark, sf_dir), 5).select("match_id", "meetings", *(F.col(c).cast("long").alias(c) for c in ("home_wins", "draws", "away_wins")), "goals_mean")


@query(
    "a05_season_table",
    f"""WITH {SIDES} SELECT season, team_id, count(*) AS played, count(*) FILTER (points = 3) AS won, count(*) FILTER (points = 1) AS drawn, count(*) FILTER (points = 0) AS lost,
            CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(conceded) AS BIGINT) AS conceded, CAST(sum(points) AS BIGINT) AS points, count(*) FILTER (conceded = 0) AS clean_sheets,
            CAST(coalesce(sum(points) FILTER (is_home), 0) AS BIGINT) AS home_points, CAST(coalesce(sum(points) FILTER (NOT is_home), 0) AS BIGINT) AS away_points,
            sum(points) / count(*) AS points_per_match, count(*) FILTER (conceded = 0) / count(*) AS clean_sheet_rate
        FROM sides GROUP BY season, team_id""",
)
def season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.season_table(sides(spark, sf_dir))


@query(
    "a14_head_to_head",
    f"""WITH {MATCHES}, met AS (SELECT * FROM matches WHERE least(home_id, away_id) = 1 AND greatest(home_id, away_id) = 2 ORDER BY kickoff DESC, match_id DESC LIMIT 10)
    SELECT count(*) AS meetings, count(*) FILTER ((home_id = 1 AND home_score > away_score) OR (away_id = 1 AND away_score > home_score)) AS wins_first,
           count(*) FILTER (home_score = away_score) AS draws, count(*) FILTER ((home_id = 2 AND home_score > away_score) OR (away_id = 2 AND away_score > home_score)) AS wins_second,
           avg(home_score + away_score) AS goals_mean FROM met""",
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten meetings of two teams, whoever was at home."""
    met = matches(spark, sf_dir).where("(home_id = 1 AND away_id = 2) OR (home_id = 2 AND away_id = 1)").orderBy(F.desc("kickoff"), F.desc("match_id")).limit(10)
    won = lambda t: F.count_if(((F.col("home_id") == t) & (F.col("home_score") > F.col("away_score"))) | ((F.col("away_id") == t) & (F.col("away_score") > F.col("home_score"))))
    return met.agg(F.count("*").alias("meetings"), won(1).alias("wins_first"), F.count_if(F.col("home_score") == F.col("away_score")).alias("draws"), won(2).alias("wins_second"), F.avg(F.col("home_score") + F.col("away_score")).alias("goals_mean"))


@query(
    "a15_team_form",
    f"""WITH {SIDES}, latest AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) AS n FROM sides)
    SELECT team_id, count(*) AS matches, avg(points) AS points_mean, avg(scored) AS scored_mean, avg(conceded) AS conceded_mean, avg(CASE WHEN conceded = 0 THEN 1 ELSE 0 END) AS clean_sheet_rate,
           string_agg(match_id, '|' ORDER BY n) AS match_ids FROM latest WHERE n <= 5 GROUP BY team_id""",
)
def team_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.form_table(sides(spark, sf_dir), 5).withColumn("match_ids", F.concat_ws("|", F.col("match_ids").cast("array<string>")))
