"""Queries of the feature frames that join several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features as f
from tidemark.operators import horizon as h
from tidemark.operators import summaries as su
from tidemark.operators.rolling import last_per_group
from tidemark.plans.event_queries import CONTEXT
from tidemark.plans.frames import MATCHES, SIDES, USER_DAYS, matches, sides, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import table

POSITIONS, STATUSES = ("GKP", "DEF", "MID", "FWD"), ("a", "d")
MEANS = ("points_mean3", "points_mean5", "points_mean8", "minutes_mean3", "minutes_mean5", "minutes_nonzero_rate5")
TEAM = ("home_ratio", "opponent_rank_before", "opponent_points_per_match", "opponent_goal_diff_per_match", "opponent_attack_recent", "opponent_defence_recent", "difficulty_attack", "difficulty_defence", "points_per_match", "goal_diff_per_match", "attack_recent", "defence_recent")
SUMS = ("goals_sum5", "assists_sum5", "clean_sheets_sum5", "long_matches5")


def _rounded(names) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in names)


#: Each active day of a user is a match week of a player of one of the nations.
PLAYER_ROWS = f"""{USER_DAYS}, player_rows AS (
    SELECT CAST(1995 + (day - 1) // 12 AS BIGINT) AS season, user_id AS player_id, day AS period, user_id % 25 AS team_id, ['GKP', 'DEF', 'MID', 'FWD'][user_id % 4 + 1] AS position, CASE WHEN user_id % 11 = 0 THEN 'd' ELSE 'a' END AS status,
           user_id % 60 + 40 AS price, points, minutes, goals, assists, saves AS clean_sheets FROM user_days)"""


def player_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return user_days(spark, sf_dir).select(
        (F.lit(1995) + F.floor((F.col("day") - 1) / 12)).cast("long").alias("season"), user.alias("player_id"), F.col("day").alias("period"), (user % 25).alias("team_id"),
        F.get(F.array(*map(F.lit, POSITIONS)), (user % 4).cast("int")).alias("position"), F.when(user % 11 == 0, "d").otherwise("a").alias("status"),
        (user % 60 + 40).alias("price"), "points", "minutes", "goals", "assists", F.col("saves").alias("clean_sheets"),
    )


@query(
    "p02_player_features_v2",
    f"""WITH {CONTEXT}, {PLAYER_ROWS}, faced AS (
        SELECT s.season, s.team_id, s.period, count(*) AS fixtures, avg(CASE WHEN is_home THEN 1 ELSE 0 END) AS home_ratio, avg(c.rank_before) AS opponent_rank_before, avg(c.points_per_match) AS opponent_points_per_match,
               avg(c.goal_diff_per_match) AS opponent_goal_diff_per_match, avg(c.attack_recent) AS opponent_attack_recent, avg(c.defence_recent) AS opponent_defence_recent,
               avg(1.0 / (coalesce(c.defence_recent, 1.0) + 0.5)) AS difficulty_attack, avg(coalesce(c.attack_recent, 0.0)) AS difficulty_defence
        FROM sides s LEFT JOIN context c ON c.season = s.season AND c.period = s.period AND c.team_id = s.opponent_id GROUP BY 1, 2, 3),
    form AS (
        SELECT *, lag(points) OVER w AS points_last1, lag(minutes) OVER w AS minutes_last1, avg(points) OVER w3 AS points_mean3, avg(points) OVER w5 AS points_mean5, avg(points) OVER w8 AS points_mean8, avg(minutes) OVER w3 AS minutes_mean3, avg(minutes) OVER w5 AS minutes_mean5,
               sum(CASE WHEN minutes > 0 THEN 1 ELSE 0 END) OVER w5 / least(5, row_number() OVER w) AS minutes_nonzero_rate5, sum(goals) OVER w5 AS goals_sum5, sum(assists) OVER w5 AS assists_sum5, sum(clean_sheets) OVER w5 AS clean_sheets_sum5, sum(CASE WHEN minutes >= 2 THEN 1 ELSE 0 END) OVER w5 AS long_matches5
        FROM player_rows WINDOW w AS (PARTITION BY season, player_id ORDER BY period), w3 AS (PARTITION BY season, player_id ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
            w5 AS (PARTITION BY season, player_id ORDER BY period ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w8 AS (PARTITION BY season, player_id ORDER BY period ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT form.season, player_id, form.period, form.team_id, price, form.points, minutes, points_last1, minutes_last1, {_rounded(MEANS)}, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in SUMS)}, fixtures, rank_before, {_rounded(TEAM)},
           CAST(coalesce(home_ratio, 0) >= 0.5 AS INTEGER) AS is_home, {", ".join(f"CAST(position = '{p}' AS INTEGER) AS position_{p}" for p in POSITIONS)}, {", ".join(f"CAST(status = '{s}' AS INTEGER) AS status_{s}" for s in STATUSES)}
    FROM form LEFT JOIN faced ON faced.season = form.season AND faced.team_id = form.team_id AND faced.period = form.period LEFT JOIN (SELECT season, team_id, period, rank_before, points_per_match, goal_diff_per_match, attack_recent, defence_recent FROM context) c ON c.season = form.season AND c.team_id = form.team_id AND c.period = form.period
    WHERE points_last1 IS NOT NULL AND minutes_last1 IS NOT NULL""",
)
def player_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing form of every player and week with the context of the team and of its opponents."""
    out = f.player_features(player_rows(spark, sf_dir), sides(spark, sf_dir), POSITIONS, STATUSES, long_minutes=2)
    marks = [*(f"position_{p}" for p in POSITIONS), *(f"status_{s}" for s in STATUSES)]
    return out.select(
        "season", "player_id", "period", "team_id", "price", "points", "minutes", "points_last1", "minutes_last1", *(F.round(c, 6).alias(c) for c in MEANS), *(F.col(c).cast("long").alias(c) for c in SUMS),
        "fixtures", F.col("rank_before").cast("long").alias("rank_before"), *(F.round(c, 6).alias(c) for c in TEAM), "is_home", *marks,
    )


WHOLE = ("home_rank_before", "away_rank_before", "rank_diff", "home_score", "away_score", "home_goals", "away_goals", "meetings")
REAL = [f"{side}_{c}" for c in f.SIDE if c != "rank_before" for side in ("home", "away")] + ["strength_diff", "points_per_match_diff", "goal_diff_per_match_diff", "home_points_mean", "home_goal_diff_mean"]


@query(
    "p07_match_dataset_v2",
    f"""WITH {CONTEXT}, rest AS (SELECT match_id, team_id, (epoch_us(kickoff) - lag(epoch_us(kickoff)) OVER (PARTITION BY season, team_id ORDER BY kickoff, match_id)) / 86400000000 AS rest_days FROM sides),
    side AS (SELECT s.match_id, s.is_home, c.rank_before, c.points_per_match, c.goal_diff_per_match, c.attack_recent AS scored_recent, c.defence_recent AS conceded_recent, c.attack_recent, c.defence_recent, r.rest_days,
                1.0 / (coalesce(o.defence_recent, 1.0) + 0.5) AS difficulty, 1.0 / (coalesce(o.defence_recent, 1.0) + 0.5) AS difficulty_attack, coalesce(o.attack_recent, 0.0) AS difficulty_defence
             FROM sides s JOIN context c ON c.season = s.season AND c.period = s.period AND c.team_id = s.team_id LEFT JOIN context o ON o.season = s.season AND o.period = s.period AND o.team_id = s.opponent_id JOIN rest r ON r.match_id = s.match_id AND r.team_id = s.team_id),
    met AS (SELECT match_id, home_id, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi, season, kickoff, CASE WHEN home_id < away_id THEN home_score - away_score ELSE away_score - home_score END AS d FROM matches),
    h2h AS (SELECT match_id, home_id = lo AS low_home, count(*) OVER w AS meetings, avg(CASE WHEN d > 0 THEN 3 WHEN d = 0 THEN 1 ELSE 0 END) OVER w AS lo_points, avg(CASE WHEN d < 0 THEN 3 WHEN d = 0 THEN 1 ELSE 0 END) OVER w AS hi_points, avg(d) OVER w AS diff
            FROM met WINDOW w AS (PARTITION BY season, lo, hi ORDER BY kickoff, match_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    joined AS (SELECT m.*, home_score AS home_goals, away_score AS away_goals, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS label, {", ".join(f"{x}.{c} AS {side}_{c}" for c in f.SIDE for side, x in (("home", "h"), ("away", "a")))},
            h.attack_recent - a.attack_recent AS strength_diff, h.points_per_match - a.points_per_match AS points_per_match_diff, h.goal_diff_per_match - a.goal_diff_per_match AS goal_diff_per_match_diff, a.rank_before - h.rank_before AS rank_diff,
            meetings, CASE WHEN low_home THEN lo_points ELSE hi_points END AS home_points_mean, CASE WHEN low_home THEN diff ELSE -diff END AS home_goal_diff_mean
        FROM matches m JOIN side h ON h.match_id = m.match_id AND h.is_home JOIN side a ON a.match_id = m.match_id AND NOT a.is_home JOIN h2h ON h2h.match_id = m.match_id)
    SELECT season, match_id, period, kickoff, home_id, away_id, label, {", ".join(WHOLE)}, {_rounded(REAL)} FROM joined""",
)
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing, recent strength, rest, difficulty and last meetings of both sides, one row per match, 40 columns."""
    out = f.match_features(matches(spark, sf_dir), digits=6)
    return out.select("season", "match_id", "period", "kickoff", "home_id", "away_id", "label", *(F.col(c).cast("long").alias(c) for c in WHOLE), *REAL)


FLAGS = ("has_fixture", "blank", "has_prior", "no_prior", "promoted", "opponent_promoted", "uncertain_status", "missing_price", "missing_position", "missing_strength", "missing_fixture", "team_fallback", "opponent_fallback", "write_allowed", "production_ready")


@query(
    "p11_preseason_players",
    f"""WITH {SIDES}, players AS (SELECT p_partkey AS player_id, p_partkey % 30 AS team_id, CASE WHEN p_size = 1 THEN ' ' ELSE p_type END AS position, CASE WHEN p_size % 7 = 0 THEN 'd' ELSE 'A' END AS status, CASE WHEN p_size <> 2 THEN p_retailprice END AS price FROM part),
    teams AS (SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team, 'T' || n_nationkey AS short FROM nation),
    fixtures AS (SELECT s.team_id, match_id AS fixture_id, opponent_id, short AS opponent_short FROM sides s LEFT JOIN teams ON teams.team_id = opponent_id WHERE period = 1 AND s.team_id <> 7 QUALIFY row_number() OVER (PARTITION BY s.team_id ORDER BY kickoff, match_id) = 1),
    mapping AS (SELECT p_partkey AS player_id, 'raw' || p_partkey AS raw_key, 'auto' AS mapping_status FROM part WHERE p_partkey % 3 <> 0),
    priors AS (SELECT 'raw' || l_partkey AS raw_key, CASE WHEN l_partkey % 5 > 0 THEN 'lines' END AS prior_source, count(*) AS minutes_prior, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS points_prior FROM lineitem GROUP BY l_partkey),
    mean AS (SELECT team_id, avg(points) AS points FROM sides WHERE season = 1996 AND team_id < 20 GROUP BY 1),
    strengths AS (SELECT f.fixture_id, f.team_id, f.team_id < 3 AS team_fallback, opponent_id < 3 AS opponent_fallback, a.points AS team_points, b.points AS opponent_points FROM fixtures f LEFT JOIN mean a ON a.team_id = f.team_id LEFT JOIN mean b ON b.team_id = opponent_id)
    SELECT p.player_id, p.team_id, team, f.fixture_id, f.opponent_id, m.raw_key, coalesce(mapping_status, 'no_safe_accepted_mapping') AS mapping_status, minutes_prior, points_prior, round(team_points, 6) AS team_points, round(opponent_points, 6) AS opponent_points,
        f.fixture_id IS NOT NULL AS has_fixture, f.fixture_id IS NULL AS blank, m.raw_key IS NOT NULL AND prior_source IS NOT NULL AND minutes_prior IS NOT NULL AS has_prior, NOT (m.raw_key IS NOT NULL AND prior_source IS NOT NULL AND minutes_prior IS NOT NULL) AS no_prior,
        coalesce(t.short IN ('T1', 'T2'), false) AS promoted, coalesce(opponent_short IN ('T1', 'T2'), false) AS opponent_promoted, lower(status) <> 'a' AS uncertain_status, price IS NULL OR price <= 0 AS missing_price, trim(position) = '' AS missing_position,
        team_points IS NULL OR opponent_points IS NULL AS missing_strength, f.fixture_id IS NULL OR f.opponent_id IS NULL AS missing_fixture, coalesce(team_fallback, false) AS team_fallback, coalesce(opponent_fallback, false) AS opponent_fallback, false AS write_allowed, false AS production_ready, '1996_97' AS target_season
    FROM players p LEFT JOIN teams t USING (team_id) LEFT JOIN fixtures f USING (team_id) LEFT JOIN mapping m ON m.player_id = p.player_id LEFT JOIN priors ON priors.raw_key = m.raw_key LEFT JOIN strengths s ON s.fixture_id = f.fixture_id AND s.team_id = p.team_id""",
)
def preseason_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as players before a season: club, first fixture, accepted identity, prior and team strength, with flags for what is missing."""
    part, lines, both = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), sides(spark, sf_dir)
    size, key = F.col("p_size"), F.concat(F.lit("raw"), F.col("p_partkey"))
    players = part.select(F.col("p_partkey").alias("player_id"), (F.col("p_partkey") % 30).alias("team_id"), F.when(size == 1, " ").otherwise(F.col("p_type")).alias("position"), F.when(size % 7 == 0, "d").otherwise("A").alias("status"), F.when(size != 2, F.col("p_retailprice")).alias("price"))
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team"), F.concat(F.lit("T"), F.col("n_nationkey")).alias("short"))
    first = last_per_group(both.where("period = 1 AND team_id <> 7"), ["team_id"], [F.asc("kickoff"), F.asc("match_id")])
    fixtures = first.join(teams.select(F.col("team_id").alias("opponent_id"), F.col("short").alias("opponent_short")), "opponent_id", "left").select("team_id", F.col("match_id").alias("fixture_id"), "opponent_id", "opponent_short")
    mapping = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("player_id"), key.alias("raw_key"), F.lit("auto").alias("mapping_status"))
    sold = lines.groupBy("l_partkey").agg(F.count("*").alias("minutes_prior"), F.sum(F.col("l_quantity").cast("long")).alias("points_prior"))
    priors = sold.select(F.concat(F.lit("raw"), F.col("l_partkey")).alias("raw_key"), F.when(F.col("l_partkey") % 5 > 0, "lines").alias("prior_source"), "minutes_prior", "points_prior")
    mean = both.where("season = 1996 AND team_id < 20").groupBy("team_id").agg(F.avg("points").alias("team_points"))
    strengths = fixtures.join(mean, "team_id", "left").join(mean.select(F.col("team_id").alias("opponent_id"), F.col("team_points").alias("opponent_points")), "opponent_id", "left")
    strengths = strengths.select("fixture_id", "team_id", (F.col("team_id") < 3).alias("team_fallback"), (F.col("opponent_id") < 3).alias("opponent_fallback"), "team_points", "opponent_points")
    out = f.preseason_players(players, teams, fixtures, mapping, priors, strengths, ["T1", "T2"], ["points_prior"], ["team_points", "opponent_points"], {"target_season": "1996_97"})
    return out.select("player_id", "team_id", "team", "fixture_id", "opponent_id", "raw_key", "mapping_status", "minutes_prior", "points_prior", F.round("team_points", 6).alias("team_points"), F.round("opponent_points", 6).alias("opponent_points"), *FLAGS, "target_season")


TEAMS_KNOWN = 24


@query(
    "v13_horizon_report",
    f"""WITH {MATCHES}, f AS (SELECT match_id, season, period, kickoff, CASE WHEN home_score = 0 THEN NULL ELSE kickoff END AS now_at, home_id, away_id, home_score + away_score > 7 AS started FROM matches WHERE period BETWEEN 30 AND 34),
    k AS (SELECT *, count(*) OVER (PARTITION BY season, period, home_id, away_id) AS keys, count(*) OVER (PARTITION BY season, period, least(home_id, away_id), greatest(home_id, away_id)) AS pairs FROM f),
    b AS (SELECT match_id, CASE WHEN away_score = 0 THEN NULL WHEN home_score = 2 THEN kickoff + INTERVAL 1 DAY ELSE kickoff END AS was FROM matches WHERE period BETWEEN 29 AND 33),
    c AS (SELECT count(*) FILTER (was <> now_at) AS changed_kickoff, count(*) FILTER (f.match_id IS NOT NULL AND was IS NULL AND now_at IS NOT NULL) AS newly_known_kickoff, count(*) FILTER (was IS NOT NULL AND f.match_id IS NOT NULL AND now_at IS NULL) AS lost_kickoff, count(*) FILTER (f.match_id IS NULL) AS removed FROM b LEFT JOIN f USING (match_id))
    SELECT count(*) AS fixtures, count(*) FILTER (home_id >= {TEAMS_KNOWN} OR away_id >= {TEAMS_KNOWN}) AS unknown_team, count(*) FILTER (keys > 1) AS repeated_key, count(*) FILTER (pairs > 1) AS repeated_pairing, 35 - 30 - count(DISTINCT period) AS missing_periods,
        count(*) FILTER (now_at IS NULL) AS missing_kickoff, count(*) FILTER (started) AS started, any_value(changed_kickoff) AS changed_kickoff, any_value(newly_known_kickoff) AS newly_known_kickoff, any_value(lost_kickoff) AS lost_kickoff, any_value(removed) AS removed,
        count(*) FILTER (home_id >= {TEAMS_KNOWN} OR away_id >= {TEAMS_KNOWN} OR pairs > 1) = 0 AND count(DISTINCT period) = 5 AS passed FROM k, c""",
)
def horizon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five periods of matches against the horizon of a period before: one nation is not known, some kickoffs are not known yet or were not then, or have moved."""
    rows = matches(spark, sf_dir)
    text = lambda c: c.cast("string")
    now = rows.where("period BETWEEN 30 AND 34").withColumns({"kickoff": F.when(F.col("home_score") != 0, text(F.col("kickoff"))), "started": F.col("home_score") + F.col("away_score") > 7, "finished": F.lit(False)})
    moved = F.when(F.col("home_score") == 2, F.col("kickoff") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("kickoff"))
    before = rows.where("period BETWEEN 29 AND 33").select("match_id", F.when(F.col("away_score") != 0, text(moved)).alias("kickoff"))
    teams = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < TEAMS_KNOWN).select(F.col("n_nationkey").cast("long").alias("team_id"))
    names = ("fixtures", "unknown_team", "repeated_key", "repeated_pairing", "missing_periods", "missing_kickoff", "started", "changed_kickoff", "newly_known_kickoff", "lost_kickoff", "removed", "passed")
    return h.horizon_report(now, teams, 30, 34, before).select(*names)


@query(
    "v03_season_report",
    f"""WITH {MATCHES}, {PLAYER_ROWS}, g AS (SELECT season, count(*) AS fixtures, min(period) AS fixture_first, max(period) AS fixture_last, count(DISTINCT period) AS fixture_periods, count(*) FILTER (home_score > 0) AS finished, count(DISTINCT home_id) + count(DISTINCT away_id) AS sides FROM matches GROUP BY 1),
    p AS (SELECT season, count(*) AS player_rows, count(DISTINCT player_id) AS players, min(period) AS player_first, max(period) AS player_last, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(points) AS BIGINT) AS points FROM player_rows GROUP BY 1)
    SELECT coalesce(g.season, p.season) AS season, coalesce(fixtures, 0) AS fixtures, fixture_first, fixture_last, coalesce(fixture_periods, 0) AS fixture_periods, coalesce(finished, 0) AS finished, coalesce(sides, 0) AS sides, coalesce(player_rows, 0) AS player_rows, coalesce(players, 0) AS players,
        player_first, player_last, coalesce(minutes, 0) AS minutes, coalesce(points, 0) AS points, 0::BIGINT AS repeated_player_rows, coalesce(player_rows, 0) > 0 AS ready_for_priors, coalesce(fixtures, 0) > 0 AS ready_for_matches FROM g FULL JOIN p ON g.season = p.season""",
)
def season_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixtures = matches(spark, sf_dir).withColumn("finished", F.col("home_score") > 0)
    names = ("season", "fixtures", "fixture_first", "fixture_last", "fixture_periods", "finished", "sides", "player_rows", "players", "player_first", "player_last", "minutes", "points", "repeated_player_rows", "ready_for_priors", "ready_for_matches")
    return su.season_report(fixtures, player_rows(spark, sf_dir)).select(*names)
