"""Entity-and-period frames over the driver's tables, each with the SQL that DuckDB builds it from.

Money is summed in cents, as whole numbers, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.events import two_sided
from tidemark.sources.readers import table

DAY_ZERO = "2023-12-31"


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and active day (1..30): minutes (events), points (cents), goals, assists, cards, saves."""
    e = table(spark, sf_dir, "events")
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return e.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit(DAY_ZERO)).cast("long").alias("day")).agg(
        F.count("*").alias("minutes"),
        F.sum(cents("value")).alias("points"),
        kind("purchase").alias("goals"),
        kind("click").alias("assists"),
        kind("error").alias("cards"),
        kind("view").alias("saves"),
    )


USER_DAYS = f"""
    user_days AS (
        SELECT user_id, CAST(date_diff('day', DATE '{DAY_ZERO}', CAST(ts AS DATE)) AS BIGINT) AS day, count(*) AS minutes,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS points,
               count(*) FILTER (event_type = 'purchase') AS goals, count(*) FILTER (event_type = 'click') AS assists,
               count(*) FILTER (event_type = 'error') AS cards, count(*) FILTER (event_type = 'view') AS saves
        FROM events GROUP BY 1, 2
    )"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order whose customer and first supplier are of two nations: home, away, scores by return flag."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id")).agg(
        F.min("l_suppkey").alias("s_suppkey"),
        F.count_if(F.col("l_returnflag") == "R").alias("home_score"),
        F.count_if(F.col("l_returnflag") == "A").alias("away_score"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("kickoff"))
    home = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("home_id"))
    away = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("away_id"))
    rows = orders.join(lines, "match_id").join(home, "c_custkey").join(away, "s_suppkey").where("home_id <> away_id")
    period = (F.year("kickoff") - 1995) * 12 + F.month("kickoff")
    return rows.select("match_id", F.year("kickoff").cast("long").alias("season"), period.cast("long").alias("period"), "kickoff", "home_id", "away_id", "home_score", "away_score")


MATCHES = """
    matches AS (
        SELECT o_orderkey AS match_id, CAST(year(o_orderdate) AS BIGINT) AS season, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS BIGINT) AS period,
               o_orderdate AS kickoff, CAST(c_nationkey AS BIGINT) AS home_id, CAST(s_nationkey AS BIGINT) AS away_id, home_score, away_score
        FROM orders
        JOIN (SELECT l_orderkey, min(l_suppkey) AS first_supplier, count(*) FILTER (l_returnflag = 'R') AS home_score, count(*) FILTER (l_returnflag = 'A') AS away_score
              FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
        JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = first_supplier
        WHERE c_nationkey <> s_nationkey
    )"""


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_sided(matches(spark, sf_dir))


SIDES = (
    MATCHES
    + """,
    sides AS (
        SELECT match_id, season, period, kickoff, team_id, opponent_id, is_home, scored, conceded,
               CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END AS points
        FROM (SELECT match_id, season, period, kickoff, home_id AS team_id, away_id AS opponent_id, true AS is_home, home_score AS scored, away_score AS conceded FROM matches
              UNION ALL
              SELECT match_id, season, period, kickoff, away_id, home_id, false, away_score, home_score FROM matches)
    )"""
)


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as players: id, name, club (brand), position (type), price in tenths."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("club"), F.col("p_type").alias("position"), F.round(F.col("p_retailprice") * 10).cast("long").alias("price"), F.col("p_size").cast("long").alias("size"))


PLAYERS = """
    players AS (
        SELECT p_partkey AS player_id, p_name AS name, p_brand AS club, p_type AS position, CAST(round(p_retailprice * 10) AS BIGINT) AS price, CAST(p_size AS BIGINT) AS size FROM part
    )"""


def player_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with their predicted points: the units sold of the part, 0 if none."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("player_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("points"), F.count("*").alias("games"))
    return players(spark, sf_dir).join(sold, "player_id", "left").withColumns({"points": F.coalesce("points", F.lit(0)), "games": F.coalesce("games", F.lit(0))})


PLAYER_POINTS = (
    PLAYERS
    + """,
    player_points AS (
        SELECT p.*, coalesce(s.points, 0) AS points, coalesce(s.games, 0) AS games
        FROM players p LEFT JOIN (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS points, count(*) AS games FROM lineitem GROUP BY 1) s ON l_partkey = player_id
    )"""
)
