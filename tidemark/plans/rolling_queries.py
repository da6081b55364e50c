"""Queries of trailing features over users and days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import rolling as r
from tidemark.plans.frames import PLAYER_POINTS, USER_DAYS, player_points, user_days
from tidemark.plans.registry import query

USER, DAY = ["user_id"], ["day"]
FIVE = "(PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"


@query(
    "p01_rolling_form",
    f"""WITH {USER_DAYS}, form AS (
        SELECT user_id, day, avg(points) OVER {FIVE} AS form, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS latest
        FROM user_days),
    kept AS (SELECT user_id, day, form FROM form WHERE latest = 1 AND form IS NOT NULL)
    SELECT user_id, day, form, row_number() OVER (ORDER BY form DESC, user_id) AS rank FROM kept""",
)
def rolling_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest day of every user with its trailing mean points, today excluded; best first."""
    days = user_days(spark, sf_dir).withColumn("form", r.trailing_mean("points", USER, DAY, 5))
    latest = r.last_per_group(days, USER, [F.desc("day")]).where("form IS NOT NULL")
    return r.ranked(latest.select("user_id", "day", "form"), "form", USER).select("user_id", "day", "form", F.col("rank").cast("long").alias("rank"))


def _means(measure: str, widths: tuple[int, ...]) -> str:
    return ", ".join(f"avg({measure}) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {measure}_mean{w}" for w in widths)


@query(
    "p01_player_features_v0",
    f"""WITH {USER_DAYS} SELECT * FROM (
        SELECT user_id, day, lag(points) OVER w AS points_last1, lag(minutes) OVER w AS minutes_last1, {_means("points", (3, 5, 8))}, {_means("minutes", (3, 5, 8))}
        FROM user_days WINDOW w AS (PARTITION BY user_id ORDER BY day)) WHERE points_last1 IS NOT NULL""",
)
def features_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.rolling_form(user_days(spark, sf_dir), USER, DAY, ["points", "minutes"])
    return out.drop("points", "minutes", "goals", "assists", "cards", "saves")


@query(
    "p03_player_features_v21",
    f"""WITH {USER_DAYS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn FROM user_days)
    SELECT user_id, day,
        CAST(sum(goals) OVER five AS BIGINT) AS goals_sum5, CAST(sum(assists) OVER five AS BIGINT) AS assists_sum5,
        sum(CASE WHEN goals > 0 THEN 1 ELSE 0 END) OVER five / least(5, rn) AS goals_rate5,
        CAST(sum(CASE WHEN minutes >= 2 THEN 1 ELSE 0 END) OVER five AS BIGINT) AS busy5,
        CAST(sum(CASE WHEN goals = 0 THEN 1 ELSE 0 END) OVER five AS BIGINT) AS blank5,
        stddev_samp(minutes) OVER five AS minutes_std5,
        avg(points) OVER three - avg(points) OVER five AS points_trend,
        coalesce(lag(goals, 1) OVER w = 0 AND lag(goals, 2) OVER w > 0, false) AS entering_absence,
        CASE WHEN rn > 1 THEN coalesce(rn - 1 - max(CASE WHEN goals = 0 THEN rn END) OVER eight, least(8, rn)) END AS since_zero8
    FROM numbered
    WINDOW w AS (PARTITION BY user_id ORDER BY day), three AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
        five AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), eight AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
)
def features_v21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, rates, conditional counts, deviation, trend and absence of the rows before."""
    days = r.numbered(user_days(spark, sf_dir), USER, DAY)
    return days.select(
        "user_id",
        "day",
        r.trailing_sum("goals", USER, DAY, 5).alias("goals_sum5"),
        r.trailing_sum("assists", USER, DAY, 5).alias("assists_sum5"),
        r.trailing_rate(F.col("goals") > 0, USER, DAY, 5).alias("goals_rate5"),
        r.trailing_count_if(F.col("minutes") >= 2, USER, DAY, 5).alias("busy5"),
        r.trailing_count_if(F.col("goals") == 0, USER, DAY, 5).alias("blank5"),
        r.trailing_std("minutes", USER, DAY, 5).alias("minutes_std5"),
        r.trend("points", USER, DAY, 3, 5).alias("points_trend"),
        r.entering_absence("goals", USER, DAY).alias("entering_absence"),
        r.since_last_zero("goals", USER, DAY, 8).cast("long").alias("since_zero8"),
    )


@query(
    "w04_rate_of_observed_rows",
    f"""WITH {USER_DAYS} SELECT user_id, day, sum(CASE WHEN goals > 0 THEN 1 ELSE 0 END) OVER {FIVE} / count(*) OVER {FIVE} AS rate FROM user_days
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) > 1""",
)
def rate_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir).withColumn("rate", r.trailing_rate(F.col("goals") > 0, USER, DAY, 5, "observed"))
    return days.where("rate IS NOT NULL").select("user_id", "day", "rate")


@query(
    "w13_percent_rank_ties",
    f"""WITH {PLAYER_POINTS} SELECT player_id, (rank() OVER (PARTITION BY position ORDER BY size) + (count(*) OVER (PARTITION BY position, size) - 1) / 2) / count(*) OVER (PARTITION BY position) AS pct FROM player_points""",
)
def percent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).select("player_id", r.percent_rank_ties("size", ["position"]).alias("pct"))


@query(
    "w14_sequence_and_size",
    f"WITH {USER_DAYS} SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS seq, count(*) OVER (PARTITION BY user_id) AS size FROM user_days",
)
def sequence_and_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", F.row_number().over(r.ordered(USER, DAY)).cast("long").alias("seq"), F.count("*").over(Window.partitionBy("user_id")).alias("size"))


@query(
    "w15_rest_days",
    """SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 86400000000 AS rest FROM events""",
)
def rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", r.rest_days("ts", USER, ["ts", "event_id"]).alias("rest"))


@query(
    "w16_last_row_per_group",
    f"WITH {USER_DAYS} SELECT user_id, day, points FROM user_days QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1",
)
def last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.last_per_group(user_days(spark, sf_dir).select("user_id", "day", "points"), USER, [F.desc("day")])


@query("w18_duplicate_flags", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS duplicated FROM orders")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", r.duplicate_flag(["o_custkey", "o_orderdate"]).alias("duplicated"))


@query("w19_first_of_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate")
    return r.last_per_group(orders, ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@query(
    "w20_budget_share",
    f"""WITH {PLAYER_POINTS}, weighted AS (SELECT player_id, club, exp(0.01 * (points - max(points) OVER (PARTITION BY club))) AS w FROM player_points)
    SELECT player_id, round(90 * w / sum(w) OVER (PARTITION BY club), 4) AS minutes FROM weighted""",
)
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).select("player_id", F.round(r.budget_share("points", ["club"], 90.0, 0.01), 4).alias("minutes"))


@query(
    "w21_gap_to_next",
    f"WITH {PLAYER_POINTS} SELECT player_id, points - lead(points) OVER w AS gap, coalesce(points - lead(points) OVER w < 20, false) AS ambiguous FROM player_points WINDOW w AS (PARTITION BY club ORDER BY points DESC, player_id)",
)
def gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_points(spark, sf_dir).withColumn("gap", r.gap_to_next("points", ["club"], ["player_id"]))
    return rows.select("player_id", "gap", F.coalesce(F.col("gap") < 20, F.lit(False)).alias("ambiguous"))


@query(
    "w22_resolve_duplicate_winners",
    f"""WITH {PLAYER_POINTS}, ranked AS (SELECT player_id, name, rank() OVER (PARTITION BY name ORDER BY points DESC, games DESC, price) AS place FROM player_points)
    SELECT player_id, name, place = 1 AND count(*) FILTER (place = 1) OVER (PARTITION BY name) = 1 AS approved FROM ranked""",
)
def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a name by several keys is approved; a tie approves none."""
    place = F.rank().over(Window.partitionBy("name").orderBy(F.desc("points"), F.desc("games"), "price"))
    rows = player_points(spark, sf_dir).withColumn("place", place)
    alone = F.count_if(F.col("place") == 1).over(Window.partitionBy("name")) == 1
    return rows.select("player_id", "name", ((F.col("place") == 1) & alone).alias("approved"))


@query("w23_consecutive_periods", f"WITH {USER_DAYS} SELECT user_id, day, coalesce(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) = 1, false) AS follows FROM user_days")
def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", r.follows_directly("day", USER).alias("follows"))


@query(
    "a01_mean_of_last_periods",
    f"""WITH {USER_DAYS} SELECT user_id, avg(points) AS predicted, count(*) AS observed FROM user_days
        WHERE day IN (SELECT DISTINCT day FROM user_days WHERE day < 25 ORDER BY day DESC LIMIT 5) GROUP BY user_id""",
)
def mean_of_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    return r.active_mean(days, days, USER, "day", "points", 25, 5)


@query(
    "m01_baseline_without_first_period",
    f"""WITH {USER_DAYS}, later AS (SELECT * FROM user_days QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) > 1)
    SELECT user_id, avg(points) AS predicted, count(*) AS observed FROM later WHERE day IN (SELECT DISTINCT day FROM later WHERE day < 25 ORDER BY day DESC LIMIT 5) GROUP BY user_id""",
)
def baseline_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other baseline of that name: each entity's first period is dropped beforehand."""
    later = r.numbered(user_days(spark, sf_dir), USER, DAY).where("_rn > 1")
    return r.active_mean(later, later, USER, "day", "points", 25, 5)


@query(
    "m02_weighted_baseline",
    f"""WITH {USER_DAYS}, f AS (SELECT user_id, day, avg(points) OVER three AS p3, avg(points) OVER {FIVE} AS p5, lag(points) OVER w AS p1, avg(minutes) OVER three AS m3,
            row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS latest FROM user_days
            WINDOW w AS (PARTITION BY user_id ORDER BY day), three AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT user_id, round(greatest(0, least((0.5 * p3 + 0.3 * p5 + 0.2 * p1) * least(m3 / 3, 1), 1000000)), 4) AS predicted FROM f WHERE latest = 1 AND p1 IS NOT NULL""",
)
def weighted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blend of short form, long form and the last value, scaled by recent minutes and clipped, for the latest row."""
    days = user_days(spark, sf_dir).select(
        "user_id", "day", r.trailing_mean("points", USER, DAY, 3).alias("p3"), r.trailing_mean("points", USER, DAY, 5).alias("p5"), F.lag("points").over(r.ordered(USER, DAY)).alias("p1"), r.trailing_mean("minutes", USER, DAY, 3).alias("m3")
    )
    latest = r.last_per_group(days, USER, [F.desc("day")]).where("p1 IS NOT NULL")
    blend = (0.5 * F.col("p3") + 0.3 * F.col("p5") + 0.2 * F.col("p1")) * F.least(F.col("m3") / 3, F.lit(1.0))
    return latest.select("user_id", F.round(F.greatest(F.lit(0.0), F.least(blend, F.lit(1e6))), 4).alias("predicted"))
