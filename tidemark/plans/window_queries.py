"""Each trailing window of its own, and single expressions, over users and their days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models as m
from tidemark.operators import rolling as r
from tidemark.operators.preseason import cohort_fallback
from tidemark.plans.frames import SIDES, USER_DAYS, sides, user_days
from tidemark.plans.registry import query

ENTITY, ORDER = ["user_id"], ["day"]
BY_USER = "(PARTITION BY user_id ORDER BY day)"


def before(width: int | str) -> str:
    return f"(PARTITION BY user_id ORDER BY day ROWS BETWEEN {width} PRECEDING AND 1 PRECEDING)"


def windowed(sql: str) -> str:
    return f"WITH {USER_DAYS} SELECT user_id, day, {sql} FROM user_days"


def with_columns(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", *(c.alias(n) for n, c in columns.items()))


@query("w01_lags", windowed(f"lag(points, 1) OVER {BY_USER} AS last1, lag(points, 2) OVER {BY_USER} AS last2"))
def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = r.ordered(ENTITY, ORDER)
    return with_columns(spark, sf_dir, last1=F.lag("points", 1).over(w), last2=F.lag("points", 2).over(w))


@query("w02_trailing_means", windowed(", ".join(f"round(avg(points) OVER {before(n)}, 6) AS mean{n}" for n in (3, 5, 8))))
def trailing_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, **{f"mean{n}": F.round(r.trailing_mean("points", ENTITY, ORDER, n), 6) for n in (3, 5, 8)})


@query("w03_trailing_sums", windowed(f"CAST(sum(points) OVER {before(5)} AS BIGINT) AS sum5"))
def trailing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, sum5=r.trailing_sum("points", ENTITY, ORDER, 5))


COUNTS = {"many": "minutes >= 3", "single": "minutes = 1", "saved": "saves > 0"}


@query("w05_trailing_counts", windowed(", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER {before(5)} AS BIGINT) AS {n}" for n, c in COUNTS.items())))
def trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, **{n: r.trailing_count_if(F.expr(c), ENTITY, ORDER, 5) for n, c in COUNTS.items()})


@query("w06_trailing_rate", windowed(f"round(CAST(sum(CASE WHEN minutes >= 2 THEN 1 ELSE 0 END) OVER {before(5)} AS DOUBLE) / least(5, row_number() OVER {BY_USER}), 6) AS rate"))
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, rate=F.round(r.trailing_rate(F.col("minutes") >= 2, ENTITY, ORDER, 5), 6))


@query("w07_trailing_deviation", windowed(f"round(stddev_samp(minutes) OVER {before(5)}, 6) AS deviation"))
def trailing_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, deviation=F.round(r.trailing_std("minutes", ENTITY, ORDER, 5), 6))


@query("w08_trend", windowed(f"round(avg(minutes) OVER {before(3)} - avg(minutes) OVER {before(5)}, 6) AS trend, round(avg(minutes) OVER {before(5)} - avg(minutes) OVER {before(3)}, 6) AS fall"))
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, trend=F.round(r.trend("minutes", ENTITY, ORDER, 3, 5), 6), fall=F.round(r.trend("minutes", ENTITY, ORDER, 5, 3), 6))


@query("w09_entering_absence", windowed(f"coalesce(lag(saves, 1) OVER {BY_USER} = 0 AND lag(saves, 2) OVER {BY_USER} > 0, false) AS entering"))
def entering_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, entering=r.entering_absence("saves", ENTITY, ORDER))


@query(
    "w10_since_last_zero",
    f"""WITH {USER_DAYS}, n AS (SELECT *, row_number() OVER {BY_USER} AS rn FROM user_days), z AS (SELECT *, max(CASE WHEN saves = 0 THEN rn END) OVER {before(8)} AS last FROM n)
    SELECT user_id, day, CAST(CASE WHEN rn > 1 THEN coalesce(rn - 1 - last, least(8, rn)) END AS BIGINT) AS since FROM z""",
)
def since_last_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = r.numbered(user_days(spark, sf_dir), ENTITY, ORDER)
    return rows.select("user_id", "day", r.since_last_zero("saves", ENTITY, ORDER, 8).cast("long").alias("since"))


@query("w11_totals_before", windowed(f"CAST(sum(points) OVER {before('UNBOUNDED')} AS BIGINT) AS points_before, CAST(sum(goals) OVER {before('UNBOUNDED')} AS BIGINT) AS goals_before"))
def totals_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, points_before=r.trailing_sum("points", ENTITY, ORDER, None), goals_before=r.trailing_sum("goals", ENTITY, ORDER, None))


STANDING = f"""{SIDES}, t AS (SELECT team_id, period, CAST(sum(points) AS BIGINT) AS points, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(conceded) AS BIGINT) AS conceded FROM sides GROUP BY 1, 2),
    c AS (SELECT team_id, period, CAST(sum(points) OVER w AS BIGINT) AS points, CAST(sum(scored) OVER w - sum(conceded) OVER w AS BIGINT) AS difference, CAST(sum(scored) OVER w AS BIGINT) AS scored FROM t WINDOW w AS (PARTITION BY team_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _before_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_period = sides(spark, sf_dir).groupBy("team_id", "period").agg(*(F.sum(c).alias(c) for c in ("points", "scored", "conceded")))
    total = lambda c: r.trailing_sum(c, ["team_id"], ["period"], None)
    return by_period.select("team_id", "period", total("points").alias("points"), (total("scored") - total("conceded")).alias("difference"), total("scored").alias("scored"))


@query(
    "w12_standings_rank",
    f"WITH {STANDING} SELECT team_id, period, row_number() OVER (PARTITION BY period ORDER BY coalesce(points, -9999) DESC, coalesce(difference, -9999) DESC, coalesce(scored, -9999) DESC, team_id) AS rank FROM c",
)
def standings_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.coalesce(c, F.lit(-9999)).desc() for c in ("points", "difference", "scored")]
    place = F.row_number().over(r.Window.partitionBy("period").orderBy(*order, "team_id"))
    return _before_period(spark, sf_dir).select("team_id", "period", place.cast("long").alias("rank"))


@query(
    "j07_opponent_context",
    f"WITH {STANDING} SELECT s.match_id, s.team_id, s.opponent_id, s.period, o.points AS opponent_points, o.difference AS opponent_difference FROM sides s LEFT JOIN c o ON o.team_id = s.opponent_id AND o.period = s.period",
)
def opponent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _before_period(spark, sf_dir).select(F.col("team_id").alias("opponent_id"), "period", F.col("points").alias("opponent_points"), F.col("difference").alias("opponent_difference"))
    return sides(spark, sf_dir).select("match_id", "team_id", "opponent_id", "period").join(context, ["opponent_id", "period"], "left")


@query(
    "j20_join_with_invariants",
    f"WITH {USER_DAYS}, p AS (SELECT user_id, sum(points) AS prior FROM user_days WHERE day <= 10 GROUP BY 1), j AS (SELECT u.user_id, p.prior FROM user_days u LEFT JOIN p USING (user_id) WHERE day > 10) SELECT (SELECT count(*) FROM user_days WHERE day > 10) AS rows_before, count(*) AS rows_after, count(prior) AS matched, round(count(prior) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM j",
)
def join_with_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    prior = days.where("day <= 10").groupBy("user_id").agg(F.sum("points").alias("prior"))
    later = days.where("day > 10")
    joined = later.join(prior, "user_id", "left").agg(F.count("*").alias("rows_after"), F.count("prior").alias("matched"))
    coverage = F.round(F.try_divide("matched", "rows_after"), 6).alias("coverage")
    return later.agg(F.count("*").alias("rows_before")).crossJoin(joined).select("rows_before", "rows_after", "matched", coverage)


@query("a08_home_away_priors", f"WITH {SIDES} SELECT team_id, season, " + ", ".join(f"CAST(coalesce(sum({c}) FILTER ({'' if s == 'home' else 'NOT '}is_home), 0) AS BIGINT) AS {s}_{c}" for s in ("home", "away") for c in ("points", "scored", "conceded")) + " FROM sides GROUP BY 1, 2")
def home_away_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"home": F.col("is_home"), "away": ~F.col("is_home")}
    return sides(spark, sf_dir).groupBy("team_id", "season").agg(*(F.sum(F.when(w, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s, w in at.items() for c in ("points", "scored", "conceded")))


@query("a27_root_mean_square", f"WITH {USER_DAYS}, e AS (SELECT day, points, lag(points) OVER {BY_USER} AS pred FROM user_days) SELECT day, count(*) AS n, round(sqrt(avg(pow(points - pred, 2))), 6) AS rmse FROM e WHERE pred IS NOT NULL GROUP BY 1")
def root_mean_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_days(spark, sf_dir).withColumn("pred", F.lag("points").over(r.ordered(ENTITY, ORDER))).where("pred IS NOT NULL")
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("points") - F.col("pred"), 2))), 6).alias("rmse"))


@query(
    "a35_cohort_mean",
    f"WITH {USER_DAYS}, u AS (SELECT user_id, CAST(sum(points) AS BIGINT) AS points FROM user_days GROUP BY 1), f AS (SELECT avg(points) AS mean FROM u WHERE user_id % 10 = 3) SELECT user_id, user_id % 10 = 4 AS fallback, round(CASE WHEN user_id % 10 = 4 THEN mean ELSE points END, 6) AS effective_points FROM u CROSS JOIN f",
)
def cohort_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = user_days(spark, sf_dir).groupBy("user_id").agg(F.sum("points").cast("double").alias("points"))
    out = cohort_fallback(users, F.col("user_id") % 10 == 3, F.col("user_id") % 10 == 4, ["points"])
    return out.select("user_id", "fallback", F.round("effective_points", 6).alias("effective_points"))


@query(
    "x18_softmax_and_label",
    f"""WITH {USER_DAYS}, s AS (SELECT user_id, day, goals / 1.0 AS a, assists / 2.0 AS b, cards / 3.0 AS c FROM user_days), e AS (SELECT user_id, day, a, b, c, exp(a) AS x, exp(b) AS y, exp(c) AS z FROM s)
    SELECT user_id, day, round(x / (x + y + z), 6) AS p_home, round(y / (x + y + z), 6) AS p_draw, round(z / (x + y + z), 6) AS p_away, CASE WHEN a >= b AND a >= c THEN 'H' WHEN b >= c THEN 'D' ELSE 'A' END AS label FROM e""",
)
def softmax_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = {"H": F.col("goals") / 1.0, "D": F.col("assists") / 2.0, "A": F.col("cards") / 3.0}
    chances = m.softmax(list(scores.values()))
    return with_columns(spark, sf_dir, **{n: F.round(c, 6) for n, c in zip(("p_home", "p_draw", "p_away"), chances)}, label=m.argmax_label(scores))


@query("x21_safe_divide", windowed("round(CAST(points AS DOUBLE) / nullif(saves, 0), 6) AS per_save"))
def safe_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns(spark, sf_dir, per_save=F.round(F.try_divide("points", "saves"), 6))


@query("x25_bands", windowed("CASE WHEN points <= 2000 THEN 'low' WHEN points <= 5000 THEN 'mid' WHEN points <= 9000 THEN 'high' WHEN points > 9000 THEN 'top' ELSE 'unclassified' END AS band"))
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.col("points")
    band = F.when(points <= 2000, "low").when(points <= 5000, "mid").when(points <= 9000, "high").when(points > 9000, "top").otherwise("unclassified")
    return with_columns(spark, sf_dir, band=band)
