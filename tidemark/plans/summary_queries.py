"""Queries of summaries, priors, evaluation and probability models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import events as e
from tidemark.operators import models as m
from tidemark.operators import rolling as r
from tidemark.operators import summaries as s
from tidemark.plans.event_queries import FORM
from tidemark.plans.frames import PLAYER_POINTS, SIDES, USER_DAYS, player_points, sides, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import table

STATUS = ["F", "O", "P"]


@query(
    "a04_season_summary",
    f"""WITH {USER_DAYS} SELECT user_id, count(*) AS rows, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(points) AS BIGINT) AS points, min(saves) AS value_low, max(saves) AS value_high,
            arg_max(saves, day) AS value_last, count(*) FILTER (minutes > 0) AS appearances, count(*) FILTER (minutes >= 3) AS long_appearances FROM user_days GROUP BY 1""",
)
def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.season_summary(user_days(spark, sf_dir), ["user_id"], "day", "minutes", "points", "saves", 3)


@query(
    "a06_priors",
    f"""WITH {USER_DAYS}, t AS (SELECT user_id, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) FILTER (minutes > 0) AS appearances, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists FROM user_days WHERE day <= 20 GROUP BY 1)
    SELECT *, goals * 90 / nullif(minutes, 0) AS goals_per_90, assists * 90 / nullif(minutes, 0) AS assists_per_90, goals / nullif(appearances, 0) AS goals_per_appearance, assists / nullif(appearances, 0) AS assists_per_appearance, minutes >= 40 AS reliable FROM t""",
)
def priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.priors(user_days(spark, sf_dir).where("day <= 20"), ["user_id"], "minutes", ["goals", "assists"], enough=40)


@query("a09_duplicate_groups", "SELECT count(*) AS groups FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.relational import duplicate_keys

    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("groups"))


@query("a10_coverage", f"WITH {USER_DAYS} SELECT user_id, min(day) AS first, max(day) AS last, count(DISTINCT day) AS periods, max(day) - min(day) + 1 = count(DISTINCT day) AS complete FROM user_days GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.coverage(user_days(spark, sf_dir), ["user_id"], "day")


@query("a11_profile", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS o_custkey_distinct, count(DISTINCT o_orderstatus) AS o_orderstatus_distinct, CAST(sum(o_custkey) AS BIGINT) AS o_custkey_sum, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.profile(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], ["o_custkey"], {"finished": F.col("o_orderstatus") == "F"})


@query(
    "a16_horizon_aggregate",
    f"""WITH {USER_DAYS} SELECT user_id, CAST(sum(points) AS BIGINT) AS total, avg(points) AS mean, max(points) - min(points) AS spread, count(*) AS days, string_agg(day, '|' ORDER BY day) AS active,
            CASE WHEN count(*) >= 5 THEN 'full' WHEN count(*) >= 3 THEN 'most' ELSE 'few' END AS label FROM user_days WHERE day BETWEEN 21 AND 25 GROUP BY 1""",
)
def horizon_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.count("*") >= 5, "full").when(F.count("*") >= 3, "most").otherwise("few")
    rows = user_days(spark, sf_dir).where("day BETWEEN 21 AND 25").groupBy("user_id")
    return rows.agg(F.sum("points").alias("total"), F.avg("points").alias("mean"), (F.max("points") - F.min("points")).alias("spread"), F.count("*").alias("days"), F.concat_ws("|", F.array_sort(F.collect_list("day")).cast("array<string>")).alias("active"), label.alias("label"))


@query(
    "a17_minutes_stability",
    f"WITH {USER_DAYS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM user_days) SELECT user_id, avg(minutes) AS mean, count(*) FILTER (minutes >= 2) AS long_days, CASE WHEN avg(minutes) >= 3 THEN 'stable' WHEN avg(minutes) >= 2 THEN 'mixed' ELSE 'thin' END AS label FROM l WHERE n <= 5 GROUP BY 1",
)
def minutes_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = r.top_per_group(user_days(spark, sf_dir), ["user_id"], [F.desc("day")], 5)
    label = F.when(F.avg("minutes") >= 3, "stable").when(F.avg("minutes") >= 2, "mixed").otherwise("thin")
    return recent.groupBy("user_id").agg(F.avg("minutes").alias("mean"), F.count_if(F.col("minutes") >= 2).alias("long_days"), label.alias("label"))


@query(
    "a18_quantile_bands",
    f"""WITH {PLAYER_POINTS}, q AS (SELECT position, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.5) AS q50, quantile_cont(price, 0.75) AS q75 FROM player_points GROUP BY 1)
    SELECT player_id, q25, q50, q75, CASE WHEN price <= q25 THEN 'low' WHEN price <= q50 THEN 'mid' WHEN price <= q75 THEN 'high' ELSE 'top' END AS band FROM player_points JOIN q USING (position)""",
)
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.quantile_bands(player_points(spark, sf_dir), ["position"], "price").select("player_id", "q25", "q50", "q75", "band")


@query("a19_group_medians", f"WITH {PLAYER_POINTS} SELECT position, club, count(*) AS n, median(points) AS points_median, median(price) AS price_median FROM player_points GROUP BY 1, 2")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.group_medians(player_points(spark, sf_dir), ["position", "club"], ["points", "price"])


@query("a20_distribution", f"WITH {PLAYER_POINTS} SELECT position, count(points) AS n, min(points) AS low, median(points) AS median, avg(points) AS mean, max(points) AS high FROM player_points GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.distribution(player_points(spark, sf_dir), ["position"], "points")


@query("a21_value_counts", "SELECT coalesce(nullif(event_type, 'view'), 'null') AS value, count(*) AS n FROM events GROUP BY 1")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.value_counts(table(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("kind")), "kind")


@query("a22_cross_table", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def cross_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.cross_table(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", STATUS)


@query("a23_flag_counts", "SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS flag FROM part) GROUP BY 1")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.flag_counts(table(spark, sf_dir, "part"), F.split("p_name", " "))


PREDICTED = f"""{USER_DAYS}, pred AS (SELECT user_id, day, points AS actual, avg(points) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p3,
        avg(points) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p5, CAST(lag(points) OVER (PARTITION BY user_id ORDER BY day) AS DOUBLE) AS p1 FROM user_days)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda w: r.trailing_mean("points", ["user_id"], ["day"], w)
    last = F.lag("points").over(r.ordered(["user_id"], ["day"])).cast("double")
    return user_days(spark, sf_dir).select("user_id", "day", F.col("points").alias("actual"), mean(3).alias("p3"), mean(5).alias("p5"), last.alias("p1"))


@query(
    "a24_mae_by_period_and_overall",
    f"WITH {PREDICTED} SELECT day, count(*) AS n, round(avg(abs(actual - p5)), 3) AS mae, round(sqrt(avg((actual - p5) * (actual - p5))), 3) AS rmse FROM pred WHERE p5 IS NOT NULL AND day > 20 GROUP BY ROLLUP (day)",
)
def mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.absolute_error(_predicted(spark, sf_dir).where("p5 IS NOT NULL AND day > 20"), "actual", "p5", ["day"])
    return out.withColumns({c: F.round(c, 3) for c in ("mae", "rmse")})


@query(
    "a28_leaderboard",
    f"WITH {PREDICTED} SELECT model, count(p) AS n, round(avg(abs(actual - p)), 3) AS mae FROM (SELECT actual, 'p1' AS model, p1 AS p FROM pred WHERE day > 20 UNION ALL SELECT actual, 'p3', p3 FROM pred WHERE day > 20 UNION ALL SELECT actual, 'p5', p5 FROM pred WHERE day > 20) GROUP BY 1",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.leaderboard(_predicted(spark, sf_dir).where("day > 20"), "actual", ["p1", "p3", "p5"]).withColumn("mae", F.round("mae", 3))


BASELINE = f"""{SIDES}, form AS (SELECT match_id, is_home, coalesce({FORM}, 1.0) AS form FROM sides),
    paired AS (SELECT m.match_id, h.form - a.form AS d, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS label
               FROM matches m JOIN form h ON h.match_id = m.match_id AND h.is_home JOIN form a ON a.match_id = m.match_id AND NOT a.is_home),
    weights AS (SELECT *, exp(d - abs(d)) AS wh, exp(-2 * abs(d)) AS wd, exp(-d - abs(d)) AS wa FROM paired),
    base AS (SELECT match_id, label, wh / (wh + wd + wa) AS p_home, wd / (wh + wd + wa) AS p_draw, wa / (wh + wd + wa) AS p_away, CASE WHEN d > 0.25 THEN 'H' WHEN d < -0.25 THEN 'A' ELSE 'D' END AS pred FROM weights)"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = e.recent_form(sides(spark, sf_dir), 5, prior=1.0)
    side = lambda home, c: F.max(F.when(F.col("is_home") == home, F.col(c)))
    rows = form.groupBy("match_id").agg(side(True, "form").alias("home_form"), side(False, "form").alias("away_form"), side(True, "scored").alias("h"), side(True, "conceded").alias("a"))
    return m.match_baseline(rows.withColumn("label", e.result_label("h", "a")), "home_form", "away_form", 0.25)


@query("m03_match_baseline", f"WITH {BASELINE} SELECT match_id, pred, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away FROM base")
def match_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir).select("match_id", "pred", *(F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")))


@query(
    "a26_classification",
    f"WITH {BASELINE} SELECT count(*) AS n, round(avg(CASE WHEN pred = label THEN 1 ELSE 0 END), 6) AS accuracy, round(-avg(ln(greatest(CASE label WHEN 'H' THEN p_home WHEN 'D' THEN p_draw ELSE p_away END, 1e-15))), 6) AS log_loss FROM base",
)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.classification(_baseline(spark, sf_dir), "label", "pred", {"H": "p_home", "D": "p_draw", "A": "p_away"})
    return out.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


@query("a26_confusion", f"WITH {BASELINE} SELECT label, count(*) FILTER (pred = 'H') AS H, count(*) FILTER (pred = 'D') AS D, count(*) FILTER (pred = 'A') AS A FROM base GROUP BY 1")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(_baseline(spark, sf_dir), "label", "pred", ["H", "D", "A"])


RATES = f"""{SIDES}, rate AS (SELECT team_id, avg(scored) AS mean FROM sides GROUP BY 1), pairs AS (SELECT h.team_id AS home, a.team_id AS away, h.mean AS lh, a.mean AS la FROM rate h JOIN rate a ON a.team_id = (h.team_id + 1) % 25),
    grid AS (SELECT home, away, h, a, exp(-lh) * pow(lh, h) / factorial(CAST(h AS INTEGER)) * (exp(-la) * pow(la, a) / factorial(CAST(a AS INTEGER))) AS p FROM pairs, (SELECT unnest(range(11)) AS h), (SELECT unnest(range(11)) AS a))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = sides(spark, sf_dir).groupBy("team_id").agg(F.avg("scored").alias("mean"))
    home = rate.select(F.col("team_id").alias("home"), F.col("mean").alias("lh"), ((F.col("team_id") + 1) % 25).alias("away"))
    return m.score_grid(home.join(rate.select(F.col("team_id").alias("away"), F.col("mean").alias("la")), "away"), ["home", "away"], "lh", "la")


@query("x19_poisson_outcomes", f"WITH {RATES} SELECT home, away, round(sum(p) FILTER (h > a) / sum(p), 6) AS p_home, round(sum(p) FILTER (h = a) / sum(p), 6) AS p_draw, round(sum(p) FILTER (h < a) / sum(p), 6) AS p_away, round(1 - sum(p), 6) + 0.0 AS tail FROM grid GROUP BY 1, 2")
def poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = m.outcome_chances(_grid(spark, sf_dir), ["home", "away"])
    return out.select("home", "away", *(F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")), (F.round("tail", 6) + 0.0).alias("tail"))


@query("x19_top_scores", f"WITH {RATES} SELECT home, away, row_number() OVER (PARTITION BY home, away ORDER BY round(p, 9) DESC, h, a) AS place, h || '-' || a AS score, round(p, 6) AS p FROM grid QUALIFY place <= 5")
def top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir).withColumn("p", F.round("p", 9))
    return m.top_scores(grid, ["home", "away"]).select("home", "away", F.col("place").cast("long").alias("place"), "score", F.round("p", 6).alias("p"))


@query("x26_sample_tiers", f"WITH {PLAYER_POINTS} SELECT player_id, CASE WHEN points <= 0 THEN 'zero_sample' WHEN points < 180 OR games < 3 THEN 'very_low_sample' WHEN points < 450 OR games < 5 THEN 'low_sample' WHEN points < 900 THEN 'moderate_sample' WHEN points < 1800 THEN 'reliable_sample' ELSE 'high_sample' END AS tier FROM player_points")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).select("player_id", m.tier(F.col("points"), F.col("games")).alias("tier"))


@query("x27_risk_flags", f"WITH {PLAYER_POINTS} SELECT player_id, concat_ws('|', CASE WHEN games < 25 THEN 'few_games' END, CASE WHEN price > 18000 THEN 'expensive' END, CASE WHEN points < 600 THEN 'low_points' END) AS flags FROM player_points")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = m.risk_flags({"few_games": F.col("games") < 25, "expensive": F.col("price") > 18000, "low_points": F.col("points") < 600})
    return player_points(spark, sf_dir).select("player_id", F.concat_ws("|", flags).alias("flags"))


@query("m21_availability_ceiling", f"WITH {PLAYER_POINTS}, s AS (SELECT player_id, (size % 5) / 4 AS chance, 0.6 AS p, 90.0 AS minutes FROM player_points) SELECT player_id, round(least(p, chance), 6) AS appearance, round(minutes * CASE WHEN chance < p THEN chance / p ELSE 1 END, 6) AS minutes FROM s")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    chance = (F.col("size") % 5) / 4
    appearance, minutes = m.availability_ceiling(chance, F.lit(0.6), F.lit(90.0))
    return player_points(spark, sf_dir).select("player_id", F.round(appearance, 6).alias("appearance"), F.round(minutes, 6).alias("minutes"))


@query("m22_prior_weight", f"WITH {USER_DAYS} SELECT DISTINCT day, CASE WHEN day <= 1 THEN 1.0 WHEN day > 5 THEN 0.0 ELSE (6 - day) / 5 END AS weight FROM user_days")
def prior_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("day", m.prior_weight(F.col("day")).alias("weight")).distinct()


@query(
    "a29_collapse_periods",
    """SELECT l_orderkey, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS l_returnflag, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1""",
)
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as one row. Lines have no key to order by, so first and last are left out."""
    lines = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return s.collapse_periods(lines, ["l_orderkey"], ["quantity"], ["l_returnflag"], ["l_linestatus"], "l_shipdate").drop("quantity_first", "quantity_last")
