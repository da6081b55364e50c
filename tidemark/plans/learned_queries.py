"""Queries that fit a model on earlier periods and score later ones. SQL expresses those of two features; the others are held against closed forms, plain versions and baselines by the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, boosting, gram
from tidemark.operators import events as e
from tidemark.operators import learned as l
from tidemark.operators import rolling as r
from tidemark.plans import feature_queries
from tidemark.plans.frames import USER_DAYS, sides, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import table

USER_FEATURES = ["points_last1", "points_mean3", "points_mean5", "points_mean8", "minutes_last1", "minutes_mean3", "minutes_mean5", "minutes_mean8"]
MATCH_FEATURES = ["home_form", "away_form", "form_diff"]


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    days = user_days(spark, sf_dir).withColumns({"points": F.col("points").cast("double"), "minutes": F.col("minutes").cast("double")})
    return l.temporal_split(r.rolling_form(days, ["user_id"], ["day"], ["points", "minutes"]), "day", 22)


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    form = e.recent_form(sides(spark, sf_dir), 5, prior=1.0)
    side = lambda home, c: F.max(F.when(F.col("is_home") == home, F.col(c)))
    rows = form.groupBy("match_id", "period").agg(side(True, "form").alias("home_form"), side(False, "form").alias("away_form"), side(True, "scored").cast("double").alias("home_goals"), side(True, "conceded").cast("double").alias("away_goals"))
    rows = rows.withColumn("form_diff", F.col("home_form") - F.col("away_form")).withColumn("label", e.result_label("home_goals", "away_goals"))
    rows = rows.cache()  # the fit goes through the early rows, the scores through the late ones
    return l.temporal_split(rows, "period", 70)


@query("m05_ridge")
def ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _users(spark, sf_dir)
    model = gram.ridge(gram.moments(train, USER_FEATURES, "points"), 10.0)
    return gram.predicted(valid, model, USER_FEATURES).select("user_id", "day", "points", F.round("prediction", 4).alias("predicted"))


@query("m06_ridge_sweep")
def ridge_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _users(spark, sf_dir)
    return l.alpha_sweep(train, valid, USER_FEATURES, "points", [0.1, 1.0, 10.0])


@query("m07_elastic_net")
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _users(spark, sf_dir)
    model = gram.elastic_net(gram.moments(train, USER_FEATURES, "points"), 0.1, 0.5)
    return gram.predicted(valid, model, USER_FEATURES).select("user_id", "day", F.round("prediction", 4).alias("predicted"))


TWO = ["points_mean3", "minutes_mean5"]
ALPHAS = [0.1, 100.0, 10_000.0]
#: Ridge of two features in closed form, for days up to 22.
FORM = f"""{USER_DAYS}, form AS (SELECT user_id, day, points, avg(points) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, avg(minutes) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b FROM user_days),
    m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(points) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, points) * count(*) AS ay, covar_pop(b, points) * count(*) AS bye FROM form WHERE day <= 22 AND a IS NOT NULL),
    w AS (SELECT alpha, ma, mb, my, (ay * (bb + alpha) - ab * bye) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, (bye * (aa + alpha) - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM m, (VALUES {", ".join(f"({a}::DOUBLE)" for a in ALPHAS)}) v(alpha))"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    train, valid = _users(spark, sf_dir)
    return train.select("user_id", "day", "points", *TWO), valid.select("user_id", "day", "points", *TWO)


@query("m05_ridge_weights", f"WITH {FORM} SELECT alpha, round(wa, 4) AS points_weight, round(wb, 2) AS minutes_weight, round(my - ma * wa - mb * wb, 1) AS constant FROM w")
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three penalties out of one pass."""
    train, _ = _two(spark, sf_dir)
    m = gram.moments(train, TWO, "points")
    found = [(a, float(x.weights[0]), float(x.weights[1]), x.intercept) for a in ALPHAS for x in [gram.ridge(m, a)]]
    rows = spark.createDataFrame(found, "alpha double, a double, b double, c double")
    return rows.select("alpha", F.round("a", 4).alias("points_weight"), F.round("b", 2).alias("minutes_weight"), F.round("c", 1).alias("constant"))


@query("m06_sweep_of_two", f"WITH {FORM} SELECT alpha, round(avg(abs(points - (my + (a - ma) * wa + (b - mb) * wb))), 3) AS mae FROM w, form WHERE day > 22 AND a IS NOT NULL GROUP BY alpha")
def sweep_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _two(spark, sf_dir)
    return l.alpha_sweep(train, valid, TWO, "points", ALPHAS).select("alpha", F.round("mae", 3).alias("mae"))


def _next_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day after each user's last one, with what the days before say."""
    days = user_days(spark, sf_dir).withColumns({"points": F.col("points").cast("double"), "minutes": F.col("minutes").cast("double")})
    frame = asof.next_period(days, ["user_id"], "day", ["saves"])
    return r.rolling_form(frame, ["user_id"], ["day"], ["points", "minutes"]).where("is_next")


@query(
    "m04_forecast_frame",
    f"""WITH {USER_DAYS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM user_days)
    SELECT user_id, max(day) + 1 AS day, max(CASE WHEN k = 1 THEN points END)::DOUBLE AS points_last1, max(CASE WHEN k = 1 THEN saves END) AS saves,
        avg(CASE WHEN k <= 3 THEN points END) AS points_mean3, avg(CASE WHEN k <= 8 THEN points END) AS points_mean8, avg(CASE WHEN k <= 5 THEN minutes END) AS minutes_mean5 FROM n GROUP BY user_id""",
)
def forecast_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_days(spark, sf_dir).select("user_id", "day", "points_last1", "saves", "points_mean3", "points_mean8", "minutes_mean5")


@query(
    "m04_next_day_forecast",
    f"""WITH {FORM}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k FROM user_days),
    f AS (SELECT user_id, max(day) + 1 AS day, avg(CASE WHEN k <= 3 THEN points END) AS a, avg(CASE WHEN k <= 5 THEN minutes END) AS b FROM n GROUP BY user_id)
    SELECT user_id, day, round(my + (a - ma) * wa + (b - mb) * wb, 3) AS predicted FROM f, w WHERE alpha = 100.0""",
)
def next_day_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge of earlier days' form, applied to the day after each user's last one."""
    train, _ = _two(spark, sf_dir)
    model = gram.ridge(gram.moments(train, TWO, "points"), 100.0)
    return gram.predicted(_next_days(spark, sf_dir), model, TWO).select("user_id", "day", F.round("prediction", 3).alias("predicted"))


@query(
    "j09_latest_before",
    """SELECT e.event_id, CAST(o.o_orderdate AS DATE) AS known_at, o.total AS known_total
    FROM (SELECT event_id, user_id, CAST(ts AS DATE) - INTERVAL 25 YEAR AS at FROM events) e
    ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS total FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.at > o.o_orderdate""",
)
def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the latest order of its user before the day of the event twenty-five years earlier."""
    probes = table(spark, sf_dir, "events").select("event_id", "user_id", F.add_months(F.to_date("ts"), -300).alias("at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("at"), F.to_date("o_orderdate").alias("known_at"), F.round(F.col("o_totalprice") * 100).cast("long").alias("known_total"))
    return asof.attach(probes, orders, ["user_id"], "at", ["known_at", "known_total"]).select("event_id", "known_at", "known_total")


@query("m08_boosted_trees")
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _users(spark, sf_dir)
    return l.boosted(train, USER_FEATURES, "points").transform(valid).select("user_id", "day", F.round("prediction", 4).alias("predicted"))


@query("m10_outcome_logistic")
def outcome_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _matches(spark, sf_dir)
    few = l.collapsed(train, [*MATCH_FEATURES, "label"]).cache()  # forms of five matches take few values
    return l.outcome_chances(l.outcome_logistic(few, MATCH_FEATURES, "label", weight="weight"), valid, MATCH_FEATURES).select("match_id", "pred", *(F.round(c, 4).alias(c) for c in ("p_home", "p_draw", "p_away")))


@query("m11_outcome_logistic_v2")
def outcome_logistic_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three outcomes from the full match features: standing, recent strength, rest, difficulty and last meetings of both sides; what is missing counts as 0."""
    rows = feature_queries.match_features(spark, sf_dir)
    features = [c for c in (*feature_queries.WHOLE, *feature_queries.REAL) if c not in ("home_score", "away_score", "home_goals", "away_goals")]
    rows = rows.select("match_id", "period", "label", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    train, valid = l.split_collapsed(rows, ["match_id"], "period", 70, ["label", *features])  # the fit goes through the early rows some dozens of times
    return l.outcome_chances(l.outcome_logistic(train, features, "label", rounds=50, repeats="weight"), valid, features).select("match_id", "pred", *(F.round(c, 4).alias(c) for c in ("p_home", "p_draw", "p_away")))


def _boosted(spark: SparkSession, sf_dir: str, growth: boosting.Growth, rounds: int, bins: int = 32) -> DataFrame:
    train, valid = _matches(spark, sf_dir)
    model = boosting.fit(train, MATCH_FEATURES, "label", l.OUTCOMES, rounds=rounds, growth=growth, bins=bins)
    names = dict(zip(l.OUTCOMES, ("p_home", "p_draw", "p_away")))
    return boosting.scored(valid, model).select("match_id", "pred", *(F.round(f"p_{k}", 6).alias(n) for k, n in names.items()))


@query("m12_outcome_boosted")
def outcome_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three outcomes boosted together, small trees."""
    return _boosted(spark, sf_dir, boosting.Growth(rate=0.1, leaves=4), 6)


@query("m13_outcome_leafwise")
def outcome_leafwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three outcomes boosted together, trees that grow where most is gained, with a penalty on leaf values: 200 rounds of the original's parameters."""
    return _boosted(spark, sf_dir, boosting.Growth(rate=0.03, leaves=15, rows=10, penalty=1.0), 200, bins=255)


@query("m14_goals")
def goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, valid = _matches(spark, sf_dir)
    home, away = l.goal_models(train, MATCH_FEATURES, "home_goals", "away_goals")
    scored = valid.select("match_id", *MATCH_FEATURES)
    for model, name in ((home, "home_expected"), (away, "away_expected")):
        scored = model.transform(scored).withColumn(name, F.round("prediction", 4)).drop("features", "prediction")
    return scored.select("match_id", "home_expected", "away_expected")
