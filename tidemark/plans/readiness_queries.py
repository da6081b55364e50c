"""Queries of import and readiness checks, identities of clubs, priors with optional columns, and legality issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import checks as ck
from tidemark.operators import identity as idt
from tidemark.operators import preseason as pre
from tidemark.operators import rules as ru
from tidemark.operators import summaries as sm
from tidemark.plans.frames import MATCHES, PLAYER_POINTS, USER_DAYS, matches, player_points, user_days
from tidemark.plans.game_queries import ROLES, _pool
from tidemark.plans.more_queries import PARTS, STRENGTH, _effective
from tidemark.plans.registry import query
from tidemark.sources import readers as rd
from tidemark.sources.readers import table


@query("u02_concatenated", "SELECT 'customer' AS kind, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return one.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind")))


@query(
    "a07_priors_with_optional_columns",
    f"""WITH {USER_DAYS}, t AS (SELECT user_id, CAST(sum(minutes) AS BIGINT) AS minutes, count(*) FILTER (minutes > 0) AS appearances, CAST(sum(goals) AS BIGINT) AS goals FROM user_days GROUP BY 1)
    SELECT user_id, minutes, goals, goals * 90 / nullif(minutes, 0) AS goals_per_90, goals / nullif(appearances, 0) AS goals_per_appearance, CAST(NULL AS BIGINT) AS tackles, CAST(NULL AS DOUBLE) AS tackles_per_90, CAST(NULL AS DOUBLE) AS tackles_per_appearance FROM t""",
)
def optional_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors of a measure that the table has and of one that it lacks, which stays null."""
    days, wanted = user_days(spark, sf_dir), ("goals", "tackles")
    out = sm.priors(days, ["user_id"], "minutes", [c for c in wanted if c in days.columns], enough=40)
    out = rd.null_filled(out, {name: kind for c in wanted for name, kind in ((c, "long"), (f"{c}_per_90", "double"), (f"{c}_per_appearance", "double"))})
    return out.select("user_id", "minutes", "goals", "goals_per_90", "goals_per_appearance", "tackles", "tackles_per_90", "tackles_per_appearance")


@query(
    "a25_error_by_period",
    f"""WITH {USER_DAYS}, p AS (SELECT user_id, day, points, avg(points) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS predicted FROM user_days)
    SELECT day, count(*) AS n, round(avg(abs(points - predicted)), 6) AS mae FROM p WHERE predicted IS NOT NULL GROUP BY 1""",
)
def error_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predictions each period has and how far off they are on average."""
    from tidemark.operators.rolling import trailing_mean

    rows = user_days(spark, sf_dir).withColumn("predicted", trailing_mean("points", ["user_id"], ["day"], 5)).where("predicted IS NOT NULL")
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("points") - F.col("predicted"))), 6).alias("mae"))


@query("o12_metric_ranking", "SELECT p_brand, round(avg(p_retailprice), 4) AS metric, row_number() OVER (ORDER BY round(avg(p_retailprice), 4) DESC, p_brand) AS place FROM part GROUP BY 1 QUALIFY place <= 10")
def metric_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten brands of the highest mean price: a report of ten rows."""
    from pyspark.sql import Window

    means = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("metric")).orderBy(F.desc("metric"), "p_brand").limit(10)
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("metric"), "p_brand")).cast("long"))


@query(
    "s08_flattened_fixtures",
    f"WITH {MATCHES} SELECT match_id AS id, period AS event, home_id, away_id, h.n_name AS home_name, a.n_name AS away_name FROM matches LEFT JOIN nation h ON h.n_nationkey = home_id LEFT JOIN nation a ON a.n_nationkey = away_id WHERE period BETWEEN 10 AND 20",
)
def flattened_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each period, its fixtures as an array of structs, taken apart again."""
    rows = matches(spark, sf_dir)
    documents = rows.groupBy("period").agg(F.collect_list(F.struct(F.col("match_id").alias("id"), F.col("period").alias("event"), F.col("home_id").alias("team_h"), F.col("away_id").alias("team_a"))).alias("fixtures"))
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return rd.flatten_fixtures(documents, teams, 10, 20).select("id", "event", "home_id", "away_id", "home_name", "away_name")


@query(
    "p08_team_priors",
    f"""WITH {MATCHES}, s AS (SELECT home_id AS team_id, home_score AS scored, away_score AS conceded FROM matches WHERE season = 1996 UNION ALL SELECT away_id, away_score, home_score FROM matches WHERE season = 1996)
    SELECT team_id, count(*) AS played, round(avg(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END), 6) AS points_per_match, round(avg(scored), 6) AS scored_per_match, CAST(NULL AS VARCHAR) AS expected_goals FROM s GROUP BY 1""",
)
def team_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors out of a season summary whose columns have other names; what the summary lacks is null."""
    from tidemark.operators.events import season_table, two_sided

    summary = season_table(two_sided(matches(spark, sf_dir).where("season = 1996"))).select(F.col("team_id").alias("Team"), F.col("played").alias("MP"), F.col("points").alias("Pts"), F.col("scored").alias("GF"))
    named = rd.resolve_aliases(summary, {"team_id": ["team"], "played": ["mp", "matches"], "points": ["pts"], "scored": ["gf"], "expected_goals": ["xg"]}, optional=["expected_goals"])
    return named.select("team_id", "played", F.round(F.col("points") / F.col("played"), 6).alias("points_per_match"), F.round(F.col("scored") / F.col("played"), 6).alias("scored_per_match"), "expected_goals")


@query("p09_preseason_match_features", f"WITH {STRENGTH} SELECT match_id, {', '.join(f'round(home_{c}, 6) AS home_{c}, round(away_{c}, 6) AS away_{c}' for c in PARTS)} FROM pair")
def preseason_match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priors of both sides beside each match, prefixed by side."""
    rows = pre.with_sides(matches(spark, sf_dir).where("season = 1997"), _effective(spark, sf_dir), "team_id", PARTS)
    return rows.where("home_points IS NOT NULL AND away_points IS NOT NULL").select("match_id", *(F.round(f"{side}_{c}", 6).alias(f"{side}_{c}") for c in PARTS for side in ("home", "away")))


@query(
    "e09_legality_issues",
    f"""WITH {PLAYER_POINTS}, m AS (SELECT player_id % 130 AS squad_id, player_id, {ROLES} AS position, club, price // 200 AS price FROM player_points WHERE position IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY')),
    s AS (SELECT squad_id, count(*) AS n, CAST(sum(price) AS BIGINT) AS price, count(*) FILTER (position = 'GKP') AS g, count(*) FILTER (position = 'DEF') AS d, count(*) FILTER (position = 'MID') AS mi, count(*) FILTER (position = 'FWD') AS f FROM m GROUP BY 1)
    SELECT squad_id, 'squad_size' AS code, 'squad' AS scope, '15' AS expected, CAST(n AS VARCHAR) AS actual FROM s WHERE n <> 15
    UNION ALL SELECT squad_id, 'budget', 'squad', '1000', CAST(price AS VARCHAR) FROM s WHERE price > 1000
    UNION ALL SELECT squad_id, 'position_quota', 'GKP', '2', CAST(g AS VARCHAR) FROM s WHERE g <> 2 UNION ALL SELECT squad_id, 'position_quota', 'DEF', '5', CAST(d AS VARCHAR) FROM s WHERE d <> 5
    UNION ALL SELECT squad_id, 'position_quota', 'MID', '5', CAST(mi AS VARCHAR) FROM s WHERE mi <> 5 UNION ALL SELECT squad_id, 'position_quota', 'FWD', '3', CAST(f AS VARCHAR) FROM s WHERE f <> 3
    UNION ALL SELECT squad_id, 'club_limit', club, '3', CAST(count(*) AS VARCHAR) FROM m GROUP BY squad_id, club HAVING count(*) > 3""",
)
def legality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.legality_issues(_pool(spark, sf_dir).withColumn("squad_id", F.col("player_id") % 130))


@query(
    "v05_semantic_checks",
    f"""WITH {MATCHES}, {USER_DAYS} SELECT 'matches.self_match' AS name, count(*) FILTER (home_id = away_id) = 0 AS passed, count(*) FILTER (home_id = away_id) AS value FROM matches
    UNION ALL SELECT 'matches.period_not_positive', count(*) FILTER (period <= 12) = 0, count(*) FILTER (period <= 12) FROM matches
    UNION ALL SELECT 'matches.duplicate_keys', count(*) = 0, count(*) FROM (SELECT 1 FROM matches GROUP BY season, period, home_id, away_id HAVING count(*) > 1)
    UNION ALL SELECT 'days.negative_minutes', count(*) FILTER (minutes < 0) = 0, count(*) FILTER (minutes < 0) FROM user_days
    UNION ALL SELECT 'days.duplicate_keys', count(*) = 0, count(*) FROM (SELECT 1 FROM user_days GROUP BY user_id, day HAVING count(*) > 1)""",
)
def semantic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table of matches and one of player weeks must not hold; the first year counts as before the first period here."""
    m, days = matches(spark, sf_dir), user_days(spark, sf_dir)
    return ck.suite(
        ck.row_checks(m, "matches", {"self_match": F.col("home_id") == F.col("away_id"), "period_not_positive": F.col("period") <= 12}), ck.unique_keys(m, "matches", ["season", "period", "home_id", "away_id"]),
        ck.row_checks(days, "days", {"negative_minutes": F.col("minutes") < 0}), ck.unique_keys(days, "days", ["user_id", "day"]),
    )


@query(
    "v06_readiness",
    """SELECT 'customers.rows' AS name, count(*) >= 100 AS passed, count(*) AS value FROM customer WHERE c_nationkey = 3
    UNION ALL SELECT 'priors.duplicate_keys', count(*) = 0, count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 20)
    UNION ALL SELECT 'accepted.orphans', count(*) = 0, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
    UNION ALL SELECT 'orders.coverage', share >= 0.9, CAST(floor(share * 1000) AS BIGINT) FROM (SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) / count(*) AS share FROM customer)""",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in a scope, repeated keys, accepted ids that are no known ids, and the share of keys that is covered."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    often = orders.groupBy("o_custkey").count().where("count > 20").select("o_custkey")
    return ck.suite(
        ck.count_at_least(customers.where("c_nationkey = 3"), "customers", 100), ck.unique_keys(often.unionByName(often), "priors", ["o_custkey"]),
        ck.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "accepted", "doc_id", "doc_id"), ck.coverage(orders, customers, "orders", "o_custkey", "c_custkey", 0.9),
    )


@query(
    "v09_team_identity",
    """WITH p AS (SELECT a.n_nationkey AS l, b.n_nationkey AS r, a.n_regionkey = b.n_regionkey AS short, a.n_name = b.n_name AS exact, CASE WHEN a.n_name = b.n_name THEN 1.0 ELSE 0.4 END AS name_score FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey OR a.n_nationkey % 5 = b.n_nationkey % 5)
    SELECT l, r, round(CASE WHEN short AND exact THEN 1.0 WHEN short THEN greatest(name_score * 0.35 + 0.65, 0.96) WHEN exact THEN greatest(name_score * 0.35, 0.94) ELSE name_score * 0.35 END, 6) AS score, CASE WHEN short AND exact THEN 'exact_short_name_and_exact_name' WHEN short THEN 'exact_short_name' WHEN exact THEN 'exact_name' ELSE 'similar_name' END AS kind, short OR exact AS safe FROM p""",
)
def team_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as clubs of two seasons, their region as short name; candidates share the region or a key."""
    n = table(spark, sf_dir, "nation")
    keys = F.array(F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("k"), F.col("n_nationkey") % 5))
    side = lambda s: n.select(F.col("n_nationkey").alias(s), F.col("n_regionkey").alias(f"{s}_short"), F.col("n_name").alias(f"{s}_name"), F.explode(keys).alias("_key"))
    pairs = side("l").join(side("r"), "_key").drop("_key").distinct()
    exact = t.normal_name("l_name") == t.normal_name("r_name")
    score, kind, safe = idt.team_score(F.when(exact, 1.0).otherwise(0.4), F.col("l_short") == F.col("r_short"), exact)
    return pairs.select("l", "r", F.round(score, 6).alias("score"), kind.alias("kind"), safe.alias("safe"))


@query("v11_accepted_mappings", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'")
def accepted_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the accepted statuses that point to something."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"))
    return idt.accepted(rows, ["1-URGENT", "2-HIGH"], "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "v22_output_contracts",
    f"""WITH {PLAYER_POINTS}, p AS (SELECT price / 1000.0 AS price, CASE WHEN size % 8 = 0 THEN price // 100 + 2 ELSE round(price / 100.0) END AS cost, CASE WHEN size % 3 > 0 THEN 1 END AS a, CASE WHEN size % 3 > 0 OR size % 5 = 0 THEN 1 END AS b, games - 1 AS low, games + CASE WHEN size = 4 THEN 3 ELSE 0 END AS mid, games + 1 AS high FROM player_points)
    SELECT 'out.price_and_cost' AS name, count(*) FILTER (abs(price * 10 - cost) > 0.51) = 0 AS passed, count(*) FILTER (abs(price * 10 - cost) > 0.51) AS value FROM p
    UNION ALL SELECT 'out.triple_partly_null', count(*) FILTER (a IS NULL AND b IS NOT NULL) = 0, count(*) FILTER (a IS NULL AND b IS NOT NULL) FROM p
    UNION ALL SELECT 'out.outside_bounds', count(*) FILTER (mid < low OR mid > high) = 0, count(*) FILTER (mid < low OR mid > high) FROM p""",
)
def output_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size")
    rows = player_points(spark, sf_dir).select(
        (F.col("price") / 1000.0).alias("price"), F.when(size % 8 == 0, F.floor(F.col("price") / 100) + 2).otherwise(F.round(F.col("price") / 100.0)).alias("cost"), F.when(size % 3 > 0, 1).alias("a"), F.when((size % 3 > 0) | (size % 5 == 0), 1).alias("b"), F.when(size % 3 > 0, 1).alias("c"),
        (F.col("games") - 1).alias("low"), (F.col("games") + F.when(size == 4, 3).otherwise(0)).alias("mid"), (F.col("games") + 1).alias("high"),
    )
    return ck.row_checks(rows, "out", ck.output_rules("price", "cost", ["a", "b", "c"], "low", "mid", "high"))
