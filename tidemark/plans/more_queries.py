"""Further queries: projections, scalar rules, joins, governance and pre-season estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import checks as ck
from tidemark.operators import events as e
from tidemark.operators import horizon as h
from tidemark.operators import models as m
from tidemark.operators import preseason as pre
from tidemark.operators import relational as rel
from tidemark.operators import rolling as r
from tidemark.operators import summaries as s
from tidemark.plans.frames import MATCHES, PLAYER_POINTS, SIDES, USER_DAYS, matches, player_points, sides, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import resolve_aliases, sql_frame, table


@query("s02_sql_frame", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_frame(spark, "SELECT o_orderstatus AS status, count(*) AS n FROM {orders} GROUP BY 1", orders=table(spark, sf_dir, "orders"))


@query("s10_aliases", "SELECT p_partkey AS player_id, p_name AS name, CAST(NULL AS VARCHAR) AS bonus FROM part")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_aliases(table(spark, sf_dir, "part"), {"player_id": ["P_PARTKEY"], "name": ["P_Name"], "bonus": ["bps"]}, optional=["bonus"])


@query("f04_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.where_given(table(spark, sf_dir, "customer"), c_mktsegment=["MACHINERY", "HOUSEHOLD"]).select("c_custkey")


@query("f07_all_disables_a_filter", "SELECT o_orderkey FROM orders")
def all_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "all"
    return rel.where_given(table(spark, sf_dir, "orders"), o_orderstatus=None if status == "all" else status).select("o_orderkey")


@query("f09_fixed_output", "SELECT p_partkey AS player_id, CAST(NULL AS DOUBLE) AS predicted, p_brand AS club FROM part")
def fixed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("player_id"), F.lit(None).cast("double").alias("predicted"), F.col("p_brand").alias("club"))


@query("f10_drop_and_fill", f"WITH {USER_DAYS}, l AS (SELECT user_id, day, lag(points) OVER w AS last1, lag(points, 4) OVER w AS last4 FROM user_days WINDOW w AS (PARTITION BY user_id ORDER BY day)) SELECT user_id, day, last1, coalesce(last4, 0) AS last4 FROM l WHERE last1 IS NOT NULL")
def drop_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = r.ordered(["user_id"], ["day"])
    rows = user_days(spark, sf_dir).select("user_id", "day", F.lag("points").over(w).alias("last1"), F.lag("points", 4).over(w).alias("last4"))
    return rows.na.drop(subset=["last1"]).na.fill(0, ["last4"])


@query("f15_side_prefixes", f"WITH {SIDES}, f AS (SELECT team_id, avg(points) AS points, avg(scored) AS scored FROM sides GROUP BY 1) SELECT match_id, h.points AS home_points, h.scored AS home_scored, a.points AS away_points, a.scored AS away_scored FROM matches m LEFT JOIN f h ON h.team_id = home_id LEFT JOIN f a ON a.team_id = away_id")
def side_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = sides(spark, sf_dir).groupBy("team_id").agg(F.avg("points").alias("points"), F.avg("scored").alias("scored"))
    return pre.with_sides(matches(spark, sf_dir), features, "team_id", ["points", "scored"]).select("match_id", "home_points", "home_scored", "away_points", "away_scored")


@query("f16_membership_flag", "SELECT n_nationkey, n_name IN ('NATION_1', 'NATION_2') OR n_nationkey IN (3, 5) AS member FROM nation")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_name").isin("NATION_1", "NATION_2") | F.col("n_nationkey").isin(3, 5)).alias("member"))


@query("a12_fixture_profile", f"WITH {MATCHES} SELECT count(*) AS rows, count(DISTINCT home_id) AS home_id_distinct, count(DISTINCT away_id) AS away_id_distinct, CAST(sum(home_score) AS BIGINT) AS home_score_sum, count(*) FILTER (home_score = away_score) AS drawn, count(*) FILTER (home_score + away_score = 0) AS goalless FROM matches")
def fixture_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.profile(matches(spark, sf_dir), ["home_id", "away_id"], ["home_score"], {"drawn": F.col("home_score") == F.col("away_score"), "goalless": F.col("home_score") + F.col("away_score") == 0})


@query("a13_mapped_counts", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS mapped, count(*) FILTER (l.doc_id IS NULL) AS unmapped FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return rows.agg(F.count_if(F.col("labelled").isNotNull()).alias("mapped"), F.count_if(F.col("labelled").isNull()).alias("unmapped"))


@query("a30_sum_of_ids", f"WITH {PLAYER_POINTS} SELECT coalesce(CAST(sum(points) AS BIGINT), 0) AS points FROM player_points WHERE player_id IN (1, 5, 9, 10000000)")
def sum_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).where(F.col("player_id").isin(1, 5, 9, 10000000)).agg(s.zero_sum("points").alias("points"))


@query("a31_any_and_all", f"WITH {USER_DAYS} SELECT user_id, bool_or(cards > 1) AS any_card, bool_and(minutes > 0) AS always_played FROM user_days GROUP BY 1")
def any_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).groupBy("user_id").agg(F.bool_or(F.col("cards") > 1).alias("any_card"), F.bool_and(F.col("minutes") > 0).alias("always_played"))


@query("a34_discounted_utility", f"WITH {USER_DAYS} SELECT user_id, round(sum(points * CAST([1.0, 0.85, 0.7225][day - 20] AS DOUBLE)), 4) AS discounted, count(DISTINCT day) = 3 AS complete FROM user_days WHERE day BETWEEN 21 AND 23 GROUP BY 1")
def discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pre.discounted_total(user_days(spark, sf_dir), ["user_id"], "day", "points", {21: 1.0, 22: 0.85, 23: 0.7225})
    return out.withColumn("discounted", F.round("discounted", 4))


@query("a36_distinct_sorted", "SELECT DISTINCT l_returnflag AS name FROM lineitem ORDER BY 1")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("name")).distinct().orderBy("name")


@query("w17_representative_row", f"WITH {PLAYER_POINTS} SELECT name, player_id FROM player_points QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN size = 1 THEN 0 ELSE 1 END, points DESC, player_id) = 1")
def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("size") == 1, 0).otherwise(1)
    return r.last_per_group(player_points(spark, sf_dir), ["name"], [first, F.desc("points"), F.asc("player_id")]).select("name", "player_id")


@query("o04_recent_per_team", f"WITH {SIDES} SELECT team_id, match_id FROM sides QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY kickoff DESC, match_id DESC) <= 3")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.top_per_group(sides(spark, sf_dir).select("team_id", "match_id", "kickoff"), ["team_id"], [F.desc("kickoff"), F.desc("match_id")], 3).select("team_id", "match_id")


@query("o06_nulls_last", "SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS place FROM (SELECT * FROM orders ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 100)")
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of the order, numbered."""
    from pyspark.sql import Window

    order = [F.nullif("o_orderstatus", F.lit("P")).asc_nulls_last(), F.desc("o_totalprice"), F.asc("o_orderkey")]
    first = table(spark, sf_dir, "orders").orderBy(*order).limit(100)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("o09_first_of_each", f"WITH {PLAYER_POINTS} SELECT position, arg_min(player_id, (-points, player_id)) AS best, arg_min(player_id, (price, player_id)) AS cheapest FROM player_points GROUP BY 1")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).groupBy("position").agg(F.min_by("player_id", F.struct(-F.col("points"), "player_id")).alias("best"), F.min_by("player_id", F.struct("price", "player_id")).alias("cheapest"))


@query("o11_captain_and_vice", f"WITH {PLAYER_POINTS} SELECT club, player_id, row_number() OVER w = 1 AS captain, row_number() OVER w = 2 AS vice FROM player_points WINDOW w AS (PARTITION BY club ORDER BY points DESC, player_id)")
def captains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.picks import captains as pick

    return pick(player_points(spark, sf_dir), "club").select("club", "player_id", "captain", "vice")


@query("u04_difference_both_ways", "SELECT k, 'added' AS side FROM (SELECT p_name AS k FROM part WHERE p_size > 25 EXCEPT SELECT p_name FROM part WHERE p_size < 5) UNION ALL SELECT k, 'removed' FROM (SELECT p_name AS k FROM part WHERE p_size < 5 EXCEPT SELECT p_name FROM part WHERE p_size > 25)")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = rel.set_status(part.where("p_size < 5"), part.where("p_size > 25"), ["p_name"])
    return both.where("status <> 'unchanged'").select(F.col("p_name").alias("k"), F.col("status").alias("side"))


@query("u06_overlap", "SELECT o_custkey, list_has_any(list(DISTINCT o_orderstatus), ['P', 'F']) AS overlaps FROM orders GROUP BY 1")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.arrays_overlap(F.collect_set("o_orderstatus"), F.array(F.lit("P"), F.lit("F"))).alias("overlaps"))


@query("x08_raw_ids", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS id FROM orders")
def raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 7 == 0, " ").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0"))).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.raw_id(written).alias("id"))


@query("x13_text_to_bool", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM orders")
def text_to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, (" Yes", "0", "perhaps"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.to_bool(word).alias("flag"))


@query("x15_kickoff_status", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'known' WHEN 1 THEN 'invalid' ELSE 'missing' END AS status FROM orders")
def kickoff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, "soon").otherwise(" ")
    return table(spark, sf_dir, "orders").select("o_orderkey", t.kickoff(written)[1].alias("status"))


@query("x24_result_labels", f"WITH {MATCHES} SELECT match_id, CASE WHEN home_score > away_score THEN 'H' WHEN home_score = away_score THEN 'D' ELSE 'A' END AS label, home_score || '-' || away_score AS score FROM matches")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", e.result_label("home_score", "away_score").alias("label"), F.format_string("%d-%d", "home_score", "away_score").alias("score"))


@query("x30_first_present_metric", "SELECT event_id, CAST(coalesce(json_extract(props, '$.missing'), json_extract(props, '$.k')) AS BIGINT) AS metric FROM events")
def first_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.from_json("props", "map<string,long>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(values["missing"], values["k"]).alias("metric"))


@query("x31_one_hot", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F, CAST(o_orderstatus = 'X' AS INTEGER) AS o_orderstatus_X FROM orders")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.learned import one_hot as columns

    return table(spark, sf_dir, "orders").select("o_orderkey", *columns("o_orderstatus", ["F", "X"]))


@query("x32_content_digest", "SELECT page_id, sha256(html) AS digest FROM pages")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


STRENGTH = f"""{SIDES}, f AS (SELECT team_id, avg(points) AS points, avg(scored) AS scored, avg(conceded) AS conceded, avg(CASE WHEN conceded = 0 THEN 1 ELSE 0 END) AS clean, CAST(sum(scored - conceded) AS DOUBLE) AS goal_diff FROM sides WHERE season = 1996 GROUP BY 1),
    mean AS (SELECT avg(points) AS points, avg(scored) AS scored, avg(conceded) AS conceded, avg(clean) AS clean, avg(goal_diff) AS goal_diff FROM f WHERE team_id >= 20),
    eff AS (SELECT team_id, team_id < 3 AS fallback, {', '.join(f'CASE WHEN team_id < 3 THEN mean.{c} ELSE f.{c} END AS {c}' for c in ('points', 'scored', 'conceded', 'clean', 'goal_diff'))} FROM f, mean),
    pair AS (SELECT m.match_id, h.fallback OR a.fallback AS fallback, {', '.join(f'h.{c} AS home_{c}, a.{c} AS away_{c}' for c in ('points', 'scored', 'conceded', 'clean', 'goal_diff'))} FROM matches m JOIN eff h ON h.team_id = home_id JOIN eff a ON a.team_id = away_id WHERE m.season = 1997)"""
PARTS = ["points", "scored", "conceded", "clean", "goal_diff"]


def _effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = sides(spark, sf_dir).where("season = 1996").groupBy("team_id")
    f = season.agg(F.avg("points").alias("points"), F.avg("scored").alias("scored"), F.avg("conceded").alias("conceded"), F.avg(F.when(F.col("conceded") == 0, 1).otherwise(0)).alias("clean"), F.sum(F.col("scored") - F.col("conceded")).cast("double").alias("goal_diff"))
    out = pre.cohort_fallback(f, F.col("team_id") >= 20, F.col("team_id") < 3, PARTS)
    return out.select("team_id", "fallback", *(F.col(f"effective_{c}").alias(c) for c in PARTS))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pre.with_sides(matches(spark, sf_dir).where("season = 1997"), _effective(spark, sf_dir), "team_id", [*PARTS, "fallback"])
    return rows.withColumn("fallback", F.col("home_fallback") | F.col("away_fallback"))


@query("p10_effective_features", f"WITH {STRENGTH} SELECT team_id, fallback, {', '.join(f'round({c}, 6) AS {c}' for c in PARTS)} FROM eff")
def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effective(spark, sf_dir).select("team_id", "fallback", *(F.round(c, 6).alias(c) for c in PARTS))


SIGNAL = STRENGTH + """, sig AS (SELECT *, greatest(-2.2, least(2.2, 0.18 + 0.85 * (home_points - away_points) + 0.35 * (home_scored - away_scored) - 0.30 * (home_conceded - away_conceded) + 0.20 * (home_clean - away_clean) + 0.01 * (home_goal_diff - away_goal_diff))) AS s FROM pair),
    e AS (SELECT *, exp(s / 1.35) AS eh, exp(0.08 - 0.34 * abs(s)) AS ed, exp(-s / 1.35) AS ea FROM sig), q AS (SELECT *, eh / (eh + ed + ea) AS h, ed / (eh + ed + ea) AS d, ea / (eh + ed + ea) AS a FROM e),
    moved AS (SELECT match_id, s, greatest(0.001, h - CASE WHEN fallback AND h >= d AND h >= a THEN 0.04 ELSE 0 END) AS h,
              greatest(0.001, d + CASE WHEN fallback AND NOT (d > h AND d >= a) THEN 0.04 ELSE 0 END) AS d, greatest(0.001, a - CASE WHEN fallback AND a > h AND a > d THEN 0.04 ELSE 0 END) AS a FROM q)"""


@query("m16_preseason_chances", f"WITH {SIGNAL} SELECT match_id, round(s, 6) AS signal, round(h / (h + d + a), 6) AS p_home, round(d / (h + d + a), 6) AS p_draw, round(a / (h + d + a), 6) AS p_away, CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS label FROM moved")
def preseason(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pre.signal_chances(_paired(spark, sf_dir).withColumn("signal", pre.match_signal()), "signal", "fallback")
    return rows.select("match_id", *(F.round(c, 6).alias(c) for c in ("signal", "p_home", "p_draw", "p_away")), "label")


GOALS = """greatest(0.25, least(3.5, (home_scored + away_conceded) / 2 * 1.08 * (1 + greatest(-0.18, least(0.18, 0.08 * (home_points - away_points) + 0.12 * (home_clean - away_clean)))))) AS eh,
    greatest(0.20, least(3.3, (away_scored + home_conceded) / 2 * 0.92 * (1 + greatest(-0.18, least(0.18, -(0.08 * (home_points - away_points) + 0.12 * (home_clean - away_clean))))))) AS ea"""


@query("m17_expected_goals", f"WITH {STRENGTH} SELECT match_id, round(eh, 6) AS home_goals, round(ea, 6) AS away_goals FROM (SELECT match_id, {GOALS} FROM pair)")
def expected_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, away = pre.expected_goals()
    return _paired(spark, sf_dir).select("match_id", F.round(home, 6).alias("home_goals"), F.round(away, 6).alias("away_goals"))


@query(
    "m18_scoreline_preview",
    f"""WITH {SIGNAL}, said AS (SELECT match_id, CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END AS label FROM moved), g AS (SELECT match_id, {GOALS} FROM pair),
    grid AS (SELECT match_id, h, a, exp(-eh) * pow(eh, h) / factorial(CAST(h AS INTEGER)) * (exp(-ea) * pow(ea, a) / factorial(CAST(a AS INTEGER))) AS p FROM g, (SELECT unnest(range(0, 11)) AS h), (SELECT unnest(range(0, 11)) AS a)),
    o AS (SELECT match_id, sum(p) AS mass, sum(p) FILTER (h > a) AS ph, sum(p) FILTER (h = a) AS pd, sum(p) FILTER (h < a) AS pa FROM grid GROUP BY 1),
    best AS (SELECT match_id, h || '-' || a AS score FROM grid QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h, a) = 1),
    j AS (SELECT match_id, label, CASE WHEN ph >= pd AND ph >= pa THEN 'H' WHEN pd >= pa THEN 'D' ELSE 'A' END AS goal_label, score, mass FROM said JOIN o USING (match_id) JOIN best USING (match_id))
    SELECT match_id, label, goal_label, score, label <> goal_label AS disagree, round(1 - mass, 6) AS tail FROM j""",
)
def scoreline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances from the signal beside those of the score grid, the likeliest score, and whether the two labels disagree."""
    rows = _paired(spark, sf_dir).withColumn("signal", pre.match_signal())
    home, away = pre.expected_goals()
    chances = pre.signal_chances(rows, "signal", "fallback").select("match_id", "label", home.alias("lh"), away.alias("la"))
    joined = m.scored_grid(chances, "lh", "la").withColumn("goal_label", m.argmax_label({"H": F.col("p_home"), "D": F.col("p_draw"), "A": F.col("p_away")}))
    return joined.select("match_id", "label", "goal_label", "score", (F.col("label") != F.col("goal_label")).alias("disagree"), F.round("tail", 6).alias("tail"))


@query("m19_prior_proxies", f"WITH {USER_DAYS}, t AS (SELECT user_id, count(*) AS appearances, count(*) FILTER (minutes >= 3) AS starts, CAST(sum(minutes) AS BIGINT) AS minutes, CAST(sum(goals) AS BIGINT) AS goals FROM user_days GROUP BY 1) SELECT user_id, least(1.0, appearances / 30) AS appearance_chance, least(1.0, starts / 30) AS start_chance, least(90.0, minutes / 30) AS expected_minutes, least(90.0, minutes / appearances) AS minutes_if_playing, goals * 90 / minutes AS goals_per_90 FROM t")
def proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = user_days(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("appearances"), F.count_if(F.col("minutes") >= 3).alias("starts"), F.sum("minutes").alias("minutes"), F.sum("goals").alias("goals"))
    return pre.prior_proxies(totals, 30, ["goals"]).select("user_id", "appearance_chance", "start_chance", "expected_minutes", "minutes_if_playing", "goals_per_90")


POLICY = {"minutes_target": 60.0, "per_minute": 0.02, "start_target": 0.7, "start": 2.0, "fallback": 0.5, "fallback_level": 0.25, "width": 0.1, "no_width": 0.4, "value": 3.0}


@query("r13_utility", f"WITH {PLAYER_POINTS} SELECT player_id, round(points - greatest(0, 60 - games) * 0.02 - greatest(0, 0.7 - size / 50) * 2.0 - CASE WHEN size % 3 = 0 THEN 0.5 + (size % 4) * 0.25 ELSE 0 END - coalesce(CASE WHEN size % 2 = 0 THEN size * 0.1 END, 0.4) + points / greatest(price, 1) * 3.0, 3) AS utility FROM player_points")
def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, width = F.when(F.col("size") % 3 == 0, F.col("size") % 4), F.when(F.col("size") % 2 == 0, F.col("size"))
    u = pre.utility(F.col("points"), F.col("games"), F.col("size") / 50, level, width, F.col("price"), POLICY)
    return player_points(spark, sf_dir).select("player_id", F.round(u, 3).alias("utility"))


@query("r16_candidate_audit", f"WITH {PLAYER_POINTS} SELECT player_id, CASE WHEN position NOT IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY') THEN 'no_position' WHEN games = 0 THEN 'no_prediction' WHEN price > 18000 THEN 'too_expensive' END AS reason FROM player_points")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(~F.col("position").isin("SMALL", "LARGE", "PROMO", "ECONOMY"), "no_position").when(F.col("games") == 0, "no_prediction").when(F.col("price") > 18000, "too_expensive")
    return player_points(spark, sf_dir).select("player_id", reason.alias("reason"))


@query("r07_captain_shortlist", f"WITH {USER_DAYS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS n FROM user_days), f AS (SELECT user_id, avg(points) AS form, avg(minutes) AS minutes FROM l WHERE n <= 5 GROUP BY 1) SELECT user_id, form, CASE WHEN minutes >= 3 THEN 'stable' WHEN minutes >= 2 THEN 'mixed' ELSE 'thin' END AS minutes_label FROM f ORDER BY form DESC, user_id LIMIT 10")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = r.top_per_group(user_days(spark, sf_dir), ["user_id"], [F.desc("day")], 5)
    form = recent.groupBy("user_id").agg(F.avg("points").alias("form"), F.avg("minutes").alias("m")).orderBy(F.desc("form"), "user_id").limit(10)
    return form.select("user_id", "form", F.when(F.col("m") >= 3, "stable").when(F.col("m") >= 2, "mixed").otherwise("thin").alias("minutes_label"))


@query("v02_quality_report", f"WITH {MATCHES} SELECT 'matches.self_match' AS name, count(*) FILTER (home_id = away_id) = 0 AS passed, count(*) FILTER (home_id = away_id) AS value FROM matches UNION ALL SELECT 'matches.negative_score', count(*) FILTER (home_score < 0 OR away_score < 0) = 0, count(*) FILTER (home_score < 0 OR away_score < 0) FROM matches UNION ALL SELECT 'matches.duplicate_keys', count(*) = 0, count(*) FROM (SELECT match_id FROM matches GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'matches.missing_periods', 80 - count(DISTINCT period) = 0, 80 - count(DISTINCT period) FROM matches WHERE period BETWEEN 1 AND 80")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir)
    return ck.suite(ck.row_checks(rows, "matches", {"self_match": F.col("home_id") == F.col("away_id"), "negative_score": (F.col("home_score") < 0) | (F.col("away_score") < 0)}), ck.unique_keys(rows, "matches", ["match_id"]), ck.period_coverage(rows, "matches", "period", 1, 80))


@query("v12_fixture_scope", f"WITH {SIDES}, w AS (SELECT period, count(DISTINCT team_id) AS teams, count(*) AS sides FROM sides GROUP BY 1) SELECT period, teams, sides, teams = 25 AS every_team FROM w")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sides(spark, sf_dir).groupBy("period").agg(F.count_distinct("team_id").alias("teams"), F.count("*").alias("sides"))
    return w.withColumn("every_team", F.col("teams") == 25)


@query(
    "v15_chance_contract",
    f"""WITH {SIGNAL}, c AS (SELECT h / (h + d + a) AS ph, d / (h + d + a) AS pd, a / (h + d + a) AS pa FROM moved),
    n AS (SELECT count(*) FILTER (ph < 0 OR ph > 1 OR pd < 0 OR pd > 1 OR pa < 0 OR pa > 1) AS r, count(*) FILTER (abs(ph + pd + pa - 1) > 1e-5) AS s, count(*) FILTER ((ph IS NULL) <> (pd IS NULL) OR (ph IS NULL) <> (pa IS NULL)) AS p FROM c)
    SELECT 'preview.chance_range' AS name, r = 0 AS passed, r AS value FROM n UNION ALL SELECT 'preview.chance_sum', s = 0, s FROM n UNION ALL SELECT 'preview.chances_partly_null', p = 0, p FROM n""",
)
def chance_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pre-season chances keep their contract: from 0 to 1, sum one, all or none."""
    rows = pre.signal_chances(_paired(spark, sf_dir).withColumn("signal", pre.match_signal()), "signal", "fallback")
    return ck.row_checks(rows, "preview", ck.chance_rules("p_home", "p_draw", "p_away"))


@query("v16_cross_tables", "SELECT 'labels_documents.orphans' AS name, count(*) = 0 AS passed, count(*) AS value FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'labels_documents.key_differences', count(*) = 0, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cross_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels_, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id")
    return ck.suite(ck.orphans(labels_, documents, "labels_documents", "doc_id", "doc_id"), ck.same_keys(labels_, documents, "labels_documents", ["doc_id"]))


@query("m24_model_listing", "SELECT DISTINCT o_orderpriority AS model, o_orderpriority IN ('1-URGENT', '5-LOW') AS described, o_orderpriority = '1-URGENT' AS is_default FROM orders")
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names met in the data with what is known of them; a default must be the only one."""
    known = spark.createDataFrame([("1-URGENT", True), ("5-LOW", False)], "model string, is_default boolean")
    used = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model")).union(known.select("model")).distinct()
    return used.join(known, "model", "left").select("model", F.col("is_default").isNotNull().alias("described"), F.coalesce("is_default", F.lit(False)).alias("is_default"))


@query("p18_optimizer_rows", f"WITH {USER_DAYS} SELECT user_id AS player_id, day AS period, points FROM user_days WHERE day BETWEEN 1 AND 5 AND points > 0 AND cards = 0")
def optimizer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the horizon with points, of users without an error that day: those are eligible."""
    rows = user_days(spark, sf_dir).where("day BETWEEN 1 AND 5 AND points > 0 AND cards = 0")
    return rows.select(F.col("user_id").alias("player_id"), F.col("day").alias("period"), "points")


@query("p19_recent_minutes", f"WITH {USER_DAYS} SELECT user_id, string_agg(minutes, '|' ORDER BY day) AS minutes FROM user_days WHERE day BETWEEN 20 AND 24 GROUP BY 1")
def recent_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_days(spark, sf_dir).where("day BETWEEN 20 AND 24").groupBy("user_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("day", "minutes"))), lambda x: x["minutes"].cast("string"))
    return rows.agg(F.concat_ws("|", ordered).alias("minutes"))


@query("x20_risk_utility", f"WITH {PLAYER_POINTS} SELECT player_id, round(CAST(points AS DOUBLE) - 0.25 * (size % 10) - CASE WHEN games < 60 THEN 0.5 ELSE 0 END - CASE WHEN size % 3 = 0 THEN 0.3 ELSE 0 END, 6) AS utility FROM player_points")
def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = h.risk_adjusted(F.col("points"), F.lit(0.0), (F.col("size") % 10).cast("double"), F.col("games"), F.col("size") % 3 == 0)
    return player_points(spark, sf_dir).select("player_id", F.round(u, 6).alias("utility"))
