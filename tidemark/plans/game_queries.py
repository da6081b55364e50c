"""Queries of horizons, rules, picks, checks, identity and text over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import checks as ck
from tidemark.operators import horizon as h
from tidemark.operators import identity as idt
from tidemark.operators import picks as p
from tidemark.operators import rules as ru
from tidemark.plans.frames import MATCHES, PLAYER_POINTS, SIDES, USER_DAYS, matches, player_points, sides, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import table

FIRST, LAST = 30, 34


@query(
    "p12_fixture_flags",
    f"WITH {MATCHES} SELECT match_id, count(*) OVER (PARTITION BY match_id) > 1 AS repeated_id, count(*) OVER (PARTITION BY season, home_id, away_id, period) > 1 AS repeated_pair, home_id = away_id AS self_match, kickoff IS NULL AS no_kickoff, NOT coalesce(period BETWEEN {FIRST} AND {LAST}, false) AS out_of_scope, period BETWEEN {FIRST} AND {LAST} AS valid FROM matches",
)
def fixture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.fixture_flags(matches(spark, sf_dir), FIRST, LAST).select("match_id", "repeated_id", "repeated_pair", "self_match", "no_kickoff", "out_of_scope", "valid")


@query(
    "p13_side_sequence",
    f"WITH {SIDES} SELECT match_id, team_id, row_number() OVER (PARTITION BY team_id, period ORDER BY kickoff, match_id) AS sequence, count(*) OVER (PARTITION BY team_id, period) AS in_period, count(*) OVER (PARTITION BY team_id, period) > 1 AS double FROM sides",
)
def side_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.side_sequence(sides(spark, sf_dir)).select("match_id", "team_id", F.col("sequence").cast("long").alias("sequence"), "in_period", "double")


#: Here a period is a day, counted from the year of the first matches; the horizon is its first five days. A day's users play for the nation of their number.
FIRST_DAY = "1994-12-31"
DAY_SIDES = f"{SIDES}, day_sides AS (SELECT team_id, CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(kickoff AS DATE)) AS BIGINT) AS period, match_id, opponent_id, kickoff FROM sides WHERE date_diff('day', DATE '{FIRST_DAY}', CAST(kickoff AS DATE)) BETWEEN 1 AND 5)"


def _day_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("kickoff"), F.lit(FIRST_DAY)).cast("long")
    return sides(spark, sf_dir).withColumn("period", day).where(F.col("period").between(1, 5))


@query(
    "p14_team_weeks",
    f"""WITH {DAY_SIDES} SELECT n.team_id, d.period, count(match_id) AS fixtures, coalesce(string_agg(opponent_id, '|' ORDER BY opponent_id), '') AS opponents, CASE count(match_id) WHEN 0 THEN 'blank' WHEN 1 THEN 'single' ELSE 'double' END AS kind
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS team_id FROM nation) n CROSS JOIN (SELECT unnest(range(1, 6)) AS period) d LEFT JOIN day_sides s ON s.team_id = n.team_id AND s.period = d.period GROUP BY 1, 2""",
)
def team_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"))
    return h.team_weeks(teams, _day_sides(spark, sf_dir), 1, 5).withColumn("opponents", F.concat_ws("|", F.coalesce(F.col("opponents"), F.array().cast("array<long>")).cast("array<string>")))


@query(
    "a33_period_summary",
    f"""WITH {DAY_SIDES}, w AS (SELECT n.team_id, d.period, count(match_id) AS fixtures FROM (SELECT CAST(n_nationkey AS BIGINT) AS team_id FROM nation) n CROSS JOIN (SELECT unnest(range(1, 6)) AS period) d
            LEFT JOIN day_sides s ON s.team_id = n.team_id AND s.period = d.period GROUP BY 1, 2)
        SELECT period, CAST(sum(fixtures) AS BIGINT) AS sides, count(*) FILTER (fixtures = 0) AS blank, count(*) FILTER (fixtures = 1) AS single, count(*) FILTER (fixtures > 1) AS double FROM w GROUP BY 1""",
)
def period_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("team_id"))
    return h.period_summary(h.team_weeks(teams, _day_sides(spark, sf_dir), 1, 5))


HORIZON = f"""{DAY_SIDES}, {USER_DAYS}, pl AS (SELECT DISTINCT user_id AS player_id, user_id % 25 AS team_id, user_id % 11 <> 0 AS selectable FROM events),
    cells AS (SELECT pl.player_id, d.period, s.match_id, s.match_id IS NOT NULL AS has_fixture, CASE WHEN NOT selectable THEN 'not_selectable' WHEN s.match_id IS NULL THEN 'blank' WHEN s.kickoff IS NULL THEN 'no_kickoff' ELSE 'eligible' END AS reason
              FROM pl CROSS JOIN (SELECT unnest(range(1, 6)) AS period) d LEFT JOIN day_sides s ON s.team_id = pl.team_id AND s.period = d.period),
    long AS (SELECT c.*, u.points, u.points * [1.0, 0.85, 0.70, 0.55, 0.40][period] AS discounted, CASE WHEN NOT has_fixture THEN 'blank' WHEN reason <> 'eligible' THEN 'ineligible' WHEN u.user_id IS NOT NULL THEN 'available' WHEN period > 1 THEN 'missing_future' ELSE 'missing_required' END AS row_status,
                    u.points IS NULL OR NOT has_fixture AS review FROM cells c LEFT JOIN user_days u ON u.user_id = c.player_id AND u.day = c.period)"""


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").alias("player_id"), (F.col("user_id") % 25).alias("team_id"), (F.col("user_id") % 11 != 0).alias("selectable"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions = user_days(spark, sf_dir).where("day BETWEEN 1 AND 5").select(F.col("user_id").alias("player_id"), F.col("day").alias("period"), "points")
    return h.long_horizon(h.eligibility(_players(spark, sf_dir), _day_sides(spark, sf_dir), 1, 5, predictions), None, 1)


@query("p15_eligibility", f"WITH {HORIZON} SELECT player_id, period, match_id, has_fixture, reason, reason = 'eligible' AS eligible FROM cells")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.eligibility(_players(spark, sf_dir), _day_sides(spark, sf_dir), 1, 5).select("player_id", "period", "match_id", "has_fixture", "reason", "eligible")


@query("p16_long_horizon", f"WITH {HORIZON} SELECT player_id, period, match_id, points, round(CAST(discounted AS DOUBLE), 6) AS discounted, row_status, review FROM long")
def long_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).select("player_id", "period", "match_id", "points", F.round("discounted", 6).alias("discounted"), "row_status", "review")


@query(
    "p17_mode",
    f"""WITH {HORIZON}, e AS (SELECT player_id, count(DISTINCT period) FILTER (points IS NOT NULL) AS n, bool_or(period = 1 AND points IS NOT NULL) AS first FROM long GROUP BY 1)
    SELECT count(*) AS players, count(*) FILTER (first) AS first_known, count(*) FILTER (n = 5) AS all_known, CASE WHEN count(*) FILTER (n = 5) = count(*) THEN 'full_horizon' WHEN count(*) FILTER (first) = count(*) THEN 'first_only' ELSE 'none' END AS mode FROM e""",
)
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.mode_of(_long(spark, sf_dir), 1, 5)


@query("a32_player_totals", f"WITH {HORIZON} SELECT player_id, CAST(sum(points) AS BIGINT) AS points, count(*) FILTER (points IS NULL) AS missing, coalesce(string_agg(DISTINCT CASE WHEN points IS NULL THEN period END, '|' ORDER BY CASE WHEN points IS NULL THEN period END), '') AS missing_periods FROM long GROUP BY 1")
def player_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.player_totals(_long(spark, sf_dir)).drop("discounted")


@query("v21_wide_points", f"WITH {USER_DAYS} SELECT user_id AS player_id, {', '.join(f'CAST(sum(points) FILTER (day = {d}) AS BIGINT) AS period_{d}' for d in range(1, 6))} FROM user_days GROUP BY 1")
def wide_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.wide_points(user_days(spark, sf_dir).select(F.col("user_id").alias("player_id"), F.col("day").alias("period"), "points"), range(1, 6))


POSITION = "CASE user_id % 4 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' ELSE 'FWD' END"


@query(
    "e01_match_score",
    f"""WITH {USER_DAYS}, m AS (SELECT *, {POSITION} AS position, minutes * 20 AS played FROM user_days)
    SELECT user_id, day, CAST(CASE WHEN played >= 60 THEN 2 WHEN played >= 1 THEN 1 ELSE 0 END AS BIGINT) AS appearance_points, goals * CASE position WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END AS goal_points,
        CASE WHEN cards >= 3 THEN (cards // 3) * -3 ELSE cards * -1 END AS card_points, CASE WHEN position = 'GKP' THEN saves // 3 ELSE 0 END AS save_points,
        CASE WHEN position <> 'GKP' AND saves > 0 THEN 'saves_without_goalkeeper' END AS problem,
        CASE WHEN position = 'GKP' OR saves = 0 THEN CASE WHEN played >= 60 THEN 2 WHEN played >= 1 THEN 1 ELSE 0 END + goals * CASE position WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END + assists * 3
            + CASE WHEN assists = 0 AND played >= 60 THEN CASE position WHEN 'GKP' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END + CASE WHEN position = 'GKP' THEN saves // 3 ELSE 0 END
            + CASE WHEN cards >= 3 THEN (cards // 3) * -3 ELSE cards * -1 END + CASE WHEN position IN ('GKP', 'DEF') THEN -(assists // 2) ELSE 0 END + day % 4
            + CASE WHEN (position = 'DEF' AND minutes * 3 >= 10) OR (position IN ('MID', 'FWD') AND minutes * 3 >= 12) THEN 2 ELSE 0 END END AS total_points
    FROM m""",
)
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a match: errors are cards, views saves, clicks assists and goals conceded."""
    zero = F.lit(0)
    rows = user_days(spark, sf_dir).select(
        "user_id", "day", F.element_at(F.array(*map(F.lit, ("GKP", "DEF", "MID", "FWD"))), (F.col("user_id") % 4 + 1).cast("int")).alias("position"), (F.col("minutes") * 20).alias("minutes"), "goals", "assists", "saves",
        zero.alias("penalty_saves"), F.col("cards").alias("yellow_cards"), F.floor(F.col("cards") / 3).alias("red_cards"), zero.alias("own_goals"), zero.alias("penalty_misses"), F.col("assists").alias("conceded"), (F.col("day") % 4).alias("bonus"),
        (F.col("minutes") * 3).alias("contributions"), (F.col("assists") == 0).alias("clean_sheet"), F.lit(False).alias("as_goalkeeper"),
    )
    return ru.score(rows).select("user_id", "day", "appearance_points", "goal_points", "card_points", "save_points", "problem", "total_points")


ROLES = "CASE position WHEN 'SMALL' THEN 'GKP' WHEN 'LARGE' THEN 'DEF' WHEN 'PROMO' THEN 'MID' WHEN 'ECONOMY' THEN 'FWD' END"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of four types as candidates: price in tens, points from what was sold."""
    role = F.try_element_at(F.create_map(*map(F.lit, ("SMALL", "GKP", "LARGE", "DEF", "PROMO", "MID", "ECONOMY", "FWD"))), F.col("position"))
    rows = player_points(spark, sf_dir).withColumn("position", role).where("position IS NOT NULL")
    return rows.select(F.lit("all").alias("scenario"), "player_id", "position", "club", F.floor(F.col("price") / 200).alias("price"), "points")


@query(
    "e02_squad_legality",
    f"""WITH {PLAYER_POINTS}, m AS (SELECT player_id % 130 AS squad_id, player_id, {ROLES} AS position, club, price // 200 AS price FROM player_points WHERE position IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY')),
    c AS (SELECT squad_id, max(n) AS most FROM (SELECT squad_id, club, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT squad_id, count(*) AS players, count(DISTINCT player_id) AS distinct_players, CAST(sum(price) AS BIGINT) AS price, most,
            count(*) FILTER (position = 'GKP') <> 2 OR count(*) FILTER (position = 'DEF') <> 5 OR count(*) FILTER (position = 'MID') <> 5 OR count(*) FILTER (position = 'FWD') <> 3 AS quota FROM m JOIN c USING (squad_id) GROUP BY squad_id, most)
    SELECT squad_id, players, distinct_players, price, concat_ws('|', CASE WHEN players <> 15 THEN 'squad_size' END, CASE WHEN distinct_players <> players THEN 'duplicate_players' END, CASE WHEN quota THEN 'position_quotas' END, CASE WHEN most > 3 THEN 'club_limit' END, CASE WHEN price > 1000 THEN 'budget' END) AS errors FROM s""",
)
def squad_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _pool(spark, sf_dir).withColumn("squad_id", F.col("player_id") % 130)
    return ru.squad_legality(members).select("squad_id", "players", "distinct_players", "price", F.concat_ws("|", "errors").alias("errors"))


@query(
    "e04_transfer_price",
    f"WITH {USER_DAYS} SELECT user_id, day, CASE WHEN cards >= 2 OR day = 1 THEN 0 ELSE greatest(0, minutes - 1) * 4 END AS cost, CASE WHEN cards >= 2 OR day = 1 THEN 1 ELSE 1 - least(minutes, 1) END AS left_over FROM user_days",
)
def transfer_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    chip = F.when(F.col("cards") >= 2, "wildcard")
    cost, left = ru.transfer_price(F.col("minutes"), F.lit(1), chip, F.col("day") == 1)
    return user_days(spark, sf_dir).select("user_id", "day", cost.alias("cost"), left.alias("left_over"))


@query(
    "e05_transfer_bank",
    f"""WITH RECURSIVE {USER_DAYS}, w AS (SELECT user_id AS manager_id, day AS week, goals AS used, cards >= 2 AS chip, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM user_days),
    f AS (SELECT DISTINCT manager_id, CAST(0 AS BIGINT) AS n, CAST(1 AS BIGINT) AS bank FROM w UNION ALL
          SELECT f.manager_id, w.n, least(5, greatest(CASE WHEN chip THEN bank ELSE least(5, bank - least(bank, used) + 1) END, CASE WHEN week = 15 THEN 5 ELSE 0 END)) FROM f JOIN w ON w.manager_id = f.manager_id AND w.n = f.n + 1)
    SELECT manager_id, CAST(arg_max(bank, n) AS INTEGER) AS free_transfers FROM f GROUP BY 1""",
)
def transfer_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days folded in order: a sequential rule, tested against a plain loop."""
    weeks = user_days(spark, sf_dir).select(F.col("user_id").alias("manager_id"), F.col("day").alias("week"), F.col("goals").alias("used"), F.when(F.col("cards") >= 2, "wildcard").alias("chip"))
    return ru.bank_after(weeks, {15: 5})


@query(
    "e07_chip_inventory",
    """WITH w AS (SELECT * FROM (VALUES ('click', 1, 1, 10, 20), ('click', 2, 11, 30, 40), ('purchase', 1, 1, 30, 5)) t(chip, wnd, f, l, allowed)),
    u AS (SELECT user_id, event_type AS chip, date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS week FROM events),
    g AS (SELECT m.user_id, w.* FROM (SELECT DISTINCT user_id FROM events) m CROSS JOIN w)
    SELECT g.user_id AS manager_id, g.chip, g.wnd AS "window", g.allowed, count(u.week) AS used, greatest(0, g.allowed - count(u.week)) AS "left" FROM g LEFT JOIN u ON u.user_id = g.user_id AND u.chip = g.chip AND u.week BETWEEN g.f AND g.l GROUP BY g.user_id, g.chip, g.wnd, g.allowed""",
)
def chip_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    uses = events.select(F.col("user_id").alias("manager_id"), F.col("event_type").alias("chip"), F.datediff(F.to_date("ts"), F.lit("2023-12-31")).alias("week"))
    windows = spark.createDataFrame([("click", 1, 1, 10, 20), ("click", 2, 11, 30, 40), ("purchase", 1, 1, 30, 5)], "chip string, window int, first int, last int, allowed int")
    return ru.chip_inventory(uses, windows, events.select(F.col("user_id").alias("manager_id")).distinct())


@query("r01_greedy_squad")
def greedy_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.squads(_pool(spark, sf_dir), exact=False)


@query("r11_best_squad")
def best_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squad of most points under quotas, club limit and budget, by search with a bound; tested against enumeration."""
    return p.squads(_pool(spark, sf_dir), exact=True)


TEAM = f"{PLAYER_POINTS}, pool AS (SELECT player_id, {ROLES} AS position, club, price // 200 AS price, points FROM player_points WHERE position IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY')), squad AS (SELECT * FROM pool WHERE player_id % 40 = 7)"


def _squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).where("player_id % 40 = 7")


@query(
    "r05_starting_eleven",
    f"""WITH {TEAM}, s AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player_id) <= CASE position WHEN 'GKP' THEN 1 WHEN 'DEF' THEN 3 WHEN 'MID' THEN 4 ELSE 3 END AS starts FROM squad)
    SELECT player_id, starts, CASE WHEN NOT starts THEN row_number() OVER (PARTITION BY starts ORDER BY position = 'GKP' DESC, points DESC, player_id) END AS bench_order FROM s""",
)
def starting_eleven(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.starting_eleven(_squad(spark, sf_dir)).select("player_id", "starts", F.col("bench_order").cast("long").alias("bench_order"))


@query(
    "r06_transfer_candidates",
    f"""WITH {TEAM}, w AS (SELECT * FROM squad QUALIFY row_number() OVER (PARTITION BY position ORDER BY points, price DESC, player_id) = 1), c AS (SELECT club, count(*) AS n FROM squad GROUP BY 1)
    SELECT w.position, w.player_id AS out_id, i.player_id AS in_id, CASE WHEN i.player_id IN (SELECT player_id FROM squad) THEN 'owned' WHEN i.player_id % 13 = 0 THEN 'not_selectable' WHEN i.price > w.price + 5 THEN 'too_expensive'
            WHEN coalesce(c.n, 0) + 1 - CASE WHEN i.club = w.club THEN 1 ELSE 0 END > 3 THEN 'club_limit' WHEN i.points <= w.points THEN 'no_gain' END AS reason, i.points - w.points AS gain
    FROM w JOIN pool i USING (position) LEFT JOIN c ON c.club = i.club""",
)
def transfer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir).withColumn("selectable", F.col("player_id") % 13 != 0)
    return p.transfer_candidates(_squad(spark, sf_dir), pool, bank=5).drop("scenario")


@query(
    "r08_paired_transfers",
    f"""WITH {TEAM}, o AS (SELECT position, player_id AS out_id, points AS op, row_number() OVER (PARTITION BY position ORDER BY points, player_id) AS rank FROM squad),
    i AS (SELECT position, player_id AS in_id, points AS ip, row_number() OVER (PARTITION BY position ORDER BY points DESC, player_id) AS rank FROM pool WHERE player_id NOT IN (SELECT player_id FROM squad))
    SELECT position, rank, out_id, in_id, ip - op AS gain FROM o JOIN i USING (position, rank) WHERE ip > op""",
)
def paired_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.paired_transfers(_squad(spark, sf_dir), _pool(spark, sf_dir).drop("scenario")).select("position", F.col("rank").cast("long").alias("rank"), "out_id", "in_id", "gain")


@query(
    "r09_scenarios",
    f"WITH {TEAM}, x AS (SELECT CAST(coalesce(sum(points) FILTER (player_id % 3 <> 0), 0) AS BIGINT) AS base, CAST(coalesce(sum(points) FILTER (player_id % 3 = 0), 0) AS BIGINT) AS bench_gain, CAST(2 * coalesce(sum(points) FILTER (player_id = 47), 0) AS BIGINT) AS captain_gain FROM squad) SELECT *, base + bench_gain AS bench_boost, base + captain_gain AS triple_captain FROM x",
)
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.scenario_delta(_squad(spark, sf_dir), F.col("player_id") % 3 != 0, F.col("player_id") % 3 == 0, F.col("player_id") == 47)


@query(
    "v01_check_suite",
    """SELECT 'orders.null_key' AS name, count(*) FILTER (o_orderkey IS NULL) = 0 AS passed, count(*) FILTER (o_orderkey IS NULL) AS value FROM orders
    UNION ALL SELECT 'orders.price_not_positive', count(*) FILTER (o_totalprice <= 0) = 0, count(*) FILTER (o_totalprice <= 0) FROM orders
    UNION ALL SELECT 'orders.rows', count(*) >= 1, count(*) FROM orders
    UNION ALL SELECT 'lineitem.duplicate_keys', count(*) = 0, count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'orders.orphans', count(*) = 0, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
    UNION ALL SELECT 'events.missing_periods', 40 - count(DISTINCT d) = 0, 40 - count(DISTINCT d) FROM (SELECT date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS d FROM events) WHERE d BETWEEN 1 AND 40
    UNION ALL SELECT 'orders_lines.key_differences', count(*) = 0, count(*) FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL""",
)
def check_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines, customer, events = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer", "events"))
    return ck.suite(
        ck.row_checks(orders, "orders", {"null_key": F.col("o_orderkey").isNull(), "price_not_positive": F.col("o_totalprice") <= 0}),
        ck.count_at_least(orders, "orders"),
        ck.unique_keys(lines, "lineitem", ["l_orderkey", "l_linenumber"]),
        ck.orphans(orders, customer.where("c_custkey % 10 <> 0"), "orders", "o_custkey", "c_custkey"),
        ck.period_coverage(events.withColumn("day", F.datediff(F.to_date("ts"), F.lit("2023-12-31"))), "events", "day", 1, 40),
        ck.same_keys(orders.select(F.col("o_orderkey").alias("k")), lines.select(F.col("l_orderkey").alias("k")), "orders_lines", ["k"]),
    )


@query(
    "v17_column_spec",
    "SELECT 'labels.doc_id_null' AS name, count(*) FILTER (doc_id IS NULL) = 0 AS passed, count(*) FILTER (doc_id IS NULL) AS value FROM labels UNION ALL SELECT 'labels.toxic_not_constant', count(*) FILTER (toxic <> 0) = 0, count(*) FILTER (toxic <> 0) FROM labels UNION ALL SELECT 'labels.duplicate_keys', count(*) = 0, count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)",
)
def column_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ck.column_spec(table(spark, sf_dir, "labels"), "labels", unique=["doc_id"], constant={"toxic": 0}, required=["doc_id"])


@query("x03_normal_names", "SELECT c_custkey, trim(regexp_replace(lower(replace(c_name, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) AS name, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS compact FROM customer")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", t.normal_name("c_name").alias("name"), t.compact_name("c_name").alias("compact"))


@query("x05_name_parts", "SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS last, substr(p_name, 1, 1) || ' ' || split_part(p_name, ' ', 2) AS initial FROM part")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name", t.last_token("p_name").alias("last"), t.initial_surname("p_name").alias("initial")).distinct()


@query("x14_coerce", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders")
def coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", t.to_number(F.substring("o_orderpriority", 1, 1), "long").alias("level"), t.to_number("o_orderpriority").alias("bad"))


@query("v07_identity_scores")
def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts against the same names written otherwise: all pairs that can reach the score of a doubtful runner-up, with the score of the best spelling."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("left_id"), F.min("p_type").alias("kind"))
    left = idt.with_variants(names, "p_name")
    other = names.select((F.col("left_id") + 1_000_000).alias("right_id"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(". "), F.substring_index("p_name", " ", -1)).alias("other"), F.col("kind").alias("other_kind"))
    right = idt.with_variants(other, "other").withColumnRenamed("variants", "other_variants")
    pairs = idt.scored_pairs(left, right, "left_id", "right_id", "variants", "other_variants", idt.needed_name_score(0.95 - 0.03))
    named = pairs.join(left, "left_id").join(right, "right_id")
    same = F.col("kind") == F.col("other_kind")
    scored = named.withColumn("score", F.round(idt.match_score("name_score", same, F.lit(True), F.lit(False), idt.same_initial("p_name", "other"), F.lit(False)), 4))
    ranked = idt.rank_candidates(scored, "left_id", "right_id", "score")
    return idt.approve(ranked, "left_id", "right_id", "score").select("left_id", "right_id", F.round("name_score", 4).alias("name_score"), "score", "ambiguous", "status")


@query(
    "v10_rollover_map",
    """WITH a AS (SELECT c_custkey AS before_id, c_name AS name, c_nationkey AS team FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey + 100000 AS after_id, CASE WHEN c_custkey % 5 = 0 THEN c_name || 'x' ELSE c_name END AS name, c_nationkey AS team FROM customer WHERE c_custkey % 4 <> 0),
    full_name AS (SELECT before_id, after_id, 'full_name' AS how FROM a JOIN b USING (name)),
    web AS (SELECT min(before_id) AS before_id, min(after_id) AS after_id, 'web_name_and_team' AS how FROM (SELECT team, min(before_id) AS before_id FROM a WHERE before_id NOT IN (SELECT before_id FROM full_name) GROUP BY team HAVING count(*) = 1) JOIN (SELECT team, min(after_id) AS after_id FROM b WHERE after_id NOT IN (SELECT after_id FROM full_name) GROUP BY team HAVING count(*) = 1) USING (team) GROUP BY team)
    SELECT * FROM full_name UNION ALL SELECT * FROM web""",
)
def rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two seasons by name, else by a short name (here one for all) that a team has once on both sides."""
    c = table(spark, sf_dir, "customer")
    changed = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    before = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("before_id"), F.col("c_name").alias("name"), F.lit("c").alias("web"), F.col("c_nationkey").alias("team"))
    after = c.where("c_custkey % 4 <> 0").select((F.col("c_custkey") + 100000).alias("after_id"), changed.alias("name"), F.lit("c").alias("web"), F.col("c_nationkey").alias("team"))
    return idt.rollover_map(before, after, "before_id", "after_id", "name", "web", "team")


@query("r03_locked_squad")
def locked_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A squad around two players that are in it for certain."""
    return p.locked_squads(_pool(spark, sf_dir), [r[0] for r in _pool(spark, sf_dir).where("position IN ('GKP', 'FWD')").groupBy("position").agg(F.min("player_id").alias("i")).select("i").collect()])


@query("r12_relaxed_squad")
def relaxed_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best squad under the first of three budgets and club limits that allows one; the first is out of reach on purpose."""
    return p.relaxed_squads(_pool(spark, sf_dir), [(1, 1), (ru.BUDGET, 2), (ru.BUDGET, 3)])


@query("r14_best_lineup")
def best_lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starting players of most points over all legal formations, of the best squad."""
    return p.lineups(p.squads(_pool(spark, sf_dir), exact=True))


@query("r11_role_squad")
def role_squad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squad whose best plan is worth most, with every player's role, under a limit on what the bench may cost."""
    return p.role_squads(_pool(spark, sf_dir), caps=p.Caps(bench_cost=240)).withColumn("value", F.round("value", 6))


@query("r14_lineup_plans")
def lineup_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best plan of the best squad with captain, vice and bench in order, and the two alternatives; tested against all plans."""
    return p.lineup_plans(p.squads(_pool(spark, sf_dir), exact=True)).withColumn("value", F.round("value", 6))


@query(
    "r10_backtest",
    f"""WITH {TEAM}, b AS (SELECT player_id FROM pool WHERE player_id % 40 = 7), a AS (SELECT player_id FROM pool WHERE player_id % 40 = 7 AND player_id % 3 <> 0 OR player_id % 200 = 1), u AS (SELECT coalesce(b.player_id, a.player_id) AS player_id, b.player_id IS NOT NULL AS was, a.player_id IS NOT NULL AS stays FROM b FULL JOIN a ON a.player_id = b.player_id) SELECT count(*) FILTER (NOT stays) AS "out", count(*) FILTER (NOT was) AS "in", CAST(coalesce(sum(points) FILTER (was), 0) AS BIGINT) AS points_before, CAST(coalesce(sum(points) FILTER (stays), 0) AS BIGINT) AS points_after, CAST(coalesce(sum(points) FILTER (stays), 0) - coalesce(sum(points) FILTER (was), 0) AS BIGINT) AS delta FROM u JOIN pool USING (player_id)""",
)
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return p.backtest(pool.where("player_id % 40 = 7"), pool.where("player_id % 40 = 7 AND player_id % 3 <> 0 OR player_id % 200 = 1"), pool)


@query(
    "e03_lineup_legality",
    f"""WITH {PLAYER_POINTS}, m AS (SELECT player_id % 130 AS squad_id, player_id, {ROLES} AS position, size % 4 <> 0 AS starts, size = 1 AS captain, size = 2 AS vice FROM player_points WHERE position IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY')),
    c AS (SELECT squad_id, count(*) FILTER (starts) AS s, count(*) FILTER (NOT starts) AS b, count(*) FILTER (starts AND position = 'GKP') AS g, count(*) FILTER (starts AND position = 'DEF') AS d, count(*) FILTER (starts AND position = 'MID') AS mi, count(*) FILTER (starts AND position = 'FWD') AS f,
            count(*) FILTER (NOT starts AND position = 'GKP') AS bg, count(*) FILTER (captain) AS c, count(*) FILTER (captain AND NOT starts) AS cn, count(*) FILTER (vice) AS v, count(*) FILTER (vice AND NOT starts) AS vn FROM m GROUP BY 1)
    SELECT squad_id, concat_ws('|', CASE WHEN s <> 11 THEN 'starting_size' END, CASE WHEN b <> 4 THEN 'bench_size' END, CASE WHEN g <> 1 OR d NOT BETWEEN 3 AND 5 OR mi NOT BETWEEN 2 AND 5 OR f NOT BETWEEN 1 AND 3 THEN 'formation' END, CASE WHEN bg <> 1 THEN 'bench_goalkeepers' END,
        CASE WHEN c <> 1 THEN 'captain' END, CASE WHEN cn > 0 THEN 'captain_not_starting' END, CASE WHEN v <> 1 THEN 'vice_captain' END, CASE WHEN vn > 0 THEN 'vice_not_starting' END) AS errors FROM c""",
)
def lineup_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = player_points(spark, sf_dir).select("player_id", "size")
    lines = _pool(spark, sf_dir).join(sizes, "player_id").select((F.col("player_id") % 130).alias("squad_id"), "player_id", "position", (F.col("size") % 4 != 0).alias("starts"), (F.col("size") == 1).alias("captain"), (F.col("size") == 2).alias("vice"))
    return ru.lineup_legality(lines).select("squad_id", F.concat_ws("|", "errors").alias("errors"))


@query(
    "r15_objective",
    f"""WITH {USER_DAYS}, l AS (SELECT user_id % 10 AS scenario, day AS period, user_id AS player_id, points * [1.0, 0.5, 0.25][day] * CASE user_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.25 END AS worth FROM user_days WHERE day <= 3)
    SELECT scenario, period, player_id, CAST(sum(worth) AS DOUBLE) AS value FROM l GROUP BY GROUPING SETS ((scenario, period, player_id), (scenario, period), (scenario))""",
)
def objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("captain", "vice", "starter", "bench"))), (F.col("user_id") % 4 + 1).cast("int"))
    lines = user_days(spark, sf_dir).select((F.col("user_id") % 10).alias("scenario"), F.col("day").alias("period"), F.col("user_id").alias("player_id"), role.alias("role"), "points")
    return p.objective(lines, {1: 1.0, 2: 0.5, 3: 0.25}, {"captain": 2.0, "vice": 1.5, "starter": 1.0, "bench": 0.25})


@query(
    "e08_chip_problems",
    """WITH w AS (SELECT * FROM (VALUES ('click', 1, 1, 10, 2), ('click', 2, 11, 25, 3), ('purchase', 1, 1, 30, 1)) t(chip, wnd, f, l, allowed)),
    u AS (SELECT DISTINCT user_id AS manager_id, CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS BIGINT) AS week, event_type AS chip FROM events WHERE event_type IN ('click', 'purchase')),
    r AS (SELECT u.*, w.wnd, w.allowed, row_number() OVER (PARTITION BY manager_id, u.chip, w.wnd ORDER BY week) AS nth, coalesce(u.chip = 'click' AND week - lag(week) OVER (PARTITION BY manager_id, u.chip ORDER BY week) = 1, false) AS in_row, count(*) OVER (PARTITION BY manager_id, week) > 1 AS same
          FROM u LEFT JOIN w ON w.chip = u.chip AND u.week BETWEEN w.f AND w.l)
    SELECT manager_id, week, chip, CASE WHEN wnd IS NULL THEN 'outside_windows' WHEN nth > allowed THEN 'over_allowance' WHEN in_row THEN 'in_a_row' WHEN same THEN 'two_in_one_week' END AS problem FROM r""",
)
def chip_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    uses = events.select(F.col("user_id").alias("manager_id"), F.datediff(F.to_date("ts"), F.lit("2023-12-31")).cast("long").alias("week"), F.col("event_type").alias("chip"))
    windows = spark.createDataFrame([("click", 1, 1, 10, 2), ("click", 2, 11, 25, 3), ("purchase", 1, 1, 30, 1)], "chip string, window int, first int, last int, allowed int")
    return ru.chip_problems(uses, windows, never_in_a_row=("click",))
