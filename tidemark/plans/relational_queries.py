"""Queries of filters, joins, ordering, paging, set operations and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as rel
from tidemark.operators import rolling as r
from tidemark.operators.models import weighted_blend
from tidemark.plans.frames import MATCHES, PLAYER_POINTS, PLAYERS, USER_DAYS, matches, player_points, players, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import flatten_live, require_columns, sql_frame, table


@query("s01_scan_with_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_frame(spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderdate >= :since AND o_orderstatus = :status", {"since": "1997-01-01", "status": "F"}, orders=table(spark, sf_dir, "orders"))


@query("s07_nested_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "s06_live_document",
    """SELECT CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS BIGINT) AS period, event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(0 AS BIGINT) AS missing FROM events""",
)
def live_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per day with its elements, flattened again; a measure that no element has is 0."""
    rows = table(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("2023-12-31")).cast("long").alias("period"), F.struct(F.col("event_id").alias("id"), F.from_json("props", "map<string,long>").alias("stats")).alias("e"))
    documents = rows.select("period", F.array("e").alias("elements"))
    return flatten_live(documents, ["k", "missing"])


@query("s09_required_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment"], "customer").select("c_custkey", "c_mktsegment")


@query("f01_optional_filters", f"WITH {MATCHES} SELECT match_id, home_id, away_id FROM matches WHERE season = 1997 AND period >= 30 AND home_id IN (1, 2, 3)")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.where_given(matches(spark, sf_dir), season=1997, period=(30, None), home_id=[1, 2, 3], away_id=None).select("match_id", "home_id", "away_id")


@query("f02_either_side", f"WITH {MATCHES} SELECT match_id FROM matches WHERE home_id = 7 OR away_id = 7")
def either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.either_side(matches(spark, sf_dir), 7, "home_id", "away_id").select("match_id")


@query("f03_substring", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(rel.contains_text("p_name", "RING")).select("p_partkey", "p_name")


@query(
    "f05_between_and_flags",
    "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 20 AND event_type IS NOT NULL AND NOT (event_type = 'error')",
)
def between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("value").between(10, 20) & F.col("event_type").isNotNull() & ~(F.col("event_type") == "error")).select("event_id", "value")


@query(
    "f06_prediction_query",
    f"WITH {PLAYER_POINTS} SELECT player_id, name, position, points FROM player_points WHERE position IN ('SMALL', 'LARGE') AND price <= 15000 AND points >= 500 AND name ILIKE '%bolt%'",
)
def prediction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rel.where_given(player_points(spark, sf_dir), position=["SMALL", "LARGE"], price=(None, 15000), points=(500, None))
    return rows.where(rel.contains_text("name", "bolt")).select("player_id", "name", "position", "points")


@query("f08_value", f"WITH {PLAYER_POINTS} SELECT player_id, price / 10 AS cost, points / greatest(price / 10, 0.1) AS value FROM player_points")
def value(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.col("price") / 10
    return player_points(spark, sf_dir).select("player_id", cost.alias("cost"), (F.col("points") / F.greatest(cost, F.lit(0.1))).alias("value"))


@query("f12_row_validity", "SELECT o_orderkey, o_totalprice > 0 AND o_orderdate IS NOT NULL AND NOT (count(*) OVER (PARTITION BY o_orderkey) > 1) AS valid FROM orders")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = (F.col("o_totalprice") > 0) & F.col("o_orderdate").isNotNull() & ~r.duplicate_flag(["o_orderkey"])
    return table(spark, sf_dir, "orders").select("o_orderkey", flags.alias("valid"))


@query("j01_three_way_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("j03_composite_key", f"WITH {USER_DAYS} SELECT a.user_id, a.day, a.points AS actual, b.points AS predicted FROM user_days a JOIN user_days b ON b.user_id = a.user_id AND b.day = a.day - 1")
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    before = days.select("user_id", (F.col("day") + 1).alias("day"), F.col("points").alias("predicted"))
    return days.select("user_id", "day", F.col("points").alias("actual")).join(before, ["user_id", "day"])


@query("j05_guarded_join", "SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return rel.guarded_join(table(spark, sf_dir, "supplier"), nation, ["s_nationkey"]).select("s_suppkey", "s_name", "n_name")


@query(
    "j08_full_outer",
    f"WITH {MATCHES} SELECT team_id, coalesce(h.n, 0) AS home, coalesce(a.n, 0) AS away FROM (SELECT home_id AS team_id, count(*) AS n FROM matches WHERE season = 1995 GROUP BY 1) h FULL JOIN (SELECT away_id AS team_id, count(*) AS n FROM matches WHERE season = 1995 GROUP BY 1) a USING (team_id)",
)
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir).where("season = 1995")
    count = lambda side: rows.groupBy(F.col(f"{side}_id").alias("team_id")).agg(F.count("*").alias(side))
    return count("home").join(count("away"), "team_id", "full").na.fill(0, ["home", "away"])


@query("j11_lookup_or_unknown", "SELECT c_custkey, coalesce(n_name, 'Unknown(' || c_nationkey || ')') AS team FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return rel.lookup(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation"), names.withColumnRenamed("n_nationkey", "nation"), "nation", "n_name", "team").select("c_custkey", "team")


@query("j12_found_flag", "SELECT o_orderkey, n IS NOT NULL AS found, coalesce(n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("lines"))


@query("j14_entity_period_grid", f"WITH {USER_DAYS} SELECT u.user_id, d.day, coalesce(x.points, 0) AS points, x.user_id IS NULL AS blank FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(1, 31)) AS day) d LEFT JOIN user_days x ON x.user_id = u.user_id AND x.day = d.day")
def entity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    cells = rel.grid(days.select("user_id").distinct(), 1, 30, "day")
    return cells.join(days.select("user_id", "day", "points"), ["user_id", "day"], "left").select("user_id", "day", F.coalesce("points", F.lit(0)).alias("points"), F.col("points").isNull().alias("blank"))


@query("j15_semi_join", "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("j16_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").select("o_orderkey")


@query(
    "j18_fallback_levels",
    f"""WITH {PLAYER_POINTS}, fine AS (SELECT position, club, median(points) AS m, count(*) AS n FROM player_points GROUP BY 1, 2), coarse AS (SELECT position, median(points) AS m FROM player_points GROUP BY 1)
    SELECT p.player_id, CASE WHEN f.n >= 14 THEN f.m ELSE c.m END AS expected, CASE WHEN f.n >= 14 THEN 'fine' WHEN c.m IS NOT NULL THEN 'coarse' ELSE 'none' END AS level
    FROM player_points p LEFT JOIN fine f USING (position, club) LEFT JOIN coarse c USING (position)""",
)
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_points(spark, sf_dir)
    fine = rows.groupBy("position", "club").agg(F.median("points").alias("expected"), F.count("*").alias("n"))
    coarse = rows.groupBy("position").agg(F.median("points").alias("expected"))
    return rel.fallback_join(rows.select("player_id", "position", "club"), fine, coarse, ["position", "club"], ["position"], "expected", "n", 14).select("player_id", "expected", "level")


@query(
    "j19_reconciliation",
    """WITH p AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS DOUBLE) AS v FROM orders), l AS (SELECT l_orderkey AS k, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1)
    SELECT coalesce(p.k, l.k) AS key, p.v AS orders, l.v AS lines, CASE WHEN p.v IS NULL OR l.v IS NULL THEN 'missing' ELSE 'mismatch' END AS status
    FROM p FULL JOIN l ON p.k = l.k WHERE p.v IS NULL OR l.v IS NULL OR abs(p.v - l.v) > 100000""",
)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).alias("v"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))
    return rel.reconcile({"orders": orders, "lines": lines}, ["key"], "v", 100000)


@query("o01_order_by_value", f"WITH {PLAYER_POINTS} SELECT player_id, row_number() OVER (ORDER BY points / (price + 1) DESC, player_id) AS place FROM player_points ORDER BY place LIMIT 200")
def order_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first 200 rows; the rank is given to the rows that the limit has left."""
    from pyspark.sql import Window

    order = [(F.col("points") / (F.col("price") + 1)).desc(), F.asc("player_id")]
    first = player_points(spark, sf_dir).orderBy(*order).limit(200)
    return first.select("player_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("o02_page", f"WITH {PLAYER_POINTS} SELECT player_id, points FROM player_points ORDER BY points DESC, player_id LIMIT 50 OFFSET 100")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.page(player_points(spark, sf_dir).select("player_id", "points"), [F.desc("points"), F.asc("player_id")], 100, 50)


@query("a02_total_of_filter", f"WITH {MATCHES} SELECT count(*) AS total FROM matches WHERE season = 1997")
def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.where_given(matches(spark, sf_dir), season=1997).agg(F.count("*").alias("total"))


@query("o03_top_k", f"WITH {PLAYER_POINTS} SELECT player_id, points FROM player_points WHERE position = 'PROMO' ORDER BY points DESC, player_id LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).where("position = 'PROMO'").select("player_id", "points").orderBy(F.desc("points"), "player_id").limit(10)


@query("o05_top_k_per_group", f"WITH {PLAYER_POINTS} SELECT position, player_id, points, row_number() OVER (PARTITION BY position ORDER BY points DESC, player_id) AS rank FROM player_points QUALIFY rank <= 5")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = player_points(spark, sf_dir).select("position", "player_id", "points")
    return r.top_per_group(rows, ["position"], [F.desc("points"), F.asc("player_id")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("o13_tie_break_tuple", f"WITH {PLAYER_POINTS} SELECT club, arg_min(player_id, (-points, price, player_id)) AS best FROM player_points GROUP BY club")
def tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_points(spark, sf_dir).groupBy("club").agg(F.min_by("player_id", F.struct(-F.col("points"), "price", "player_id")).alias("best"))


@query("u03_union_of_names", "SELECT DISTINCT n FROM (SELECT o_orderstatus AS n FROM orders UNION ALL SELECT l_linestatus FROM lineitem)")
def union_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("n")).union(table(spark, sf_dir, "lineitem").select("l_linestatus")).distinct()


@query(
    "u05_set_status",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)
    SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.k = b.k""",
)
def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rel.set_status(orders.where(F.year("o_orderdate") == 1996), orders.where(F.year("o_orderdate") == 1997), ["o_custkey"])


SNAPSHOTS = """before AS (SELECT user_id, max(event_id) AS last, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 7 <> 0 GROUP BY 1),
    after AS (SELECT user_id, max(event_id) AS last, count(*) AS n FROM events WHERE user_id % 5 <> 0 AND (user_id % 3 = 0 OR ts < TIMESTAMP '2024-01-15') GROUP BY 1),
    diff AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'new' WHEN a.user_id IS NULL THEN 'removed' WHEN a.last = b.last AND a.n = b.n THEN 'unchanged' ELSE 'changed' END AS status,
                    a.last, a.n, b.last AS old_last, b.n AS old_n FROM after a FULL JOIN before b ON a.user_id = b.user_id)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shape = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    before, after = shape(events.where(early & (F.col("user_id") % 7 != 0))), shape(events.where((F.col("user_id") % 5 != 0) & ((F.col("user_id") % 3 == 0) | early)))
    return rel.snapshot_diff(before, after, ["user_id"], ["last", "n"])


@query("u07_snapshot_diff", f"WITH {SNAPSHOTS} SELECT * FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the users' totals, of which some users are in one only."""
    return _snapshots(spark, sf_dir)


@query("k04_upsert_counts", f"WITH {SNAPSHOTS} SELECT count(*) FILTER (status = 'new') AS inserted, count(*) FILTER (status = 'changed') AS updated, count(*) FILTER (status = 'unchanged') AS skipped FROM diff")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.upsert_counts(_snapshots(spark, sf_dir))


@query(
    "k07_unknown_ids",
    """WITH lost AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) SELECT (SELECT count(*) FROM lost) AS unknown, (SELECT string_agg(o_orderkey, '|' ORDER BY o_orderkey) FROM (SELECT o_orderkey FROM lost ORDER BY 1 LIMIT 20)) AS shown""",
)
def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rel.unknown_keys(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return out.withColumn("shown", F.concat_ws("|", F.col("shown").cast("array<string>")))


@query("k08_totals_of_all_periods", f"WITH {USER_DAYS} SELECT day, count(*) AS rows, CAST(sum(points) AS BIGINT) AS points FROM user_days GROUP BY ROLLUP (day)")
def all_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).rollup("day").agg(F.count("*").alias("rows"), F.sum("points").alias("points"))


@query("k09_insert_or_update_counts", f"WITH {USER_DAYS}, new AS (SELECT * FROM user_days WHERE day BETWEEN 10 AND 20), old AS (SELECT * FROM user_days WHERE day < 15) SELECT count(*) FILTER (o.user_id IS NULL) AS inserted, count(*) FILTER (o.user_id IS NOT NULL) AS updated FROM new n LEFT JOIN old o USING (user_id, day)")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.writers import partition_counts as counts

    days = user_days(spark, sf_dir)
    return counts(days.where("day BETWEEN 10 AND 20"), days.where("day < 15"), ["user_id", "day"])


@query("x22_weighted_blend", f"WITH {PLAYER_POINTS} SELECT player_id, CASE WHEN nullif(games, 30) IS NULL THEN CAST(nullif(points, 765) AS DOUBLE) WHEN nullif(points, 765) IS NULL THEN games ELSE 0.7 * games + (1 - 0.7) * points END AS blend FROM player_points")
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.nullif("games", F.lit(30)).cast("double"), F.nullif("points", F.lit(765)).cast("double")
    return player_points(spark, sf_dir).select("player_id", weighted_blend(a, b, 0.7).alias("blend"))


@query("k05_dimension_upsert", f"WITH {PLAYERS}, old AS (SELECT player_id, price FROM players WHERE player_id % 10 <> 3), new AS (SELECT player_id, CASE WHEN player_id % 4 = 0 THEN price + 1 ELSE price END AS price FROM players) SELECT n.player_id, CASE WHEN o.player_id IS NULL THEN 'new' WHEN o.price = n.price THEN 'unchanged' ELSE 'changed' END AS status, n.price, o.price AS old_price FROM new n LEFT JOIN old o USING (player_id)")
def dimension_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = players(spark, sf_dir).select("player_id", "price")
    new = rows.withColumn("price", F.when(F.col("player_id") % 4 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return rel.snapshot_diff(rows.where("player_id % 10 <> 3"), new, ["player_id"], ["price"])
