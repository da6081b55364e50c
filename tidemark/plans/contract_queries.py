"""Queries of contracts, registries, catalogs and text rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import contracts as co
from tidemark.plans.frames import MATCHES, USER_DAYS, matches, user_days
from tidemark.plans.game_queries import HORIZON, _long
from tidemark.plans.lineage_queries import PROJECTED, SHOWN_SQL, projected
from tidemark.plans.registry import query
from tidemark.sources.readers import table, table_columns

PARTS = ("appearance_points", "goal_points", "assist_points", "clean_sheet_points", "bonus_points", "other_points")
ZERO = {
    "null_keys": "player_id IS NULL", "unknown_positions": "NOT coalesce(position IN ('GKP', 'DEF', 'MID', 'FWD'), false)",
    **{f"{c}_null": f"{c} IS NULL" for c in ("appearance_chance", "start_chance", "clean_chance")}, **{f"{c}_range": f"{c} NOT BETWEEN 0 AND 1" for c in ("appearance_chance", "start_chance", "clean_chance")},
    "start_above_appearance": "start_chance > appearance_chance + 1e-6", "minutes_null": "expected_minutes IS NULL OR minutes_low IS NULL OR minutes_high IS NULL", "minutes_range": "expected_minutes NOT BETWEEN 0 AND 90",
    "low_above_minutes": "minutes_low > expected_minutes + 1e-6", "high_below_minutes": "minutes_high + 1e-6 < expected_minutes", "points_null": "points IS NULL", "points_range": "points NOT BETWEEN -1e-6 AND 15.000001",
    "components_null": " OR ".join(f"{c} IS NULL" for c in PARTS),
}
NAMES = ("appearance_chance", "start_chance", "expected_minutes", "minutes_low", "minutes_high", "points0", "guardrail", *PARTS)


@query(
    "v14_prediction_manifest",
    f"""WITH {PROJECTED}, named AS (SELECT h.player_id, h.position, h.club, pp.size, clean AS clean_chance, {", ".join(f"{sql} AS {name}" for name, sql in zip(NAMES, SHOWN_SQL))} FROM h JOIN player_points pp ON pp.player_id = h.player_id),
    p AS (SELECT *, CASE WHEN size % 9 = 0 THEN points0 + 20 ELSE points0 END AS points FROM named),
    checks AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, CAST(count(*) FILTER ({cond}) AS DOUBLE) AS value, 0.0 AS most FROM p" for n, cond in ZERO.items())}
        UNION ALL SELECT 'component_error', max(abs({" + ".join(PARTS)} - points)), 1e-6 FROM p
        UNION ALL SELECT 'repeated_keys', CAST(count(*) AS DOUBLE), 0.0 FROM (SELECT player_id FROM p WHERE player_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'keeper_share', coalesce(max(share), 0), 0.980001 FROM (SELECT sum(appearance_chance) AS share FROM p WHERE position = 'GKP' GROUP BY club))
    SELECT name, value <= most AS passed, round(value, 6) AS value FROM checks""",
)
def prediction_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projected matches with a ninth of the points raised on purpose: the range and the components show it."""
    preview = projected(spark, sf_dir).withColumn("points", F.when(F.col("size") % 9 == 0, F.col("points") + 20).otherwise(F.col("points")))
    found = co.prediction_manifest(preview, ("appearance_chance", "start_chance", "clean_chance"), PARTS)
    return found.select("name", "passed", F.round("value", 6).alias("value"))


@query(
    "v20_snapshot_audit",
    f"""WITH {HORIZON} SELECT count(*) AS "rows", count(*) FILTER (reason = 'eligible') AS eligible, count(*) FILTER (reason <> 'eligible') AS not_eligible, count(*) FILTER (row_status = 'available') AS available, count(*) - count(DISTINCT player_id) AS repeated_keys,
        count(*) FILTER (points IS NULL) AS missing_points, count(*) FILTER (discounted IS NULL) AS missing_discounted, count(*) FILTER (review) AS marked_review FROM long WHERE period = 1""",
)
def snapshot_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.snapshot_audit(_long(spark, sf_dir), 1, F.col("row_status") == "available", F.col("reason") == "eligible", ["points", "discounted"], ["review"])


@query("v20_snapshot", f"WITH {HORIZON} SELECT player_id, match_id, points FROM long WHERE period = 1 AND row_status = 'available' AND NOT review")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _long(spark, sf_dir).where("row_status = 'available' AND NOT review")
    return co.snapshot_rows(good, 1, F.col("row_status") == "available", ["points"], ["review"]).select("player_id", "match_id", "points")


@query("f13_scope", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.scoped(table(spark, sf_dir, "orders"), "orders", o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_totalprice")


@query("f14_feature_columns", f"WITH {USER_DAYS} SELECT * EXCLUDE (user_id, day, points) FROM user_days")
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = user_days(spark, sf_dir)
    return days.select(*co.feature_columns(days, ["user_id", "day", "points"]))


@query("s14_table_columns", "SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS place FROM information_schema.columns WHERE table_name IN ('orders', 'nation', 'labels')")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns some tables have, asked of the catalog; a table that is not there has none."""
    for name in ("orders", "nation", "labels"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"probed_{name}")
    found = [(name, column, place) for name in ("orders", "nation", "labels", "absent") for place, column in enumerate(table_columns(spark, f"probed_{name}"), 1)]
    return spark.createDataFrame(found, "table_name string, column_name string, place long")


@query("x29_nested_get", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), 'none') AS k, 'none' AS deep FROM events")
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", t.nested_get("props", ["k"], "none").alias("k"), t.nested_get("props", ["k", "deeper"], "none").alias("deep"))


@query(
    "x06_name_variants",
    """SELECT DISTINCT p_name, array_to_string(list_sort(list_distinct(list_filter([p_name, replace(p_name, ' ', ''), split_part(p_name, ' ', -1), CASE WHEN contains(p_name, ' ') THEN substr(p_name, 1, 1) || ' ' || split_part(p_name, ' ', -1) END], lambda x: x IS NOT NULL AND x <> ''))), '|') AS variants FROM part""",
)
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name", F.array_join(t.name_variants("p_name"), "|").alias("variants")).distinct()


@query(
    "x09_position_codes",
    """WITH n AS (SELECT o_orderkey, ['1', ' gk', 'GKP', 'Goalkeeper', '2', 'def', 'DEFENDER', '3', 'Mid ', 'midfielder', '4', 'FWD', 'for', 'Forward', 'striker', 'coach', ''][o_orderkey % 17 + 1] AS said FROM orders)
    SELECT o_orderkey, ['GKP', 'GKP', 'GKP', 'GKP', 'DEF', 'DEF', 'DEF', 'MID', 'MID', 'MID', 'FWD', 'FWD', 'FWD', 'FWD', 'FWD', NULL, NULL][o_orderkey % 17 + 1] AS position FROM n""",
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("1", " gk", "GKP", "Goalkeeper", "2", "def", "DEFENDER", "3", "Mid ", "midfielder", "4", "FWD", "for", "Forward", "striker", "coach", "")
    said = F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 17).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", t.position_code(said).alias("position"))


@query("x10_team_names", "SELECT c_custkey, 'manchester united ' || regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') AS team FROM customer")
def team_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", t.team_name(F.concat(F.lit("Man. Utd "), "c_name")).alias("team"))


@query("x28_text_lists", "SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, o_orderpriority, 'x'], lambda v: v <> 'O'), '|') AS parts FROM orders")
def text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as JSON text where the key is even, with commas where it is odd."""
    status = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus"))
    as_json, as_text = F.to_json(F.array(status, "o_orderpriority", F.lit("x"))), F.concat_ws(" , ", status, "o_orderpriority", F.lit("x"))
    said = F.when(F.col("o_orderkey") % 2 == 0, as_json).otherwise(as_text)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(t.text_list(said), "|").alias("parts"))


@query("x33_safe_segments", "SELECT page_id, regexp_full_match(split_part(url, '/', -1), '[A-Za-z0-9_-][A-Za-z0-9._-]*') AS safe FROM pages")
def safe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", t.safe_segment(F.element_at(F.split("url", "/"), -1)).alias("safe"))


#: Three audit reports for each order, spoilt by what the order is like. The text is read by both engines.
REPORTS = """SELECT o_orderkey,
    concat('{"multi_season_model_training_ready": ', CASE WHEN o_orderpriority LIKE '5%' THEN '"true soon"' WHEN o_orderpriority LIKE '4%' THEN 'false' ELSE 'true' END, '}') AS training,
    concat('{"passed": ', CASE WHEN o_orderstatus = 'P' THEN 'false' ELSE 'true' END, ', "writes_database": ', CASE WHEN o_totalprice > 30000 THEN 'true' ELSE 'false' END, '}') AS mapping,
    concat('{"passed": true, "ready_for_prior_feature_export": true, "writes_database": false, "blockers": ', CASE WHEN o_orderpriority LIKE '1%' THEN '["rows"]' ELSE '[ ]' END,
        ', "join_summary": {"row_count_preserved": ', CASE WHEN o_totalprice < 1000 THEN 'false' ELSE 'true' END, ', "joined_feature_key_duplicate_count": ', CASE WHEN o_orderstatus = 'F' AND o_totalprice > 20000 THEN '2' ELSE '0' END, '}}') AS joined
    FROM orders"""


@query(
    "v26_training_readiness",
    f"""WITH r AS (SELECT o_orderkey, CAST(training AS JSON) AS t, CAST(mapping AS JSON) AS m, CAST(joined AS JSON) AS j FROM ({REPORTS})),
    s AS (SELECT o_orderkey, CAST(j->'$.passed' AS BOOLEAN) AND CAST(j->'$.ready_for_prior_feature_export' AS BOOLEAN) AND NOT CAST(j->'$.writes_database' AS BOOLEAN) AND json_array_length(j->'$.blockers') = 0
            AND CAST(j->'$.join_summary.row_count_preserved' AS BOOLEAN) AND CAST(j->'$.join_summary.joined_feature_key_duplicate_count' AS INT) = 0 AS prior_join_allowed,
        CAST(m->'$.passed' AS BOOLEAN) AND NOT CAST(m->'$.writes_database' AS BOOLEAN) AS mapping_safe, t->>'$.multi_season_model_training_ready' = 'true' AS says FROM r)
    SELECT o_orderkey, prior_join_allowed, mapping_safe, prior_join_allowed AND mapping_safe AND says AS training_ready FROM s""",
)
def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.strip() for c in REPORTS.removeprefix("SELECT").rsplit("FROM", 1)[0].split(",\n    concat")]
    reports = table(spark, sf_dir, "orders").selectExpr(columns[0], *(f"concat{c}" for c in columns[1:]))
    return co.training_readiness(reports, join="joined").select("o_orderkey", "prior_join_allowed", "mapping_safe", "training_ready")


@query(
    "k06_fixture_upsert",
    f"""WITH {MATCHES}, rows AS (SELECT *, home_id >= 22 OR away_id >= 22 AS lost FROM matches), b AS (SELECT match_id, home_score + CASE WHEN match_id % 7 = 0 THEN 1 ELSE 0 END AS home_score, away_score FROM matches WHERE season < 1998),
    j AS (SELECT b.match_id AS old, b.home_score = a.home_score AND b.away_score = a.away_score AS same FROM (SELECT * FROM rows WHERE NOT lost) a LEFT JOIN b ON b.match_id = a.match_id)
    SELECT count(*) FILTER (old IS NULL) AS inserted, count(*) FILTER (old IS NOT NULL AND NOT same) AS updated, count(*) FILTER (same) AS skipped, (SELECT count(*) FROM rows WHERE lost) AS unknown FROM j""",
)
def fixture_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches written over an older state; those with a team that is not known are left out."""
    rows = matches(spark, sf_dir)
    before = rows.where("season < 1998").select("match_id", (F.col("home_score") + F.when(F.col("match_id") % 7 == 0, 1).otherwise(0)).alias("home_score"), "away_score")
    known = table(spark, sf_dir, "nation").where("n_nationkey < 22").select(F.col("n_nationkey").cast("long").alias("id"))
    return co.upsert_known(before, rows.select("match_id", "home_id", "away_id", "home_score", "away_score"), ["match_id"], ["home_score", "away_score"], known, "id", ["home_id", "away_id"])


@query("k10_replaced_keys", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey % 3 <> 0 OR o_orderstatus = 'F'")
def replaced_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of some customers replaced by new rows, fewer than before."""
    old = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    changed = old.where("o_custkey % 3 = 0")
    new = changed.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    gone = changed.join(new.select("o_custkey").distinct(), "o_custkey", "left_anti")  # customers without a new row lose all of theirs
    return co.replaced(old, new, ["o_custkey"]).join(gone.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", "o_totalprice")


@query(
    "o08_leaderboard_keys",
    "WITH m AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS active, s_nationkey % 5 = 0 AS is_default, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS metric FROM supplier) SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY active DESC, is_default DESC, coalesce(metric, 9999), s_suppkey) AS place FROM m",
)
def leaderboard_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active first, then defaults, then the smaller error; a missing error counts as 9999."""
    from pyspark.sql import Window

    models = table(spark, sf_dir, "supplier").withColumns({"active": F.col("s_nationkey") % 2 == 0, "is_default": F.col("s_nationkey") % 5 == 0, "metric": F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))})
    order = Window.partitionBy(F.col("s_suppkey") % 4).orderBy(F.desc("active"), F.desc("is_default"), F.coalesce("metric", F.lit(9999.0)), "s_suppkey")
    return models.select("s_suppkey", F.row_number().over(order).cast("long").alias("place"))
