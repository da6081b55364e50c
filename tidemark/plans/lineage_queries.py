"""Queries of projections, transfers, run records, registries and staging over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lineage as li
from tidemark.operators import picks as p
from tidemark.operators import rules as ru
from tidemark.operators.projection import project
from tidemark.plans.frames import PLAYER_POINTS, player_points
from tidemark.plans.game_queries import ROLES
from tidemark.plans.registry import query
from tidemark.sources import staging as st
from tidemark.sources.readers import table

PROJECTED = f"""{PLAYER_POINTS}, b AS (SELECT player_id, {ROLES} AS position, club, price / 1000.0::DOUBLE AS price, ['zero_sample', 'very_low_sample', 'low_sample', 'moderate_sample', 'reliable_sample', 'high_sample'][size % 6 + 1] AS tier, size % 7 <> 0 AS safe, size % 11 = 0 AS unscored, size % 4 = 1 AS thin, CASE WHEN size % 4 = 1 THEN CASE position WHEN 'SMALL' THEN 0.35 ELSE 0.65 END ELSE 1 END::DOUBLE AS less, size % 7 = 0 OR size % 6 < 2 AS unknown,
        least(games / 40.0::DOUBLE, 1.0) AS app, points / 101.0::DOUBLE AS p90, size / 97.0::DOUBLE AS g90, size / 193.0::DOUBLE AS a90, size / 149.0::DOUBLE AS b90, CASE WHEN size % 5 = 0 THEN 0.4::DOUBLE END AS chance,
        CASE WHEN size % 11 = 0 THEN 1.4::DOUBLE ELSE 1 + size % 3 * 0.5::DOUBLE END AS ours, CASE WHEN size % 11 = 0 THEN 1.4::DOUBLE ELSE 0.5 + size % 4 * 0.5::DOUBLE END AS theirs
        FROM player_points WHERE position IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY')),
    w AS (SELECT *, CASE WHEN safe THEN [0.0, 0.10, 0.20, 0.45, 0.70, 0.85][list_position(['zero_sample', 'very_low_sample', 'low_sample', 'moderate_sample', 'reliable_sample', 'high_sample'], tier)] ELSE 0 END::DOUBLE AS rw, CASE WHEN safe THEN [0.0, 0.0, 0.0, 0.35, 0.70, 0.85][list_position(['zero_sample', 'very_low_sample', 'low_sample', 'moderate_sample', 'reliable_sample', 'high_sample'], tier)] ELSE 0 END::DOUBLE AS pw,
        CASE WHEN unknown THEN 1.07 * CASE WHEN safe THEN [0.35, 0.50, 0.65, 0.85, 1.0, 1.0][list_position(['zero_sample', 'very_low_sample', 'low_sample', 'moderate_sample', 'reliable_sample', 'high_sample'], tier)] ELSE 0.75 END ELSE 1 END::DOUBLE AS load, CASE WHEN unknown THEN 0.95 ELSE 1 END::DOUBLE AS rs,
        (CASE WHEN safe THEN [40.0, 36.0, 32.0, 26.0, 20.0, 14.0][list_position(['zero_sample', 'very_low_sample', 'low_sample', 'moderate_sample', 'reliable_sample', 'high_sample'], tier)] ELSE 38.0 END + CASE WHEN thin THEN 6 ELSE 0 END + CASE WHEN unscored THEN 3 ELSE 0 END)::DOUBLE AS width,
        greatest(1e-9, exp(1.4 * (price - max(price) OVER (PARTITION BY club, position))) * (0.65 + 0.35 * app)) AS kw FROM b),
    k AS (SELECT *, CASE WHEN position = 'GKP' THEN 0.98 * kw / sum(kw) OVER (PARTITION BY club, position) END AS share FROM w),
    c AS (SELECT *, (rw * app + (1 - rw) * 0.5 * less) * load AS app0, (rw * app * 0.8 + (1 - rw) * 0.4 * less) * load AS start0, least(greatest((rw * app * 80 + (1 - rw) * 40 * less) * load, 0), 90) AS min0 FROM k),
    d AS (SELECT *, least(greatest(CASE WHEN position = 'GKP' THEN least(app0, share) ELSE app0 END, 0), 1) AS app1 FROM c),
    e AS (SELECT *, greatest(0, least(start0, app1)) AS start1, CASE WHEN position = 'GKP' THEN 90 * app1 ELSE min0 END AS min1, CASE WHEN chance < app1 THEN chance / app1 ELSE 1 END AS f FROM d),
    g AS (SELECT *, least(app1, coalesce(chance, app1)) AS app2, start1 * f AS start2, min1 * f AS min2, exp(-theirs) AS clean, least(greatest(ours / 1.4, 0.75), 1.25) AS atk, least(greatest(exp(-theirs) / 0.25, 0.75), 1.25) AS def,
        CASE position WHEN 'GKP' THEN 0.0 WHEN 'DEF' THEN 0.15 WHEN 'MID' THEN 0.40 ELSE 0.50 END::DOUBLE AS aw, CASE position WHEN 'GKP' THEN 0.35 WHEN 'DEF' THEN 0.35 WHEN 'MID' THEN 0.05 ELSE 0.0 END::DOUBLE AS dw FROM e),
    h AS (SELECT *, (pw * p90 + (1 - pw) * 22 / 7.0::DOUBLE) * rs * min2 / 90 * least(greatest(1 - aw - dw + aw * atk + dw * def, 0.85), 1.15) AS raw, app2 + start2 AS ap, (pw * g90 + (1 - pw) / 9.0::DOUBLE) * rs * min2 / 90 * atk * CASE position WHEN 'GKP' THEN 6 WHEN 'DEF' THEN 6 WHEN 'MID' THEN 5 ELSE 4 END AS gp,
        (pw * a90 + (1 - pw) / 11.0::DOUBLE) * rs * min2 / 90 * atk * 3 AS sp, clean * start2 * CASE position WHEN 'GKP' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END AS cp, (pw * b90 + (1 - pw) / 7.0::DOUBLE) * rs * min2 / 90 AS bp FROM g)"""
SHOWN = ("appearance_chance", "start_chance", "expected_minutes", "minutes_low", "minutes_high", "points", "guardrail", "appearance_points", "goal_points", "assist_points", "clean_sheet_points", "bonus_points", "other_points")
SHOWN_SQL = ("app2", "start2", "min2", "least(greatest(min2 - width, 0), 90)", "least(greatest(min2 + width, 0), 90)", "least(greatest(raw, 0), 15)", "least(greatest(raw, 0), 15) - raw", "ap", "gp", "sp", "cp", "bp", "least(greatest(raw, 0), 15) - ap - gp - sp - cp - bp")


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.try_element_at(F.create_map(*map(F.lit, ("SMALL", "GKP", "LARGE", "DEF", "PROMO", "MID", "ECONOMY", "FWD"))), F.col("position"))
    return player_points(spark, sf_dir).withColumn("position", role).where("position IS NOT NULL")


@query("m20_player_projection", f"WITH {PROJECTED} SELECT player_id, {', '.join(f'round({sql}, 6) AS {name}' for name, sql in zip(SHOWN, SHOWN_SQL))} FROM h")
def player_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir).select("player_id", *(F.round(c, 6).alias(c) for c in SHOWN))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, tiers = F.col("size"), F.array(*map(F.lit, ("zero_sample", "very_low_sample", "low_sample", "moderate_sample", "reliable_sample", "high_sample")))
    given = lambda c: F.when(size % 11 != 0, c)
    fallback = {"appearance": 0.5, "start": 0.4, "minutes_if_playing": 70.0, "minutes": 40.0, "points_per_90": 22 / 7, "goals_per_90": 1 / 9, "assists_per_90": 1 / 11, "bonus_per_90": 1 / 7}
    appearance = F.least(F.col("games") / 40.0, F.lit(1.0))
    rows = _roles(spark, sf_dir).withColumns({
        "price": F.col("price") / 1000.0, "tier": F.get(tiers, (size % 6).cast("int")), "safe_prior": size % 7 != 0, "position_only": size % 4 == 1, "unknown_role": (size % 7 == 0) | (size % 6 < 2),
        "appearance": appearance, "start": appearance * 0.8, "minutes_if_playing": F.lit(80.0), "minutes": appearance * 80,
        "points_per_90": F.col("points") / 101.0, "goals_per_90": size / 97.0, "assists_per_90": size / 193.0, "bonus_per_90": size / 149.0,
        "minutes_signal": F.lit(1.07), "rate_signal": F.lit(0.95), "chance": F.when(size % 5 == 0, 0.4),
        "team_goals": given(1 + size % 3 * 0.5), "opponent_goals": given(0.5 + size % 4 * 0.5),
    } | {f"fallback_{k}": F.lit(v) for k, v in fallback.items()})
    return project(rows, 1.4, 0.25)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir).select("player_id", "position", "club", F.floor(F.col("price") / 200).alias("price"), "points")


TRANSFERS = f"""{PLAYER_POINTS}, pool AS (SELECT player_id, {ROLES} AS position, club, price // 200 AS price FROM player_points WHERE position IN ('SMALL', 'LARGE', 'PROMO', 'ECONOMY')),
    cur AS (SELECT player_id % 13 AS squad_id, * FROM pool WHERE player_id % 3 = 0), outs AS (SELECT squad_id, player_id FROM cur WHERE player_id % 4 = 0 UNION ALL SELECT player_id % 13, player_id FROM pool WHERE player_id % 50 = 1),
    ins AS (SELECT player_id % 13 AS squad_id, * FROM pool WHERE player_id % 12 = 4 OR player_id % 60 = 3),
    keep AS (SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM outs WHERE outs.squad_id = cur.squad_id AND outs.player_id = cur.player_id)), aft AS (SELECT * FROM keep UNION ALL SELECT * FROM ins)"""


def _broken(frame: str) -> str:
    return f"""(SELECT squad_id, count(*) <> 15 OR count(DISTINCT player_id) <> count(*) OR count(*) FILTER (position = 'GKP') <> 2 OR count(*) FILTER (position = 'DEF') <> 5 OR count(*) FILTER (position = 'MID') <> 5 OR count(*) FILTER (position = 'FWD') <> 3
        OR sum(price) > 1000 OR (SELECT max(n) FROM (SELECT count(*) AS n FROM {frame} i WHERE i.squad_id = {frame}.squad_id GROUP BY club)) > 3 AS bad FROM {frame} GROUP BY squad_id)"""


@query(
    "e06_transfer_legality",
    f"""WITH {TRANSFERS}, o AS (SELECT squad_id, count(*) AS n, count(*) FILTER (player_id NOT IN (SELECT player_id FROM cur)) AS lost FROM outs GROUP BY 1), i AS (SELECT squad_id, count(*) AS n, count(*) FILTER (player_id IN (SELECT player_id FROM keep)) AS own FROM ins GROUP BY 1)
    SELECT b.squad_id, greatest(coalesce(i.n, 0), coalesce(o.n, 0)) AS transfers, concat_ws('|', CASE WHEN b.bad THEN 'squad_before' END, CASE WHEN o.lost > 0 THEN 'outgoing_not_owned' END, CASE WHEN coalesce(i.n, 0) <> coalesce(o.n, 0) THEN 'counts_differ' END,
           CASE WHEN i.own > 0 THEN 'incoming_owned' END, CASE WHEN coalesce(a.bad, true) THEN 'squad_after' END) AS errors
    FROM {_broken("cur")} b LEFT JOIN {_broken("aft")} a USING (squad_id) LEFT JOIN o USING (squad_id) LEFT JOIN i USING (squad_id)""",
)
def transfer_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _candidates(spark, sf_dir).withColumn("squad_id", F.col("player_id") % 13)
    current = pool.where("player_id % 3 = 0")
    outgoing = current.where("player_id % 4 = 0").unionByName(pool.where("player_id % 50 = 1"))
    return ru.transfer_legality(current, outgoing, pool.where("player_id % 12 = 4 OR player_id % 60 = 3")).select("squad_id", "transfers", F.concat_ws("|", "errors").alias("errors"))


@query("r04_wildcard")
def wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A squad for five periods, whose points are the units sold in them; captain by the first period."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("player_id"), (F.col("l_linenumber").cast("long")).alias("period")).agg(F.sum("l_quantity").alias("points"))
    horizon = _candidates(spark, sf_dir).drop("points").join(sold, "player_id").withColumn("scenario", F.lit("all"))
    return p.wildcard_squads(horizon, 1, 5)


RUNS = """runs AS (SELECT event_id, ['feature', 'model', 'prediction', 'other'][event_id % 4 + 1] AS run_type, upper(event_type) || '.v1_2-x' AS artifact, '2024_25' AS season, CASE WHEN event_id % 3 > 0 THEN event_id % 38 + 1 END AS period, CASE WHEN event_id % 3 = 2 THEN 5 END AS horizon,
    ts AS created_at, ts + INTERVAL 1 HOUR * CAST(event_id % 5 - 3 AS INTEGER) AS as_of FROM events)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kinds = F.array(*map(F.lit, ("feature", "model", "prediction", "other")))
    hours = F.make_dt_interval(F.lit(0), (n % 5 - 3).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(kinds, (n % 4).cast("int")).alias("run_type"), F.concat(F.lit(" ."), F.upper("event_type"), F.lit(".v1_2 / x-")).alias("artifact"), F.lit("2024_25").alias("season"), F.when(n % 3 > 0, n % 38 + 1).alias("period"), F.when(n % 3 == 2, 5).alias("horizon"), F.col("ts").alias("created_at"), (F.col("ts") + hours).alias("as_of"))
    return rows.withColumn("run_id", li.run_id())


@query(
    "v24_run_ids",
    f"""WITH {RUNS}, s AS (SELECT event_id, run_type, artifact, season, coalesce('gw' || period, 'season') AS gw, strftime(created_at, '%Y%m%dT%H%M%S%fZ') AS t FROM runs)
    SELECT event_id, concat_ws('_', artifact, season, gw, t, substr(sha256(concat_ws('|', run_type, artifact, season, gw, t)), 1, 8)) AS run_id FROM s""",
)
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("event_id", "run_id")


@query(
    "v24_run_problems",
    f"""WITH {RUNS} SELECT event_id, concat_ws('|', CASE WHEN run_type = 'other' THEN 'unknown_run_type' END, CASE WHEN run_type IN ('feature', 'prediction') AND period IS NULL THEN 'period_required' END, CASE WHEN period IS NOT NULL AND horizon IS NULL THEN 'horizon_required' END,
        CASE WHEN period + horizon - 1 > 38 THEN 'horizon_too_long' END, CASE WHEN as_of > created_at THEN 'as_of_after_created' END, CASE WHEN run_type = 'model' THEN 'model_version_required' END, CASE WHEN run_type = 'prediction' THEN 'model_version_required' END) AS problems FROM runs""",
)
def run_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {v: F.lit("v1") for v in ("feature_version", "artifact_version", "manifest_version", "rules_versions")} | {"model_version": F.lit(None).cast("string"), "source_season": F.lit("2023_24"), "parents": F.array().cast("array<string>")}
    times = {t: F.lit(None).cast("timestamp_ntz") for t in ("started_at", "completed_at")}
    return li.run_problems(_runs(spark, sf_dir).withColumns(given | times)).select("event_id", F.concat_ws("|", "problems").alias("problems"))


@query("m25_latest_runs", f"WITH {RUNS} SELECT run_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_type ORDER BY created_at DESC, event_id DESC) AS n FROM runs) WHERE n = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.latest_runs(_runs(spark, sf_dir).withColumn("run_id", F.col("event_id")), ["run_type"]).select("run_type", "event_id")


@query("m26_missing_features", """SELECT 'identity' AS feature_set, 'c_phone' AS missing, false AS complete UNION ALL SELECT 'money', '', true""")
def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([("identity", ["c_custkey", "c_name", "c_phone"]), ("money", ["c_acctbal"])], "feature_set string, columns array<string>")
    return li.missing_features(required, table(spark, sf_dir, "customer").columns).withColumn("missing", F.concat_ws("|", "missing"))


@query("v23_adapted_rows", "SELECT doc_id AS id, lang AS label, 'v1' AS version, quality = 0 OR toxic = 1 AS fallback_used, CASE WHEN quality = 0 OR toxic = 1 THEN toxic END AS fallback_level FROM documents JOIN labels USING (doc_id)")
def adapted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("policy", F.when(F.col("quality") == 0, "position_only").otherwise(" None "))
    return li.adapt(rows, {"id": "doc_id", "label": "lang", "version": "absent"}, {"version": "v1"}, policy="policy", level="toxic")


@query("p20_player_pool", "SELECT c_custkey AS player_id, c_nationkey::BIGINT AS team_id, upper(c_mktsegment) AS position, round(c_acctbal / 100, 6) AS chance, CASE WHEN NOT c_acctbal / 100 BETWEEN 0 AND 100 THEN 'chance_out_of_range' END AS problem FROM customer")
def player_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    raw = table(spark, sf_dir, "customer").select(c("c_custkey").alias("player_id"), c("c_name").alias("name"), c("c_nationkey").alias("team_id"), c("c_mktsegment").alias("position"), c("c_acctbal").alias("price"), F.lit(" a ").alias("status"), (c("c_acctbal") / 100).alias("chance"), F.lit("true").alias("eligible"))
    return st.player_pool(raw).select("player_id", "team_id", "position", F.round("chance", 6).alias("chance"), "problem")


@query("p21_staging_rows", "SELECT '2024_25' AS season, CAST(o_custkey AS VARCHAR) AS raw_id, o_orderstatus AS status, o_orderkey AS points, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS canonical_id, CASE WHEN o_orderkey % 5 > 0 THEN 'mapped' ELSE 'unmapped' END AS mapping_status FROM orders")
def staging_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("raw_id"), F.concat(F.lit(" "), "o_orderstatus").alias("status"), F.col("o_orderkey").cast("string").alias("points"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey").cast("string")).otherwise("nan").alias("canonical_id"))
    return st.staging_rows(raw, "2024_25", ["raw_id"], ["status"], {"points": "long"}, "canonical_id")


@query(
    "p22_mapping_template",
    "WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) SELECT CAST(o_custkey AS VARCHAR) AS raw_id, arg_min(o_orderpriority, (-n, o_orderpriority)) AS name, CAST(sum(n) AS BIGINT) AS rows FROM n GROUP BY 1",
)
def mapping_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("raw_id"), F.col("o_orderpriority").alias("name"))
    return st.mapping_template(raw, "raw_id", "name").select("raw_id", "name", "rows")


@query("k19_mapped_rows", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey + 1000 ELSE o_custkey END AS canonical_id FROM orders")
def mapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("raw_id"), (F.col("c_custkey") + 1000).alias("canonical_id"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("raw"))
    return st.mapped(rows, mapping, "raw", "canonical_id", direct=True).select("o_orderkey", "canonical_id")
