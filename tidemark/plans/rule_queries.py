"""Queries of the scoring rules as a table."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rulebook as rb
from tidemark.plans.frames import USER_DAYS, user_days
from tidemark.plans.registry import query
from tidemark.sources.readers import table

#: Points by position of goals and clean sheets.
GOALS = {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEETS = {"GKP": 4, "DEF": 4, "MID": 1, "FWD": 0}


def rules_document(season: str, changes: Mapping[str, object] | None = None) -> str:
    """A valid document of scoring rules, with some values replaced by path."""
    document: dict = {}
    values = dict(rb.REQUIRED) | {
        "effective_season": season,
        "rules_version": f"{season}_v1",
        "status": "checked",
        "source_notes": ["a note"],
        "scoring.assists.definition_version": "v1",
        "scoring.goals.points_by_position": GOALS,
        "scoring.clean_sheets.points_by_position": CLEAN_SHEETS,
        "deterministic_examples": [{"id": f"example {p}", "position": p, "events": {"minutes": 90}, "expected_total_points": 2} for p in rb.POSITIONS],
    }
    for path, value in (values | dict(changes or {})).items():
        *above, last = path.split(".")
        level = document
        for key in above:
            level = level.setdefault(key, {})
        level[last] = value
    return json.dumps(document)


#: What is replaced in a document, by what, and when. The text is read by both engines.
SPOILT = (
    ('"competition": "FPL"', '"competition": "other"', "c_nationkey % 5 = 0"),
    ('{"eligible_positions": ["GKP", "DEF"], "per_goals": 2, "points": -1}', "{}", "c_nationkey % 7 = 1"),
    ('"assists": {"points": 3', '"assists": {"points": "3"', "c_custkey % 3 = 0"),
    ('{"1": 3, "2": 2, "3": 1}', '{"3": 1, "2": 2, "1": 3}', "c_custkey % 4 = 1"),
    ('{"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4}', '{"GKP": 10, "DEF": 6, "MID": 5}', "c_custkey % 6 = 2"),
    ('"2025_26"', '"2025_27"', "c_custkey % 11 = 0"),
    ('"max_minutes": null, "points": 2', '"max_minutes": null, "points": 3', "c_custkey % 8 = 3"),
    ('"status": "checked"', '"status": "  "', "c_custkey % 9 = 4"),
    ('"position": "FWD"', '"position": "MID"', "c_custkey % 13 = 5"),
    ('"threshold": 10', '"threshold": 11', "c_nationkey % 3 = 2"),
    ('"bonus": {', '"bonus_points": {', "c_custkey % 17 = 6"),
)


def _spoilt_sql() -> str:
    out = f"'{rules_document('2025_26')}'"
    for old, new, when in SPOILT:
        out = f"replace({out}, '{old}', CASE WHEN {when} THEN '{new}' ELSE '{old}' END)"
    return out


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


@query(
    "e10_registry_problems",
    f"""WITH d AS (SELECT c_custkey, CAST({_spoilt_sql()} AS JSON) AS j FROM customer),
    found AS (SELECT c_custkey, concat_ws('|',
        CASE WHEN NOT list_contains(list_transform(CAST(j->'$.deterministic_examples' AS JSON[]), lambda e: e->>'$.position'), 'FWD') THEN 'examples.FWD' END,
        CASE WHEN list_sort(json_keys(j, '$.scoring.goals.points_by_position')) <> ['DEF', 'FWD', 'GKP', 'MID'] THEN 'kind.scoring.goals.points_by_position' END,
        CASE WHEN trim(j->>'$.status') = '' THEN 'kind.status' END,
        CASE WHEN NOT json_exists(j, '$.scoring.bonus') THEN 'missing.scoring.bonus' END,
        CASE WHEN j->>'$.competition' <> 'FPL' THEN 'wrong.competition' END,
        CASE WHEN CAST(right(j->>'$.effective_season', 2) AS INT) <> CAST(substr(j->>'$.effective_season', 3, 2) AS INT) + 1 THEN 'wrong.effective_season' END,
        CASE WHEN CAST(j->'$.scoring.appearance.bands[0].points' AS INT) <> 1 OR CAST(j->'$.scoring.appearance.bands[1].points' AS INT) <> 2 THEN 'wrong.scoring.appearance.bands' END,
        CASE WHEN json_type(j, '$.scoring.assists.points') <> 'UBIGINT' OR j->>'$.scoring.assists.points' <> '3' THEN 'wrong.scoring.assists.points' END,
        CASE WHEN json_exists(j, '$.scoring.bonus') AND (j->>'$.scoring.bonus.rank_points."1"' <> '3' OR j->>'$.scoring.bonus.rank_points."3"' <> '1') THEN 'wrong.scoring.bonus.rank_points' END,
        CASE WHEN j->>'$.scoring.defensive_contributions.by_position.DEF.threshold' <> '10' THEN 'wrong.scoring.defensive_contributions.by_position.DEF.threshold' END,
        CASE WHEN NOT json_exists(j, '$.scoring.goals_conceded.eligible_positions') THEN 'wrong.scoring.goals_conceded.eligible_positions' END,
        CASE WHEN NOT json_exists(j, '$.scoring.goals_conceded.per_goals') THEN 'wrong.scoring.goals_conceded.per_goals' END,
        CASE WHEN NOT json_exists(j, '$.scoring.goals_conceded.points') THEN 'wrong.scoring.goals_conceded.points' END) AS problems FROM d)
    SELECT c_custkey, problems, problems = '' AS valid FROM found""",
)
def document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for every customer, spoilt in up to eleven places (one of which does no harm), read by JSON paths on both sides."""
    keys = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition(_tasks(spark))  # a small file is one task's, whose documents are not small
    documents = keys.select("c_custkey", F.expr(_spoilt_sql()).alias("document"))
    return rb.document_problems(documents).select("c_custkey", F.array_join("problems", "|").alias("problems"), "valid")


SEASONS = "CASE WHEN day <= 12 THEN '2025_26' WHEN day <= 24 THEN '2026_27' ELSE '2027_28' END"
POSITION = "CASE user_id % 5 WHEN 0 THEN 'GKP' WHEN 1 THEN 'DEF' WHEN 2 THEN 'MID' WHEN 3 THEN 'FWD' ELSE 'COACH' END"


@query(
    "e01_scored_by_rules",
    f"""WITH {USER_DAYS}, m AS (SELECT *, {SEASONS} AS season, {POSITION} AS position, minutes * 20 AS played, CASE WHEN {POSITION} = 'GKP' THEN saves ELSE 0 END AS kept, cards // 3 AS red FROM user_days),
    p AS (SELECT *, CASE WHEN position = 'COACH' THEN 'unknown_position' WHEN season = '2027_28' THEN 'no_rules' WHEN day % 5 > CASE season WHEN '2025_26' THEN 3 ELSE 4 END THEN 'bonus_not_given' END AS problem,
        goals * CASE position WHEN 'GKP' THEN 10 WHEN 'DEF' THEN 6 WHEN 'MID' THEN CASE season WHEN '2025_26' THEN 5 ELSE 7 END ELSE 4 END AS goal_points,
        assists * CASE season WHEN '2025_26' THEN 3 ELSE 2 END AS assist_points,
        CASE WHEN red > 0 THEN red * -3 ELSE cards * -1 END AS card_points,
        CASE WHEN position = 'GKP' THEN kept // CASE season WHEN '2025_26' THEN 3 ELSE 2 END ELSE 0 END AS save_points,
        CASE WHEN played >= 60 THEN 2 WHEN played >= 1 THEN 1 ELSE 0 END AS appearance_points,
        CASE WHEN assists = 0 AND played >= 60 THEN CASE position WHEN 'GKP' THEN 4 WHEN 'DEF' THEN 4 WHEN 'MID' THEN 1 ELSE 0 END ELSE 0 END AS clean_points,
        CASE WHEN position IN ('GKP', 'DEF') THEN -(assists // 2) ELSE 0 END AS conceded_points,
        CASE WHEN (position = 'DEF' AND minutes * 3 >= 10) OR (position IN ('MID', 'FWD') AND minutes * 3 >= 12) THEN 2 ELSE 0 END AS contribution_points FROM m)
    SELECT user_id, day, problem, CASE WHEN problem IS NULL THEN CAST(goal_points AS BIGINT) END AS goal_points, CASE WHEN problem IS NULL THEN CAST(save_points AS BIGINT) END AS save_points,
        CASE WHEN problem IS NULL THEN CAST(appearance_points + goal_points + assist_points + clean_points + save_points + card_points + conceded_points + day % 5 + contribution_points AS BIGINT) END AS total_points FROM p""",
)
def scored_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as matches of three seasons: two have a document (the second pays other points and one bonus point more), one has none."""
    other = {"scoring.goals.points_by_position": GOALS | {"MID": 7}, "scoring.assists.points": 2, "scoring.saves.per_saves": 2, "scoring.bonus.allowed_player_points": [0, 1, 2, 3, 4]}
    documents = spark.createDataFrame([(rules_document("2025_26"),), (rules_document("2026_27", other),)], "document string")
    days, keeper = user_days(spark, sf_dir), F.col("position") == "GKP"
    rows = days.withColumns({"season": F.expr(SEASONS), "position": F.expr(POSITION)}).select(
        "user_id", "day", "season", "position", (F.col("minutes") * 20).alias("minutes"), "goals", "assists", F.when(keeper, F.col("saves")).otherwise(0).alias("saves"), F.lit(0).alias("penalty_saves"), F.col("cards").alias("yellow_cards"),
        F.floor(F.col("cards") / 3).alias("red_cards"), F.lit(0).alias("own_goals"), F.lit(None).cast("long").alias("penalty_misses"), F.col("assists").alias("goals_conceded_for_scoring"), (F.col("day") % 5).alias("bonus_points"),
        (F.col("minutes") * 3).alias("defensive_contributions"), (F.col("assists") == 0).alias("clean_sheet"), F.lit(False).alias("acted_as_goalkeeper"),
    )
    scored = rb.score_by_rules(rows, rb.rule_rows(documents))
    counted = lambda c: F.when(F.col("problem").isNull(), F.col(c)).alias(c)
    return scored.select("user_id", "day", "problem", counted("goal_points"), counted("save_points"), "total_points")
