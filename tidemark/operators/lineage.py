"""Runs, models and snapshots as tables: ids, rules that a run's record must meet, registries, adapters."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import season_start, season_valid
from tidemark.sources import versions

LAST_PERIOD = 38
#: The versions that a run of each type must name.
REQUIRED_VERSIONS = {
    "feature": ("feature_version", "artifact_version"),
    "model": ("feature_version", "model_version", "artifact_version"),
    "prediction": ("feature_version", "model_version", "manifest_version", "artifact_version", "rules_versions"),
    "evaluation": ("model_version", "manifest_version", "artifact_version"),
    "optimization": ("model_version", "manifest_version", "artifact_version", "rules_versions"),
    "publishing": ("manifest_version", "artifact_version"),
}

#: The types of runs that are for a period.
PERIOD_REQUIRED = ("feature", "prediction", "evaluation", "optimization", "publishing")


def slug(c: Column) -> Column:
    """A dash for each run of characters other than letters, digits, dot, underscore and dash; none of the last three at the ends."""
    return F.trim(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "-"), F.lit("-._"))


def run_id(kind: str = "run_type", artifact: str = "artifact", season: str = "season", period: str = "period", created: str = "created_at") -> Column:
    """artifact_season_period_time_digest: the same record has the same id on every run. `created` is a time in UTC."""
    artifact_part = slug(F.coalesce(artifact, kind))
    period_part = F.coalesce(F.concat(F.lit("gw"), F.col(period).cast("string")), F.lit("season"))
    time = F.date_format(created, "yyyyMMdd'T'HHmmssSSSSSS'Z'")
    digest = F.substring(F.sha2(F.concat_ws("|", F.col(kind), artifact_part, F.col(season), period_part, time), 256), 1, 8)
    return F.concat_ws("_", artifact_part, F.col(season), period_part, time, digest)


def run_problems(runs: DataFrame, last_period: int = LAST_PERIOD) -> DataFrame:
    """Each run with the rules that its record breaks.

    `runs` has run_id, run_type, season (YYYY_YY), source_season (the latest), period, horizon, as_of, created_at,
    started_at, completed_at, parents (ids) and the version columns. A missing time breaks no order.
    """
    c = F.col
    version_missing = [F.when((c("run_type") == kind) & (c(v).isNull() | (c(v) == "")), F.lit(f"{v}_required")) for kind, names in REQUIRED_VERSIONS.items() for v in names]
    rules = {
        "unknown_run_type": ~F.coalesce(c("run_type").isin(*REQUIRED_VERSIONS), F.lit(False)),
        "season_format": ~season_valid("season"),
        "source_after_target": season_start("source_season") > season_start("season"),
        "period_required": c("run_type").isin(*PERIOD_REQUIRED) & c("period").isNull(),
        "horizon_required": c("period").isNotNull() & c("horizon").isNull(),
        "horizon_without_period": c("period").isNull() & c("horizon").isNotNull(),
        "horizon_too_long": c("period") + c("horizon") - 1 > last_period,
        "as_of_after_created": c("as_of") > c("created_at"),
        "started_after_completed": c("started_at") > c("completed_at"),
        "started_after_created": c("started_at") > c("created_at"),
        "completed_after_created": c("completed_at") > c("created_at"),
        "own_parent": F.array_contains("parents", c("run_id")),
    }
    found = F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items()), *version_missing)
    problems = F.filter(found, lambda x: x.isNotNull())
    return runs.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0)


def compatible(models: DataFrame, task: str, mode: str, versions: Mapping[str, str], production_only: bool = False) -> DataFrame:
    """Models for a task and mode whose every feature version is the given one. `models` has task, modes, features (map), status, production_ready."""
    have = F.create_map(*(F.lit(x) for pair in (versions or {"": ""}).items() for x in pair))
    same = F.forall(F.map_entries("features"), lambda e: have[e["key"]].eqNullSafe(e["value"]))
    rows = models.where((F.col("task") == task) & F.array_contains("modes", mode) & same & ~F.col("status").isin("deprecated", "archived"))
    return rows.where("production_ready") if production_only else rows


def default_problems(models: DataFrame) -> DataFrame:
    """Tasks and modes that have more than one default, with how many."""
    rows = models.where("is_default").select("task", F.explode("modes").alias("mode"))
    return rows.groupBy("task", "mode").agg(F.count("*").alias("defaults")).where("defaults > 1")


def missing_features(required: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature sets with the required columns that a table lacks. `required` has feature_set, columns (array)."""
    lost = F.array_sort(F.array_except("columns", F.array(*map(F.lit, columns)).cast("array<string>")))
    return required.select("feature_set", lost.alias("missing"), (F.size(lost) == 0).alias("complete"))


def latest_runs(runs: DataFrame, keys: Sequence[str], created: str = "created_at") -> DataFrame:
    """The last run of each key; of equal times the larger id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(created), F.desc("run_id")))
    return runs.withColumn("_place", place).where("_place = 1").drop("_place")


def snapshot(df: DataFrame, path: str, record: Mapping[str, str]) -> DataFrame:
    """Write a table to a new path and give its record: what was passed, the path, rows and columns. Rows are counted while they are written."""
    counted = Observation("snapshot")
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    fields = {**record, "path": path, "rows": counted.get["rows"], "columns": len(df.columns)}
    return df.sparkSession.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items()))


def publish_snapshot(df: DataFrame, folder: str, record: Mapping[str, str]) -> int:
    """Write a table beside the earlier snapshots of a folder, count it while it is written, and publish its record as the folder's next version.

    Two exporters at once give two versions; neither loses the other's.
    """
    path = f"{folder}/data/{uuid.uuid4().hex}"
    counted = Observation("snapshot")
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    return versions.publish(df.sparkSession, f"{folder}/versions", {**record, "path": path, "rows": counted.get["rows"], "columns": len(df.columns)})


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all snapshots of a folder, with version and is_current: version, path, rows, columns and what was passed (a map)."""
    known = ("path", "rows", "columns")
    found = [(n, r := versions.read(spark, f"{folder}/versions", n)) for n in versions.numbers(spark, f"{folder}/versions")]
    last = max((n for n, _ in found), default=0)
    rows = [(n, n == last, r["path"], r["rows"], r["columns"], {k: str(v) for k, v in r.items() if k not in known}) for n, r in found]
    return spark.createDataFrame(rows, "version long, is_current boolean, path string, rows long, columns long, record map<string,string>")


#: Policies that say that no fallback was used.
NO_FALLBACK = ("", "none", "no_fallback", "not_used", "full_prior")


def adapt(rows: DataFrame, names: Mapping[str, str], defaults: Mapping[str, object] | None = None, policy: str = "fallback_policy", level: str = "fallback_level") -> DataFrame:
    """Rows of an older layout in the present one.

    `names` maps present names to old ones; a column that is absent takes its default, null if it has none.
    `fallback_used` follows from the old level and policy, and the level is kept only where it was used.
    """
    defaults = dict(defaults or {})
    column = lambda old, new: F.coalesce(F.col(old), F.lit(defaults.get(new))) if old in rows.columns else F.lit(defaults.get(new))
    text = F.lower(F.trim(F.coalesce(F.col(policy), F.lit("")))) if policy in rows.columns else F.lit("")
    number = F.coalesce(F.col(level), F.lit(0)) if level in rows.columns else F.lit(0)
    used = (number > 0) | ~text.isin(*NO_FALLBACK)
    return rows.select(*(column(old, new).alias(new) for new, old in names.items()), used.alias("fallback_used"), F.when(used, number).alias("fallback_level"))
