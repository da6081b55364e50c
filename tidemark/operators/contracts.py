"""What a published table or a rules document must keep: manifests, snapshots, registries, readiness. Results are rows, not log lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import nested_get
from tidemark.operators.relational import snapshot_diff

TOLERANCE = 1e-6


def scoped(df: DataFrame, label: str, **values) -> DataFrame:
    """The rows of one scope (a season and period, say); an error if there are none. Reads until the first row."""
    rows = reduce(lambda d, pair: d.where(F.col(pair[0]) == F.lit(pair[1])), values.items(), df)
    if rows.isEmpty():
        raise ValueError(f"{label} has no rows for {values}")
    return rows


def feature_columns(df: DataFrame, without: Sequence[str]) -> list[str]:
    """The columns that are features: all but the keys and the outcomes named."""
    return [c for c in df.columns if c not in set(without)]


def prediction_manifest(
    preview: DataFrame, chances: Sequence[str], components: Sequence[str], key: str = "player_id", appearance: str = "appearance_chance", start: str = "start_chance", minutes: Sequence[str] = ("expected_minutes", "minutes_low", "minutes_high"),
    points: str = "points", points_range: tuple[float, float] = (0.0, 15.0), position: str = "position", positions: Sequence[str] = ("GKP", "DEF", "MID", "FWD"), club: str = "club", keeper: str = "GKP", keeper_budget: float = 0.98, tolerance: float = TOLERANCE,
) -> DataFrame:
    """name, passed and value (double) of each check on published predictions.

    Counted are null and repeated keys, unknown positions, chances outside 0 to 1, starts above appearances, minutes
    outside 0 to 90 or their bounds, and points outside their range; measured are how far the components are from the points, and
    the largest share that a club's goalkeepers have together. One pass over the table and two small groupings.
    """
    c = F.col
    expected, low, high = minutes
    counted = {"null_keys": c(key).isNull(), "unknown_positions": ~F.coalesce(c(position).isin(*positions), F.lit(False))}
    counted |= {f"{x}_null": c(x).isNull() for x in chances} | {f"{x}_range": ~c(x).between(0, 1) for x in chances}
    counted |= {"start_above_appearance": c(start) > c(appearance) + tolerance, "minutes_null": c(expected).isNull() | c(low).isNull() | c(high).isNull(), "minutes_range": ~c(expected).between(0, 90)}
    counted |= {"low_above_minutes": c(low) > c(expected) + tolerance, "high_below_minutes": c(high) + tolerance < c(expected), "points_null": c(points).isNull()}
    counted |= {"points_range": ~c(points).between(points_range[0] - tolerance, points_range[1] + tolerance), "components_null": reduce(lambda a, b: a | b, (c(x).isNull() for x in components))}
    total = reduce(lambda a, b: a + b, map(F.col, components))
    found = preview.agg(*(F.count_if(cond).cast("double").alias(n) for n, cond in counted.items()), F.coalesce(F.max(F.abs(total - c(points))), F.lit(0.0)).alias("component_error"))
    entry = lambda n, limit: F.struct(F.lit(n).alias("name"), (c(n) <= limit).alias("passed"), c(n).alias("value"))
    rows = found.select(F.inline(F.array(*(entry(n, 0.0) for n in counted), entry("component_error", tolerance))))
    repeated = preview.where(c(key).isNotNull()).groupBy(key).count().agg(F.count_if(c("count") > 1).cast("double").alias("value"))
    shares = preview.where(c(position) == keeper).groupBy(club).agg(F.sum(appearance).alias("share")).agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("value"))
    one = lambda df, n, limit: df.select(F.lit(n).alias("name"), (c("value") <= limit).alias("passed"), "value")
    return rows.unionByName(one(repeated, "repeated_keys", 0.0)).unionByName(one(shares, "keeper_share", keeper_budget + tolerance))


def snapshot_rows(long: DataFrame, period: int, available: Column, required: Sequence[str], forbidden: Sequence[str] = (), key: str = "player_id") -> DataFrame:
    """The rows of one period as they may be published. The query fails on a row that is not available, lacks a value or is marked as it must not be; repeated keys show in the audit."""
    bad = reduce(lambda a, b: a | b, (F.col(x).isNull() for x in required), ~F.coalesce(available, F.lit(False)))
    bad = reduce(lambda a, b: a | F.coalesce(F.col(b), F.lit(False)), forbidden, bad)
    return long.where(F.col("period") == period).where(F.assert_true(~bad, "a row of the snapshot may not be published").isNull()).orderBy(key)


def snapshot_audit(long: DataFrame, period: int, available: Column, eligible: Column, required: Sequence[str], forbidden: Sequence[str] = (), key: str = "player_id") -> DataFrame:
    """One row: how many rows the period has, how many are eligible and available, and how many break each rule of a snapshot."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return long.where(F.col("period") == period).agg(
        F.count("*").alias("rows"),
        F.count_if(yes(eligible)).alias("eligible"),
        F.count_if(~yes(eligible)).alias("not_eligible"),
        F.count_if(yes(available)).alias("available"),
        (F.count("*") - F.count_distinct(key)).alias("repeated_keys"),
        *(F.count_if(F.col(x).isNull()).alias(f"missing_{x}") for x in required),
        *(F.count_if(yes(F.col(x))).alias(f"marked_{x}") for x in forbidden),
    )


def training_readiness(reports: DataFrame, training: str = "training", mapping: str = "mapping", join: str = "join") -> DataFrame:
    """Each row of three audit reports (JSON text) with what they allow together.

    A prior may be joined if the join's audit has passed, calls itself ready, writes nothing, has no blocker, keeps
    the row count and repeats no key. Training over several seasons also needs the training audit's own word and a mapping audit that has passed and writes nothing.
    """
    says = lambda doc, path, value: F.coalesce(nested_get(doc, path.split(".")) == value, F.lit(False))
    blockers = F.coalesce(nested_get(join, ["blockers"]), F.lit("[]"))
    clean = says(join, "passed", "true") & says(join, "ready_for_prior_feature_export", "true") & says(join, "writes_database", "false") & (F.regexp_replace(blockers, r"\s", "") == "[]")
    prior = clean & says(join, "join_summary.row_count_preserved", "true") & says(join, "join_summary.joined_feature_key_duplicate_count", "0")
    mapped = says(mapping, "passed", "true") & says(mapping, "writes_database", "false")
    return reports.withColumns({"prior_join_allowed": prior, "mapping_safe": mapped, "training_ready": prior & mapped & says(training, "multi_season_model_training_ready", "true")})


def upsert_known(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str], known: DataFrame, known_key: str, references: Sequence[str]) -> DataFrame:
    """One row: how many rows of `after` are inserted, updated and skipped as unchanged, and how many are left out because one of their references is unknown."""
    rows = after
    for c in references:
        name = known.select(F.col(known_key).alias(c), F.lit(True).alias(f"_{c}")).distinct()
        rows = rows.join(name, c, "left")
    lost = reduce(lambda a, b: a | b, (F.col(f"_{c}").isNull() for c in references))
    rows = rows.withColumn("_lost", lost)
    diff = snapshot_diff(before, rows.where("NOT _lost").select(*keys, *values), keys, values)
    n = lambda s: F.count_if(F.col("status") == s)
    counts = diff.agg(n("new").alias("inserted"), n("changed").alias("updated"), n("unchanged").alias("skipped"))
    return counts.crossJoin(rows.agg(F.count_if("_lost").alias("unknown")))  # one row each


def replaced(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`old` with all rows of each key that `new` has replaced by the new ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns).unionByName(new)
