"""Entities over a horizon of coming periods: grids with blanks and doubles, eligibility, predictions that may be missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import kickoff
from tidemark.operators.relational import grid

DISCOUNTS = (1.0, 0.85, 0.70, 0.55, 0.40)


def fixture_flags(fixtures: DataFrame, first: int, last: int) -> DataFrame:
    """Fixtures with a flag for each thing that makes one invalid, and `valid` if there is none.

    `fixtures` has match_id, season, period, kickoff, home_id, away_id.
    """
    repeated = F.count(F.lit(1)).over(Window.partitionBy("match_id")) > 1
    natural = F.count(F.lit(1)).over(Window.partitionBy("season", "home_id", "away_id", "period")) > 1
    rows = fixtures.withColumns({"repeated_id": repeated, "repeated_pair": natural, "self_match": F.col("home_id") == F.col("away_id"), "no_kickoff": F.col("kickoff").isNull(), "out_of_scope": ~F.coalesce(F.col("period").between(first, last), F.lit(False))})
    return rows.withColumn("valid", ~(F.col("repeated_id") | F.col("self_match") | F.col("out_of_scope")))


#: What stops a horizon, and what only has to be told, by the counts of `horizon_report`.
BLOCKERS = ("missing_identity", "unknown_team", "self_match", "repeated_id", "repeated_key", "repeated_pairing", "missing_periods")
WARNINGS = ("missing_kickoff", "invalid_kickoff", "changed_kickoff", "newly_known_kickoff", "lost_kickoff", "removed", "started", "finished")


def horizon_report(fixtures: DataFrame, teams: DataFrame, first: int, last: int, before: DataFrame | None = None) -> DataFrame:
    """One row: what is wrong with the fixtures of a horizon, as counts, with blockers, warnings (names of counts that are not 0) and passed.

    `fixtures` has match_id, season, period, kickoff (text in ISO 8601), home_id, away_id, started, finished; `teams` has team_id; `before` is the horizon as it was,
    with match_id and kickoff. A row that repeats an id, a season's period and sides, or a pair of teams in any order counts, as does each of its like.
    Without `before` the warnings say no_comparison.
    """
    at, status = kickoff("kickoff")
    size = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy(*keys))
    pair = (F.least("home_id", "away_id"), F.greatest("home_id", "away_id"))
    rows = fixtures.withColumns({"_status": status, "_at": at, "_ids": size("match_id"), "_keys": size("season", "period", "home_id", "away_id"), "_pairs": size("season", "period", *pair)})
    known = teams.select(F.col("team_id").alias("_team"), F.lit(True).alias("_known")).distinct()
    for side in ("home", "away"):
        rows = rows.join(known.withColumnsRenamed({"_team": f"_{side}", "_known": f"_{side}_known"}), F.col(f"{side}_id") == F.col(f"_{side}"), "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    unknown = (F.col("home_id").isNotNull() & F.col("_home_known").isNull()) | (F.col("away_id").isNotNull() & F.col("_away_known").isNull())
    missing = F.col("match_id").isNull() | F.col("home_id").isNull() | F.col("away_id").isNull() | F.col("period").isNull()
    counts = {
        "missing_identity": missing, "unknown_team": unknown, "self_match": F.col("home_id") == F.col("away_id"),
        "repeated_id": (F.col("_ids") > 1) & F.col("match_id").isNotNull(), "repeated_key": (F.col("_keys") > 1) & ~missing, "repeated_pairing": (F.col("_pairs") > 1) & ~missing,
        "missing_kickoff": F.col("_status") == "missing", "invalid_kickoff": F.col("_status") == "invalid", "started": F.col("started"), "finished": F.col("finished"),
    }
    found = F.array_sort(F.collect_set(F.when(F.col("period").between(first, last), F.col("period").cast("long"))))
    out = rows.agg(F.count("*").alias("fixtures"), found.alias("periods"), *(F.count_if(yes(c)).alias(n) for n, c in counts.items()))
    out = out.withColumn("missing_periods", F.size(F.array_except(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), "periods")).cast("long"))
    if before is None:
        out = out.withColumns({c: F.lit(0).cast("long") for c in ("changed_kickoff", "newly_known_kickoff", "lost_kickoff", "removed")})
    else:
        was, _ = kickoff("kickoff")
        old, new = before.select("match_id", was.alias("_was"), F.lit(True).alias("_there")), rows.select("match_id", F.col("_at").alias("_is"), F.lit(True).alias("_here"))
        both = old.join(new, "match_id", "full")
        stays = F.col("_there") & F.col("_here")
        changes = {"changed_kickoff": stays & (F.col("_was") != F.col("_is")), "newly_known_kickoff": stays & F.col("_was").isNull() & F.col("_is").isNotNull(), "lost_kickoff": stays & F.col("_was").isNotNull() & F.col("_is").isNull(), "removed": F.col("_here").isNull()}
        out = out.crossJoin(F.broadcast(both.agg(*(F.count_if(yes(c)).alias(n) for n, c in changes.items()))))  # one row each
    named = lambda names: F.filter(F.array(*(F.when(F.col(n) > 0, n) for n in names)), lambda x: x.isNotNull())
    warnings = named(WARNINGS) if before is not None else F.concat(named(WARNINGS), F.array(F.lit("no_comparison")))
    return out.withColumns({"blockers": named(BLOCKERS), "warnings": warnings}).withColumn("passed", F.size("blockers") == 0)


def side_sequence(sides: DataFrame) -> DataFrame:
    """Sides with their number within the team's period, how many there are, and the double flag."""
    w = Window.partitionBy("team_id", "period")
    return sides.withColumns({"sequence": F.row_number().over(w.orderBy("kickoff", "match_id")), "in_period": F.count(F.lit(1)).over(w)}).withColumn("double", F.col("in_period") > 1)


def team_weeks(teams: DataFrame, sides: DataFrame, first: int, last: int) -> DataFrame:
    """Every team in every period: fixtures, opponents in order, and blank, single or double."""
    played = sides.where(F.col("period").between(first, last)).groupBy("team_id", "period").agg(F.count("*").alias("fixtures"), F.array_sort(F.collect_list("opponent_id")).alias("opponents"))
    rows = grid(teams.select("team_id"), first, last).join(played, ["team_id", "period"], "left").withColumn("fixtures", F.coalesce("fixtures", F.lit(0)))
    kind = F.when(F.col("fixtures") == 0, "blank").when(F.col("fixtures") == 1, "single").otherwise("double")
    return rows.withColumn("kind", kind)


def period_summary(weeks: DataFrame) -> DataFrame:
    """Blank, single and double teams, and sides, of each period."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return weeks.groupBy("period").agg(F.sum("fixtures").alias("sides"), n("blank"), n("single"), n("double"))


def _predicted(cells: DataFrame, predictions: DataFrame) -> DataFrame:
    known = predictions.select("player_id", "period", F.col("points").alias("points"), F.lit(True).alias("_known"))
    return cells.join(known, ["player_id", "period"], "left")


def eligibility(players: DataFrame, sides: DataFrame, first: int, last: int, predictions: DataFrame | None = None) -> DataFrame:
    """Players in every period with each of their team's fixtures, or one row without one in a blank period.

    `players` has player_id, team_id, selectable. `reason` is the first that holds. `predictions` are those of `long_horizon`, which then needs none:
    a player's period meets its prediction before the team's fixtures multiply it, so what they multiply is not dealt again.
    """
    cells = grid(players.select("player_id", "team_id", "selectable"), first, last)
    if predictions is not None:
        cells = _predicted(cells, predictions)
    rows = cells.join(sides.select("team_id", "period", "match_id", "opponent_id", "kickoff"), ["team_id", "period"], "left")
    reason = F.when(~F.col("selectable"), "not_selectable").when(F.col("match_id").isNull(), "blank").when(F.col("kickoff").isNull(), "no_kickoff").otherwise("eligible")
    return rows.withColumn("has_fixture", F.col("match_id").isNotNull()).withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")


def long_horizon(cells: DataFrame, predictions: DataFrame | None, start: int, discounts: Sequence[float] = DISCOUNTS) -> DataFrame:
    """Eligibility rows with the period's prediction. What is missing stays missing: it is never zero.

    `predictions` has player_id, period, points; none if `eligibility` had them.
    """
    rows = cells if predictions is None else _predicted(cells, predictions)
    found = F.col("_known").isNotNull()
    status = F.when(found, "available").when(F.col("period") > start, "missing_future").otherwise("missing_required")
    discount = F.element_at(F.array(*map(F.lit, discounts)), (F.col("period") - start + 1).cast("int"))
    rows = rows.withColumn("prediction_status", status).withColumn("discounted", F.col("points") * discount)
    row_status = F.when(~F.col("has_fixture"), "blank").when(~F.col("eligible"), "ineligible").otherwise(F.col("prediction_status"))
    return rows.withColumn("row_status", row_status).withColumn("review", F.col("points").isNull() | ~F.col("has_fixture")).drop("_known")


def mode_of(long: DataFrame, start: int, horizon: int) -> DataFrame:
    """One row: players, those known in the first period and in all, and the mode that this allows."""
    known = F.collect_set(F.when(F.col("points").isNotNull(), F.col("period")))
    each = long.groupBy("player_id").agg(F.size(known).alias("n"), F.array_contains(known, F.lit(start).cast("long")).alias("first"))
    out = each.agg(F.count("*").alias("players"), F.count_if("first").alias("first_known"), F.count_if(F.col("n") == horizon).alias("all_known"))
    mode = F.when(F.col("players") == 0, "none").when(F.col("all_known") == F.col("players"), "full_horizon").when(F.col("first_known") == F.col("players"), "first_only").otherwise("none")
    return out.withColumn("mode", mode)


def player_totals(long: DataFrame) -> DataFrame:
    """Each player's sum over the known periods, the discounted one, how many are missing and which."""
    missing = F.collect_set(F.when(F.col("points").isNull(), F.col("period")))
    return long.groupBy("player_id").agg(F.sum("points").alias("points"), F.sum("discounted").alias("discounted"), F.count_if(F.col("points").isNull()).alias("missing"), F.concat_ws("|", F.transform(F.array_sort(missing), lambda p: p.cast("string"))).alias("missing_periods"))


def wide_points(long: DataFrame, periods: Sequence[int]) -> DataFrame:
    """One row per player with a column for each period of a pinned list."""
    return long.groupBy("player_id").pivot("period", list(periods)).agg(F.sum("points")).withColumnsRenamed({str(p): f"period_{p}" for p in periods})


def risk_adjusted(points: Column, low: Column, high: Column, minutes: Column, fallback: Column, aversion: float = 0.25, thin: float = 0.5, penalty: float = 0.3) -> Column:
    """Utility: points, less a share of the spread, less a charge for thin minutes and for fallback rows."""
    spread = F.coalesce(high - low, F.lit(0.0))
    return points - aversion * spread - F.when(minutes < 60, thin).otherwise(0.0) - F.when(fallback, penalty).otherwise(0.0)
