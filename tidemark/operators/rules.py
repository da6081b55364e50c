"""Scoring and legality rules of a squad game, applied to whole tables of matches, squads and managers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scoring:
    """Points of a player's match."""

    goal: Mapping[str, int] = field(default_factory=lambda: {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4})
    clean_sheet: Mapping[str, int] = field(default_factory=lambda: {"GKP": 4, "DEF": 4, "MID": 1, "FWD": 0})
    contribution_threshold: Mapping[str, int] = field(default_factory=lambda: {"DEF": 10, "MID": 12, "FWD": 12})
    contribution: int = 2
    assist: int = 3
    long_minutes: int = 60
    saves_each: int = 3
    penalty_save: int = 5
    yellow: int = -1
    red: int = -3
    own_goal: int = -2
    penalty_miss: int = -2
    conceded_each: int = 2
    conceded: int = -1
    conceding_positions: tuple[str, ...] = ("GKP", "DEF")


def _by_position(position: Column, table: Mapping[str, int]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), position)


def score(df: DataFrame, rules: Scoring = Scoring()) -> DataFrame:
    """Matches with the twelve parts of their score, the total, and why a row cannot be scored (null: it can).

    `df` has position, minutes, goals, assists, saves, penalty_saves, yellow_cards, red_cards, own_goals,
    penalty_misses, conceded, bonus, contributions, clean_sheet, as_goalkeeper. A red card replaces yellow ones.
    """
    c, position = F.col, F.col("position")
    keeper = c("as_goalkeeper") | (position == "GKP")
    threshold = _by_position(position, rules.contribution_threshold)
    parts = {
        "appearance": F.when(c("minutes") >= rules.long_minutes, 2).when(c("minutes") >= 1, 1).otherwise(0),
        "goal": c("goals") * _by_position(position, rules.goal),
        "assist": c("assists") * rules.assist,
        "clean": F.when(c("clean_sheet") & (c("minutes") >= rules.long_minutes), _by_position(position, rules.clean_sheet)).otherwise(0),
        "save": F.when(keeper, F.floor(c("saves") / rules.saves_each)).otherwise(0),
        "penalty_save": F.when(keeper, c("penalty_saves") * rules.penalty_save).otherwise(0),
        "card": F.when(c("red_cards") > 0, c("red_cards") * rules.red).otherwise(c("yellow_cards") * rules.yellow),
        "own_goal": c("own_goals") * rules.own_goal,
        "penalty_miss": c("penalty_misses") * rules.penalty_miss,
        "conceding": F.when(position.isin(*rules.conceding_positions), F.floor(c("conceded") / rules.conceded_each) * rules.conceded).otherwise(0),
        "bonus_part": c("bonus"),
        "contribution": F.when(c("contributions") >= threshold, rules.contribution).otherwise(0),
    }
    problem = F.when(~position.isin(*rules.goal), "unknown_position").when(~keeper & ((c("saves") > 0) | (c("penalty_saves") > 0)), "saves_without_goalkeeper").when(~c("bonus").between(0, 3), "bonus_out_of_range")
    out = df.withColumns({f"{k}_points": v.cast("long") for k, v in parts.items()})
    total = sum((F.col(f"{k}_points") for k in parts), F.lit(0))
    return out.withColumn("problem", problem).withColumn("total_points", F.when(F.col("problem").isNull(), total))


#: A legal squad and a legal line-up.
QUOTAS = {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}
FORMATION = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
BUDGET, PER_CLUB, STARTING = 1000, 3, 11
HIT, BANK_CAP, ACCRUAL = 4, 5, 1


def _errors(found: Mapping[str, Column]) -> Column:
    return F.filter(F.array(*(F.when(cond, name) for name, cond in found.items())), lambda x: x.isNotNull())


def squad_legality(members: DataFrame, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB) -> DataFrame:
    """Each squad with its price and the rules that it breaks. `members` has squad_id, player_id, position, club, price."""
    n = {p: F.count_if(F.col("position") == p) for p in quotas}
    off = ~F.lit(True)
    for p, want in quotas.items():
        off = off | (n[p] != want)
    clubs = members.groupBy("squad_id", "club").agg(F.count("*").alias("_n")).groupBy("squad_id").agg(F.max("_n").alias("_most"))
    rows = members.groupBy("squad_id").agg(F.count("*").alias("players"), F.count_distinct("player_id").alias("distinct_players"), F.sum("price").alias("price"), off.alias("_quota")).join(clubs, "squad_id")
    errors = _errors({"squad_size": F.col("players") != sum(quotas.values()), "duplicate_players": F.col("distinct_players") != F.col("players"), "position_quotas": F.col("_quota"), "club_limit": F.col("_most") > per_club, "budget": F.col("price") > budget})
    return rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("_quota", "_most")


def legality_issues(members: DataFrame, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB) -> DataFrame:
    """One row for each rule that a squad breaks: squad_id, code, scope (what it is about), expected and actual as text. `members` as in squad_legality."""
    text = lambda c: c.cast("string")
    issue = lambda broken, code, scope, expected, actual: F.when(broken, F.struct(F.lit(code).alias("code"), text(scope).alias("scope"), text(expected).alias("expected"), text(actual).alias("actual")))
    n = {p: F.col(f"_{p}") for p in quotas}
    squads = members.groupBy("squad_id").agg(F.count("*").alias("_players"), F.count_distinct("player_id").alias("_distinct"), F.sum("price").alias("_price"), *(F.count_if(F.col("position") == p).alias(f"_{p}") for p in quotas))
    size = sum(quotas.values())
    found = [
        issue(F.col("_players") != size, "squad_size", F.lit("squad"), F.lit(size), F.col("_players")),
        issue(F.col("_distinct") != F.col("_players"), "duplicate_players", F.lit("squad"), F.col("_players"), F.col("_distinct")),
        *(issue(n[p] != want, "position_quota", F.lit(p), F.lit(want), n[p]) for p, want in quotas.items()),
        issue(F.col("_price") > budget, "budget", F.lit("squad"), F.lit(budget), F.col("_price")),
    ]
    whole = squads.select("squad_id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    clubs = members.groupBy("squad_id", "club").agg(F.count("*").alias("_n")).where(F.col("_n") > per_club)
    return whole.unionByName(clubs.select("squad_id", F.lit("club_limit").alias("code"), text(F.col("club")).alias("scope"), F.lit(str(per_club)).alias("expected"), text(F.col("_n")).alias("actual")))


def lineup_legality(lines: DataFrame, formation: Mapping[str, tuple[int, int]] = FORMATION, starting: int = STARTING, bench: int = 4) -> DataFrame:
    """Each line-up and the rules that it breaks. `lines` has squad_id, player_id, position, starts, captain, vice."""
    starts = F.col("starts")
    bad = ~F.lit(True)
    for p, (low, high) in formation.items():
        bad = bad | ~F.count_if(starts & (F.col("position") == p)).between(low, high)
    found = {
        "starting_size": F.count_if(starts) != starting,
        "bench_size": F.count_if(~starts) != bench,
        "duplicate_players": F.count_distinct("player_id") != F.count("*"),
        "formation": bad,
        "bench_goalkeepers": F.count_if(~starts & (F.col("position") == "GKP")) != 1,
        "captain": F.count_if("captain") != 1,
        "captain_not_starting": F.count_if(F.col("captain") & ~starts) > 0,
        "vice_captain": F.count_if("vice") != 1,
        "vice_not_starting": F.count_if(F.col("vice") & ~starts) > 0,
        "captain_is_vice": F.count_if(F.col("captain") & F.col("vice")) > 0,
    }
    rows = lines.groupBy("squad_id").agg(*(c.alias(f"_{k}") for k, c in found.items()))
    return rows.select("squad_id", _errors({k: F.col(f"_{k}") for k in found}).alias("errors")).withColumn("valid", F.size("errors") == 0)


def transfer_price(count: Column, free: Column, chip: Column, pre_season: Column, hit: int = HIT) -> tuple[Column, Column]:
    """(points cost, free transfers left). Before the season and with a chip transfers are free and the bank stays."""
    unlimited = pre_season | chip.isNotNull()
    cost = F.when(unlimited, 0).otherwise(F.greatest(F.lit(0), count - free) * hit)
    return cost, F.when(unlimited, free).otherwise(free - F.least(count, free))


def bank_after(weeks: DataFrame, top_ups: Mapping[int, int] | None = None, cap: int = BANK_CAP, accrual: int = ACCRUAL) -> DataFrame:
    """Free transfers of each manager after all its weeks in order.

    `weeks` has manager_id, week, used, chip (null: none). A week uses free transfers and adds `accrual`
    up to the cap; with a chip the bank stays as it is; after a week in `top_ups` it is at least the given number.
    A manager's weeks are one season: the array that is folded is short.
    """
    tops = F.create_map(*(F.lit(x) for pair in (top_ups or {-1: 0}).items() for x in pair))

    def step(bank: Column, w: Column) -> Column:
        after = F.when(w["chip"].isNotNull(), bank).otherwise(F.least(F.lit(cap), bank - F.least(bank, w["used"]) + accrual))
        return F.least(F.lit(cap), F.greatest(after, F.coalesce(F.try_element_at(tops, w["week"].cast("int")), F.lit(0)))).cast("int")

    ordered = F.array_sort(F.collect_list(F.struct("week", F.col("used").cast("int").alias("used"), "chip")))
    return weeks.groupBy("manager_id").agg(F.aggregate(ordered, F.lit(1).cast("int"), step).alias("free_transfers"))


def chip_problems(uses: DataFrame, windows: DataFrame, never_in_a_row: tuple[str, ...] = ("free_hit",)) -> DataFrame:
    """Uses of chips with the first rule that they break, or null: outside every window, over the allowance, two in a row, two in one week.

    uses: manager_id, week, chip; windows as for `chip_inventory`. Uses count in order of weeks.
    """
    u = uses.select("manager_id", "week", "chip").distinct()
    inside = (F.col("u.chip") == F.col("w.chip")) & F.col("u.week").between(F.col("w.first"), F.col("w.last"))
    rows = u.alias("u").join(F.broadcast(windows.alias("w")), inside, "left").select("u.*", "w.window", "w.allowed")
    by = Window.partitionBy("manager_id", "chip")
    nth = F.row_number().over(Window.partitionBy("manager_id", "chip", "window").orderBy("week"))
    in_a_row = F.col("chip").isin(*never_in_a_row) & (F.col("week") - F.lag("week").over(by.orderBy("week")) == 1)
    same_week = F.count(F.lit(1)).over(Window.partitionBy("manager_id", "week")) > 1
    rows = rows.withColumns({"_nth": nth, "_row": F.coalesce(in_a_row, F.lit(False)), "_same": same_week})
    problem = F.when(F.col("window").isNull(), "outside_windows").when(F.col("_nth") > F.col("allowed"), "over_allowance").when(F.col("_row"), "in_a_row").when(F.col("_same"), "two_in_one_week")
    return rows.select("manager_id", "week", "chip", problem.alias("problem"))


def chip_inventory(uses: DataFrame, windows: DataFrame, managers: DataFrame) -> DataFrame:
    """For each manager and chip window: allowed, used, left. windows: chip, window, first, last, allowed (a short table)."""
    inside = (F.col("u.chip") == F.col("w.chip")) & F.col("u.week").between(F.col("w.first"), F.col("w.last"))
    used = uses.alias("u").join(F.broadcast(windows.alias("w")), inside).groupBy("u.manager_id", "w.chip", "w.window").agg(F.count("*").alias("used"))
    grid = managers.select("manager_id").join(F.broadcast(windows), F.lit(True))
    out = grid.join(used, ["manager_id", "chip", "window"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.select("manager_id", "chip", "window", "allowed", "used", F.greatest(F.lit(0), F.col("allowed") - F.col("used")).alias("left"))


def transfer_legality(current: DataFrame, outgoing: DataFrame, incoming: DataFrame, quotas: Mapping[str, int] = QUOTAS, budget: int = BUDGET, per_club: int = PER_CLUB) -> DataFrame:
    """Each squad's whole set of transfers and the rules that it breaks.

    `current` and `incoming` have squad_id, player_id, position, club, price; `outgoing` squad_id, player_id.
    Squads are those of `current`. The squad before and after the transfers must be legal, each player go
    or come once, and as many come as go.
    """
    members = ["squad_id", "player_id", "position", "club", "price"]
    gone, owned = outgoing.select("squad_id", "player_id").distinct(), current.select("squad_id", "player_id").distinct()
    remaining = current.select(*members).join(gone, ["squad_id", "player_id"], "left_anti")
    legal = lambda df, name: squad_legality(df, quotas, budget, per_club).select("squad_id", F.col("valid").alias(name))
    went = outgoing.join(owned.withColumn("_owned", F.lit(True)), ["squad_id", "player_id"], "left").groupBy("squad_id").agg(
        F.count("*").alias("_out"), (F.count_distinct("player_id") < F.count("*")).alias("_out_twice"), F.count_if(F.col("_owned").isNull()).alias("_not_owned")
    )
    stays = remaining.select("squad_id", "player_id").distinct().withColumn("_stays", F.lit(True))
    came = incoming.join(stays, ["squad_id", "player_id"], "left").groupBy("squad_id").agg(
        F.count("*").alias("_in"), (F.count_distinct("player_id") < F.count("*")).alias("_in_twice"), F.count_if("_stays").alias("_already")
    )
    rows = legal(current, "_before").join(legal(remaining.unionByName(incoming.select(*members)), "_after"), "squad_id", "left").join(went, "squad_id", "left").join(came, "squad_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = {
        "squad_before": ~yes("_before"),
        "repeated_outgoing": yes("_out_twice"),
        "outgoing_not_owned": n("_not_owned") > 0,
        "repeated_incoming": yes("_in_twice"),
        "counts_differ": n("_in") != n("_out"),
        "incoming_owned": n("_already") > 0,
        "squad_after": ~yes("_after"),
    }
    return rows.select("squad_id", F.greatest(n("_in"), n("_out")).alias("transfers"), _errors(found).alias("errors")).withColumn("valid", F.size("errors") == 0)
