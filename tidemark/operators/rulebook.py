"""Scoring rules as a table: read from documents, checked, and joined to matches by season.

A document is JSON text. It is held as a variant, so a check sees the kind of every value (a number written as text is no number). Rules
become rows, and a match is scored by the row of its season and position: another season needs a document and no code.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import season_valid

#: What a document of scoring rules must have and say.
POSITIONS = ("GKP", "DEF", "MID", "FWD")
TOP_KEYS = ("schema_version", "competition", "effective_season", "rules_version", "status", "source_notes", "positions", "scoring", "deterministic_examples")
RULE_KEYS = ("appearance", "goals", "assists", "clean_sheets", "saves", "penalty_saves", "cards", "own_goals", "penalty_misses", "goals_conceded", "bonus", "defensive_contributions")
TEXTS = ("schema_version", "competition", "effective_season", "rules_version", "status", "scoring.assists.definition_version")
LISTS = ("source_notes", "deterministic_examples")
POINTS_BY_POSITION = ("scoring.goals.points_by_position", "scoring.clean_sheets.points_by_position")
REQUIRED: Mapping[str, object] = {
    "schema_version": "fpl_scoring_rules_v1",
    "competition": "FPL",
    "positions": ["GKP", "DEF", "MID", "FWD"],
    "scoring.appearance.bands": [{"min_minutes": 1, "max_minutes": 59, "points": 1}, {"min_minutes": 60, "max_minutes": None, "points": 2}],
    "scoring.assists.points": 3,
    "scoring.clean_sheets.minimum_minutes": 60,
    "scoring.saves.per_saves": 3,
    "scoring.saves.points": 1,
    "scoring.penalty_saves.points": 5,
    "scoring.cards.yellow_points": -1,
    "scoring.cards.red_points": -3,
    "scoring.cards.red_points_include_yellow_deductions": True,
    "scoring.own_goals.points": -2,
    "scoring.penalty_misses.points": -2,
    "scoring.goals_conceded.eligible_positions": ["GKP", "DEF"],
    "scoring.goals_conceded.per_goals": 2,
    "scoring.goals_conceded.points": -1,
    "scoring.bonus.allowed_player_points": [0, 1, 2, 3],
    "scoring.bonus.rank_points": {"1": 3, "2": 2, "3": 1},
    "scoring.defensive_contributions.by_position.GKP.threshold": None,
    "scoring.defensive_contributions.by_position.GKP.points": 0,
    "scoring.defensive_contributions.by_position.DEF.threshold": 10,
    "scoring.defensive_contributions.by_position.DEF.points": 2,
    "scoring.defensive_contributions.by_position.DEF.max_points_per_match": 2,
    "scoring.defensive_contributions.by_position.MID.threshold": 12,
    "scoring.defensive_contributions.by_position.MID.points": 2,
    "scoring.defensive_contributions.by_position.MID.max_points_per_match": 2,
    "scoring.defensive_contributions.by_position.FWD.threshold": 12,
    "scoring.defensive_contributions.by_position.FWD.points": 2,
    "scoring.defensive_contributions.by_position.FWD.max_points_per_match": 2,
}
EVENTS = ("minutes", "goals", "assists", "saves", "penalty_saves", "yellow_cards", "red_cards", "own_goals", "penalty_misses", "goals_conceded_for_scoring", "bonus_points", "defensive_contributions")
PARTS = ("appearance", "goal", "assist", "clean_sheet", "save", "penalty_save", "card", "own_goal", "penalty_miss", "goals_conceded", "bonus", "defensive_contribution")


# Documents


def _at(path: str, document: str = "_doc") -> Column:
    """The value at a path of keys; null where there is none."""
    return F.try_variant_get(document, "".join(["$", *(f'["{k}"]' for k in path.split("."))]), "variant")


def _opened(rows: DataFrame, paths: Sequence[str], document: str = "_doc") -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """`rows` with the values at paths of keys, the column of each path, and of each path above another whether an object is there.

    The columns are as of `_at`, but an object is opened once for all of its keys.
    """
    every = {".".join(keys[: i + 1]) for keys in (p.split(".") for p in paths) for i in range(len(keys))}
    below: dict[str, list[str]] = {}
    for p in sorted(every):
        below.setdefault(p.rpartition(".")[0], []).append(p)
    at, objects, level = {"": F.col(document)}, {}, [""]
    while level:
        opened = {}
        for above in level:
            names = [p.rpartition(".")[2] for p in below[above]]
            keys = f"_keys{len(objects)}"
            opened[keys] = F.try_variant_get(at[above], "$", "struct<" + ", ".join(f"`{k}`: variant" for k in names) + ">")
            at |= {p: F.col(keys)[k] for p, k in zip(below[above], names)}
            objects[above] = F.col(keys).isNotNull()
        rows = rows.withColumns(opened)
        level = [p for above in level for p in below[above] if p in below]
    return rows, at, objects


def _kind(value: Column) -> Column:
    """BIGINT, STRING, BOOLEAN, OBJECT<...>, ARRAY<...>, VOID (a null that is written), or null where there is no value."""
    return F.schema_of_variant(value)


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(_kind(value).startswith(kind), F.lit(False))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _same(value: Column, wanted: object) -> Column:
    """Equal in kind and value; keys of an object may stand in any order."""
    other = F.parse_json(F.lit(json.dumps(wanted)))
    return F.coalesce((F.to_json(value) == F.to_json(other)) & (_kind(value) == _kind(other)), F.lit(False))


def _parts(value: Column) -> Column:
    """The values of a list; null for what is no list."""
    return F.try_variant_get(value, "$", "array<variant>")


def _keys(value: Column) -> Column:
    return F.array_sort(F.json_object_keys(F.to_json(value)))


def _has_keys(value: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(_keys(value) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def document_problems(documents: DataFrame, document: str = "document", season: str | None = None, required: Mapping[str, object] = REQUIRED) -> DataFrame:
    """`documents` with problems (sorted codes) and valid.

    `missing.<key>`: a key of the document or a rule is not there. `kind.<path>`: not a text with letters, a list, an object or a
    number for each position as it must be. `wrong.<path>`: not the required value, or a season that is none. `other.effective_season`:
    not the season asked for. `examples.few` and `examples.<position>`: fewer examples than positions, none for a position. Text that is not a JSON object is `unreadable`.
    """
    rows = documents.withColumn("_doc", F.try_parse_json(document))
    policies = "scoring.defensive_contributions.by_position"
    asked = [*TOP_KEYS, *(f"scoring.{k}" for k in RULE_KEYS), *TEXTS, *LISTS, *(f"{p}.{x}" for p in POINTS_BY_POSITION for x in POSITIONS), policies, *required]
    rows, at, objects = _opened(rows, asked)
    there = lambda path: at[path].isNotNull()
    found = [F.when(~there(k), f"missing.{k}") for k in TOP_KEYS]
    found += [F.when(objects["scoring"] & ~there(f"scoring.{k}"), f"missing.scoring.{k}") for k in RULE_KEYS]
    found += [F.when(there(p) & (~_is("STRING", at[p]) | (F.trim(_text(at[p])) == "")), f"kind.{p}") for p in TEXTS if "." not in p]
    found += [F.when(there("scoring.assists") & ~(_is("STRING", at[p]) & (F.trim(_text(at[p])) != "")), f"kind.{p}") for p in TEXTS if "." in p]
    found += [F.when(there(p) & _parts(at[p]).isNull(), f"kind.{p}") for p in LISTS]
    found += [F.when(there("scoring") & ~objects["scoring"], "kind.scoring")]
    for p in POINTS_BY_POSITION:
        numbers = [_is("BIGINT", at[f"{p}.{x}"]) for x in POSITIONS]
        good = _has_keys(at[p], POSITIONS) & numbers[0] & numbers[1] & numbers[2] & numbers[3]
        found.append(F.when(there(p.rpartition(".")[0]) & ~good, f"kind.{p}"))
    found.append(F.when(there("scoring.defensive_contributions") & ~_has_keys(at[policies], POSITIONS), f"kind.{policies}"))
    for path, value in required.items():
        above = path.split(".")[:2] if path.startswith("scoring.") else [path]
        missing_counts = path.endswith("GKP.threshold")  # no threshold and a null one are the same
        good = _same(at[path], value) | (F.lit(missing_counts) & at[path].isNull())
        found.append(F.when(there(".".join(above)) & ~good, f"wrong.{path}"))
    said = F.when(_is("STRING", at["effective_season"]), F.trim(_text(at["effective_season"])))
    found.append(F.when(said.isNotNull() & ~season_valid(said), "wrong.effective_season"))
    if season is not None:
        found.append(F.when(said.isNotNull() & (said != season), "other.effective_season"))
    rows = rows.withColumn("_positions", F.transform(_parts(at["deterministic_examples"]), lambda e: F.try_variant_get(e, "$.position", "string")))
    positions = F.col("_positions")
    found.append(F.when(F.size(positions) < len(POSITIONS), "examples.few"))
    found += [F.when(positions.isNotNull() & ~F.coalesce(F.array_contains(positions, p), F.lit(False)), f"examples.{p}") for p in POSITIONS]
    problems = F.when(~objects[""], F.array(F.lit("unreadable"))).otherwise(F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return rows.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0).select(*documents.columns, "problems", "valid")


# Rules


def rule_rows(documents: DataFrame, document: str = "document") -> DataFrame:
    """A row for each rule of each document: season, kind, position (null: all), least, most, each, points.

    A rule gives `points` for every `each` of its event; `least` and `most` bound the minutes of appearances and clean sheets and the count of
    contributions, which are paid once. The bonus has a row for each number of points that may be given.
    """
    rows = documents.select(F.try_parse_json(document).alias("_doc")).select(_text(_at("effective_season")).alias("season"), _at("scoring").alias("_s"))
    number = lambda path: F.try_variant_get(_at(path, "_s"), "$", "long")
    none = F.lit(None).cast("long")

    def rule(kind: str, position: Column | str | None, points: Column, each: Column = none, least: Column = none, most: Column = none) -> Column:
        name = F.lit(position).cast("string") if not isinstance(position, Column) else position
        return F.struct(F.lit(kind).alias("kind"), name.alias("position"), least.alias("least"), most.alias("most"), each.alias("each"), points.alias("points"))

    one = F.lit(1).cast("long")
    plain = [
        rule("assist", None, number("assists.points"), one),
        rule("save", None, number("saves.points"), number("saves.per_saves")),
        rule("penalty_save", None, number("penalty_saves.points"), one),
        rule("yellow_card", None, number("cards.yellow_points"), one),
        rule("red_card", None, number("cards.red_points"), one),
        rule("own_goal", None, number("own_goals.points"), one),
        rule("penalty_miss", None, number("penalty_misses.points"), one),
    ]
    for p in POSITIONS:
        plain.append(rule("goal", p, number(f"goals.points_by_position.{p}"), one))
        plain.append(rule("clean_sheet", p, number(f"clean_sheets.points_by_position.{p}"), least=number("clean_sheets.minimum_minutes")))
        policy = f"defensive_contributions.by_position.{p}"
        paid = F.least(number(f"{policy}.points"), number(f"{policy}.max_points_per_match"))
        plain.append(rule("defensive_contribution", p, paid, least=number(f"{policy}.threshold")))
    part = lambda value, path, kind: F.try_variant_get(value, path, kind)
    several = lambda path, kind: F.coalesce(part(_at(path, "_s"), "$", f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    bands = F.transform(several("appearance.bands", "variant"), lambda b: rule("appearance", None, part(b, "$.points", "long"), least=part(b, "$.min_minutes", "long"), most=part(b, "$.max_minutes", "long")))
    conceded = F.transform(several("goals_conceded.eligible_positions", "string"), lambda p: rule("goals_conceded", p, number("goals_conceded.points"), number("goals_conceded.per_goals")))
    bonus = F.transform(several("bonus.allowed_player_points", "long"), lambda n: rule("bonus", None, n))
    return rows.select("season", F.explode(F.concat(F.array(*plain), bands, conceded, bonus)).alias("_r")).select("season", "_r.*").where("kind NOT IN ('clean_sheet', 'defensive_contribution') OR least IS NOT NULL")


def _by_season_and_position(rules: DataFrame) -> DataFrame:
    """One row for each season and position, from a handful of rule rows: what a match of that position is scored by."""
    mine = rules.withColumn("_p", F.explode(F.when(F.col("position").isNull(), F.array(*map(F.lit, POSITIONS))).otherwise(F.array("position"))))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    single = ("goal", "assist", "save", "penalty_save", "yellow_card", "red_card", "own_goal", "penalty_miss", "goals_conceded", "clean_sheet", "defensive_contribution")
    columns = [of(kind, c).alias(f"_{kind}_{c}") for kind in single for c in ("points", "each", "least")]
    bands = F.collect_list(F.when(F.col("kind") == "appearance", F.struct("least", "most", "points"))).alias("_bands")
    bonus = F.collect_set(F.when(F.col("kind") == "bonus", F.col("points"))).alias("_allowed")
    return mine.groupBy(F.col("season").alias("_season"), F.col("_p").alias("_position")).agg(*columns, bands, bonus)


def score_by_rules(matches: DataFrame, rules: DataFrame, season: str = "season", position: str = "position") -> DataFrame:
    """`matches` with the twelve parts of each score, total_points, and problem (null: none), by the rules of the match's season.

    A match has the columns of EVENTS (null: none happened), clean_sheet and acted_as_goalkeeper. With a problem the parts are there but no total: no rules for the
    season, a position that has none, a negative event, saves of one who did not keep goal, a bonus that is not given. A red card
    replaces yellow ones. `rules` are rows as of `rule_rows`.
    """
    known = F.col(position).isin(*POSITIONS)
    table = _by_season_and_position(rules)
    seasons = rules.select(F.col("season").alias("_season")).distinct().withColumn("_ruled", F.lit(True))
    rows = matches.join(seasons, matches[season] == seasons["_season"], "left").drop("_season")
    rows = rows.join(table, (rows[season] == table["_season"]) & (rows[position] == table["_position"]), "left")
    n = {e: F.coalesce(F.col(e).cast("long"), F.lit(0).cast("long")) for e in EVENTS}
    rule = lambda kind, c="points": F.col(f"_{kind}_{c}")
    times = lambda count, kind: F.floor(count / rule(kind, "each")) * rule(kind)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    keeper = yes("acted_as_goalkeeper") | F.coalesce(F.col(position) == "GKP", F.lit(False))
    here = F.filter("_bands", lambda b: (n["minutes"] >= b["least"]) & (b["most"].isNull() | (n["minutes"] <= b["most"])))
    parts = {
        "appearance": F.aggregate(here, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b["points"])),
        "goal": times(n["goals"], "goal"),
        "assist": times(n["assists"], "assist"),
        "clean_sheet": F.when(yes("clean_sheet") & (n["minutes"] >= rule("clean_sheet", "least")), rule("clean_sheet")),
        "save": F.when(keeper, times(n["saves"], "save")),
        "penalty_save": F.when(keeper, times(n["penalty_saves"], "penalty_save")),
        "card": F.when(n["red_cards"] > 0, times(n["red_cards"], "red_card")).otherwise(times(n["yellow_cards"], "yellow_card")),
        "own_goal": times(n["own_goals"], "own_goal"),
        "penalty_miss": times(n["penalty_misses"], "penalty_miss"),
        "goals_conceded": times(n["goals_conceded_for_scoring"], "goals_conceded"),
        "bonus": n["bonus_points"],
        "defensive_contribution": F.when(n["defensive_contributions"] >= rule("defensive_contribution", "least"), rule("defensive_contribution")),
    }
    problem = F.when(~F.coalesce(known, F.lit(False)), "unknown_position").when(F.col("_ruled").isNull(), "no_rules")
    for e in EVENTS:
        problem = problem.when(n[e] < 0, f"negative.{e}")
    problem = problem.when(~keeper & ((n["saves"] > 0) | (n["penalty_saves"] > 0)), "saves_without_goalkeeper").when(~F.array_contains("_allowed", n["bonus_points"]), "bonus_not_given")
    out = rows.withColumns({f"{k}_points": F.coalesce(v, F.lit(0)).cast("long") for k, v in parts.items()}).withColumn("problem", problem)
    total = sum((F.col(f"{k}_points") for k in PARTS), F.lit(0))
    return out.withColumn("total_points", F.when(F.col("problem").isNull(), total).cast("long")).select(*matches.columns, *(f"{k}_points" for k in PARTS), "problem", "total_points")


def example_matches(documents: DataFrame, document: str = "document") -> DataFrame:
    """The worked examples of documents as matches: season, id, position, events and expected_total."""
    doc = documents.select(F.try_parse_json(document).alias("_doc"))
    rows = doc.select(_text(_at("effective_season")).alias("season"), F.explode(F.try_variant_get(_at("deterministic_examples"), "$", "array<variant>")).alias("_e"))
    get = lambda path, kind: F.try_variant_get("_e", f"$.{path}", kind)
    whole = lambda path: F.when(_is("BIGINT", get(path, "variant")), get(path, "long"))
    flag = lambda name: F.coalesce(F.lower(F.trim(get(f"events.{name}", "string"))).isin("true", "1", "yes", "y"), F.lit(False))
    unfit = [F.when(get(f"events.{e}", "variant").isNotNull() & whole(f"events.{e}").isNull(), f"kind.events.{e}") for e in EVENTS]
    unfit += [F.when(whole("expected_total_points").isNull(), "kind.expected_total_points"), F.when(F.trim(F.coalesce(get("id", "string"), F.lit(""))) == "", "kind.id")]
    return rows.select(
        "season", get("id", "string").alias("id"), get("position", "string").alias("position"), *(whole(f"events.{e}").alias(e) for e in EVENTS),
        flag("clean_sheet").alias("clean_sheet"), flag("acted_as_goalkeeper").alias("acted_as_goalkeeper"), whole("expected_total_points").alias("expected_total"), F.coalesce(*unfit).alias("unfit"),
    )


def example_results(documents: DataFrame, document: str = "document") -> DataFrame:
    """season, id, position, expected_total, total_points, problem and passed of every worked example, scored by its own document's rules and the plan of all matches."""
    scored = score_by_rules(example_matches(documents, document), rule_rows(documents, document))
    problem = F.coalesce("unfit", "problem")
    passed = problem.isNull() & F.coalesce(F.col("total_points") == F.col("expected_total"), F.lit(False))
    return scored.select("season", "id", "position", "expected_total", "total_points", problem.alias("problem"), passed.alias("passed"))
