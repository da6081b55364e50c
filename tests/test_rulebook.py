"""Scoring rules read from documents: every check by a document that fails it, worked examples as golden rows."""

import json

import pytest

from tidemark.operators import rulebook as rb
from tidemark.plans.rule_queries import document_problems, rules_document


def event_row(**events):
    return dict.fromkeys(rb.EVENTS, 0) | {"clean_sheet": False, "acted_as_goalkeeper": False} | events


#: Worked examples, position, events, points.
GOLDEN = [
    ("GKP", {"minutes": 90, "goals": 1, "saves": 6, "penalty_saves": 1, "yellow_cards": 1, "goals_conceded_for_scoring": 2, "bonus_points": 3, "acted_as_goalkeeper": True}, 20),
    ("DEF", {"minutes": 90, "goals": 1, "assists": 1, "clean_sheet": True, "yellow_cards": 1, "bonus_points": 2, "defensive_contributions": 10}, 18),
    ("MID", {"minutes": 75, "goals": 1, "assists": 1, "clean_sheet": True, "penalty_misses": 1, "bonus_points": 1, "defensive_contributions": 12}, 12),
    ("FWD", {"minutes": 30, "goals": 2, "assists": 1, "yellow_cards": 1, "red_cards": 1, "own_goals": 1, "defensive_contributions": 12}, 9),
]


def problems(spark, *documents, **how):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, document string")
    return [r.problems for r in rb.document_problems(rows, **how).orderBy("i").collect()]


def without(path):
    document = json.loads(rules_document("2025_26"))
    *above, last = path.split(".")
    level = document
    for key in above:
        level = level[key]
    del level[last]
    return json.dumps(document)


def test_valid_documents(spark):
    spaced = json.dumps(json.loads(rules_document("2025_26")), indent=3, sort_keys=True)
    no_threshold = json.loads(rules_document("2025_26"))
    del no_threshold["scoring"]["defensive_contributions"]["by_position"]["GKP"]["threshold"]
    extra = rules_document("2025_26", {"rollover_policy": {"x": 1}, "scoring.saves.uncapped": True})
    assert problems(spark, rules_document("2025_26"), spaced, json.dumps(no_threshold), extra, season="2025_26") == [[]] * 4


def test_each_required_value_is_checked(spark):
    paths = list(rb.REQUIRED)
    changed = [True if v is False else False if v is True else (v + 1 if isinstance(v, int) else f"{v}x" if isinstance(v, str) else v[:-1] if isinstance(v, list) else 7 if v is None else {**v, "1": 4}) for v in rb.REQUIRED.values()]
    assert problems(spark, *(rules_document("2025_26", {p: v}) for p, v in zip(paths, changed))) == [[f"wrong.{p}"] for p in paths]
    as_text = [p for p, v in rb.REQUIRED.items() if type(v) is int]
    assert problems(spark, *(rules_document("2025_26", {p: str(rb.REQUIRED[p])}) for p in as_text)) == [[f"wrong.{p}"] for p in as_text]


def test_each_key_is_checked(spark):
    got = problems(spark, *map(without, rb.TOP_KEYS))
    assert all(f"missing.{k}" in found for k, found in zip(rb.TOP_KEYS, got)) and got[rb.TOP_KEYS.index("status")] == ["missing.status"]
    assert problems(spark, *(without(f"scoring.{k}") for k in rb.RULE_KEYS)) == [[f"missing.scoring.{k}"] for k in rb.RULE_KEYS]


@pytest.mark.parametrize(
    "changes,want",
    [
        ({"scoring.goals_conceded": {}}, ["wrong.scoring.goals_conceded.eligible_positions", "wrong.scoring.goals_conceded.per_goals", "wrong.scoring.goals_conceded.points"]),
        ({"scoring.goals.points_by_position": {"GKP": 1, "DEF": 1, "MID": 1}}, ["kind.scoring.goals.points_by_position"]),
        ({"scoring.clean_sheets.points_by_position": {"GKP": 1, "DEF": 1, "MID": 1, "FWD": 1.5}}, ["kind.scoring.clean_sheets.points_by_position"]),
        ({"scoring.goals.points_by_position": {"GKP": 1, "DEF": 1, "MID": 1, "FWD": True}}, ["kind.scoring.goals.points_by_position"]),
        ({"scoring.assists.definition_version": " "}, ["kind.scoring.assists.definition_version"]),
        ({"rules_version": 3}, ["kind.rules_version"]),
        ({"source_notes": {}}, ["kind.source_notes"]),
        ({"scoring.saves.points": 1.0}, ["wrong.scoring.saves.points"]),
        ({"effective_season": "2025_27"}, ["other.effective_season", "wrong.effective_season"]),
        ({"effective_season": "2024_25"}, ["other.effective_season"]),
        ({"deterministic_examples": [{"position": p} for p in ("GKP", "DEF", "MID")]}, ["examples.FWD", "examples.few"]),
        ({"deterministic_examples": "none"}, ["kind.deterministic_examples"]),
        ({"scoring.defensive_contributions.by_position.COACH": {}}, ["kind.scoring.defensive_contributions.by_position"]),
        ({"scoring.appearance.bands": [{"min_minutes": 1, "max_minutes": 59, "points": 1, "note": "x"}, {"min_minutes": 60, "max_minutes": None, "points": 2}]}, ["wrong.scoring.appearance.bands"]),
    ],
)
def test_other_checks(spark, changes, want):
    assert problems(spark, rules_document("2025_26", changes), season="2025_26") == [want]


def test_text_that_is_no_document(spark):
    assert problems(spark, "{", "[]", "3", None, "") == [["unreadable"]] * 5


def examples(rows):
    return [{"id": f"{p} {n}", "position": p, "events": events, "expected_total_points": n} for p, events, n in rows]


def test_worked_examples(spark):
    good, bad = rules_document("2025_26", {"deterministic_examples": examples(GOLDEN)}), rules_document("2026_27", {"scoring.assists.points": 4, "deterministic_examples": examples([*GOLDEN, ("MID", {"minutes": "90"}, 2), ("COACH", {}, 0), ("FWD", {"saves": 1}, 0)])})
    docs = spark.createDataFrame([(good,), (bad,)], "document string")
    got = {(r.season, r.id): (r.total_points, r.problem, r.passed) for r in rb.example_results(docs).collect()}
    for position, events, points in GOLDEN:
        assert got["2025_26", f"{position} {points}"] == (points, None, True)
        more = points + events.get("assists", 0)
        assert got["2026_27", f"{position} {points}"] == (more, None, more == points)
    assert got["2026_27", "MID 2"][1:] == ("kind.events.minutes", False) and got["2026_27", "COACH 0"] == (None, "unknown_position", False)
    assert got["2026_27", "FWD 0"] == (None, "saves_without_goalkeeper", False) and len(got) == 11


def test_rows_of_rules(spark):
    docs = spark.createDataFrame([(rules_document("2025_26"),)], "document string")
    got = {(r.kind, r.position, r.least, r.most, r.each, r.points) for r in rb.rule_rows(docs).collect()}
    assert {("goal", "MID", None, None, 1, 5), ("appearance", None, 1, 59, None, 1), ("appearance", None, 60, None, None, 2), ("goals_conceded", "DEF", None, None, 2, -1), ("bonus", None, None, None, None, 3), ("clean_sheet", "GKP", 60, None, None, 4), ("defensive_contribution", "FWD", 12, None, None, 2)} <= got
    assert not any(kind == "defensive_contribution" and position == "GKP" for kind, position, *_ in got) and len(got) == 7 + 4 + 4 + 3 + 2 + 2 + 4


def test_matches_that_cannot_be_scored(spark):
    rows = [("2025_26", "DEF", event_row(goals=-1)), ("2025_26", "DEF", event_row(bonus_points=4)), ("2024_25", "DEF", event_row()), (None, "DEF", event_row()), ("2025_26", None, event_row()), ("2025_26", "MID", event_row(saves=3, acted_as_goalkeeper=True, minutes=60)), ("2025_26", "MID", dict.fromkeys(event_row()))]
    names = list(event_row())
    kinds = ", ".join(f"{n} {'boolean' if n in ('clean_sheet', 'acted_as_goalkeeper') else 'long'}" for n in names)
    matches = spark.createDataFrame([(i, s, p, *(e[n] for n in names)) for i, (s, p, e) in enumerate(rows)], f"i int, season string, position string, {kinds}")
    docs = spark.createDataFrame([(rules_document("2025_26"),)], "document string")
    got = {r.i: (r.problem, r.total_points) for r in rb.score_by_rules(matches, rb.rule_rows(docs)).collect()}
    assert got == {0: ("negative.goals", None), 1: ("bonus_not_given", None), 2: ("no_rules", None), 3: ("no_rules", None), 4: ("unknown_position", None), 5: (None, 3), 6: (None, 0)}


def test_documents_of_other_shapes(spark):
    shape = lambda path, value: rules_document("2025_26", {path: value})
    got = problems(spark, shape("scoring", []), shape("scoring", None), "[1]", "null", shape("scoring.cards", "x"), shape("deterministic_examples", {}), shape("source_notes", None))
    assert got[:4] == [["kind.scoring"]] * 2 + [["unreadable"]] * 2
    assert got[4] == sorted(f"wrong.scoring.cards.{k}" for k in ("yellow_points", "red_points", "red_points_include_yellow_deductions"))
    assert got[5:] == [["kind.deterministic_examples"], ["kind.source_notes"]]


def test_documents_are_opened_once_and_dealt_to_all_cores(spark):
    """The documents of a small file went to one task, which looked every path up from the top of the document."""
    found = document_problems(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") < 2 * len(rb.REQUIRED) and plan.count("schemaOfVariant") < 3 * len(rb.REQUIRED)
