"""Horizon and season reports over spoilt rows."""

from tidemark.operators import horizon as h
from tidemark.operators import summaries as su

FIXTURES = "match_id long, season string, period int, kickoff string, home_id long, away_id long, started boolean, finished boolean"


def test_horizon_report(spark):
    rows = [
        (1, "s", 1, "2024-01-01T12:00:00Z", 1, 2, False, False),
        (1, "s", 1, "2024-01-01T12:00:00Z", 3, 4, None, False),  # an id twice
        (2, "s", 2, None, 2, 1, True, False),
        (3, "s", 2, "soon", 1, 2, False, True),  # the pair of the row before, sides changed
        (4, "s", 2, "2024-01-09T12:00:00Z", 5, 5, False, False),
        (None, "s", 4, "2024-01-20T12:00:00Z", 1, None, False, False),
        (5, "s", 4, "2024-01-21T12:00:00Z", 9, 3, False, False),
        (6, "s", 9, "2024-01-21T12:00:00Z", 1, 3, False, False),
    ]
    teams = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "team_id long")
    before = spark.createDataFrame([(2, "2024-01-05T12:00:00Z"), (4, None), (5, "2024-01-21T13:00:00Z"), (7, None)], "match_id long, kickoff string")
    fixtures = spark.createDataFrame(rows, FIXTURES)
    r = h.horizon_report(fixtures, teams, 1, 4, before).first()
    want = {"fixtures": 8, "missing_identity": 1, "unknown_team": 1, "self_match": 1, "repeated_id": 2, "repeated_key": 0, "repeated_pairing": 2, "missing_periods": 1, "missing_kickoff": 1, "invalid_kickoff": 1, "started": 1, "finished": 1, "changed_kickoff": 1, "newly_known_kickoff": 1, "lost_kickoff": 1, "removed": 1}
    assert {k: r[k] for k in want} == want and r.periods == [1, 2, 4] and not r.passed
    assert r.blockers == ["missing_identity", "unknown_team", "self_match", "repeated_id", "repeated_pairing", "missing_periods"] and "no_comparison" not in r.warnings
    clean = h.horizon_report(fixtures.where("match_id = 5").replace(9, 2, subset=["home_id"]), teams, 4, 4).first()
    assert clean.passed and clean.blockers == [] and clean.warnings == ["no_comparison"]
    assert h.horizon_report(fixtures.where("false"), teams, 1, 2).first().blockers == ["missing_periods"]


def test_season_report(spark):
    fixtures = spark.createDataFrame([("a", 1, 1, 2, True, 1), ("a", 2, 2, 1, None, 1), ("b", 1, 1, 3, False, 2)], "season string, period int, home_id long, away_id long, finished boolean, match_id long")
    stats = spark.createDataFrame([("a", 1, 7, 90, 2), ("a", 1, 7, None, 1), ("c", 3, 8, 10, None)], "season string, period int, player_id long, minutes long, points long")
    got = {r.season: r for r in su.season_report(fixtures, stats).collect()}
    assert sorted(got) == ["a", "b", "c"]
    a, b, c = (got[k] for k in "abc")
    assert (a.fixtures, a.fixture_periods, a.finished, a.sides, a.repeated_fixtures, a.player_rows, a.players, a.minutes, a.points, a.repeated_player_rows) == (2, 2, 1, 4, 1, 2, 1, 90, 3, 1)
    assert (b.player_rows, b.player_first, b.ready_for_priors, b.ready_for_matches) == (0, None, False, True) and (c.fixtures, c.points, c.ready_for_priors, c.ready_for_matches) == (0, 0, True, False)
