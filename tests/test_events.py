from datetime import datetime

import pytest

from tidemark.operators import events as e

SCHEMA = "match_id long, season long, period long, kickoff timestamp, home_id long, away_id long, home_score long, away_score long"


def day(n):
    return datetime(2024, 1, n)


MATCHES = [(1, 1, 1, day(1), 1, 2, 3, 0), (2, 1, 1, day(1), 3, 4, 1, 1), (3, 1, 2, day(8), 2, 1, 2, 2), (4, 1, 2, day(8), 4, 3, 0, 1), (5, 1, 3, day(15), 1, 2, 0, 4), (6, 1, 3, day(15), 1, 3, 1, 0)]


@pytest.fixture(scope="module")
def matches(spark):
    return spark.createDataFrame(MATCHES, SCHEMA)


def test_two_sides_and_standings(matches):
    sides = e.two_sided(matches)
    assert sides.count() == 12
    ctx = {(r.team_id, r.period): r for r in e.team_context(sides).collect()}
    assert ctx[(1, 1)].points_before is None and [ctx[(t, 1)].rank_before for t in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert (ctx[(1, 2)].points_before, ctx[(2, 2)].points_before) == (3, 0)
    assert [t for t, _ in sorted(((t, ctx[(t, 2)].rank_before) for t in (1, 2, 3, 4)), key=lambda x: x[1])] == [1, 3, 4, 2]
    assert ctx[(1, 3)].matches == 2 and ctx[(1, 3)].attack_recent == 2.5


def test_pair_history_sees_both_directions_and_only_the_past(matches):
    got = {r.match_id: r for r in e.pair_history(matches, 5).collect()}
    assert (got[1].meetings, got[1].home_wins, got[1].goals_mean) == (0, 0, None)
    assert (got[3].meetings, got[3].home_wins, got[3].draws, got[3].away_wins) == (1, 0, 0, 1)
    assert (got[5].meetings, got[5].home_wins, got[5].draws, got[5].away_wins, got[5].goals_mean) == (2, 1, 1, 0, 3.5)


def test_form_rest_and_ties_by_id(matches):
    form = {(r.match_id, r.team_id): r.form for r in e.recent_form(e.two_sided(matches), 2, prior=1.0).collect()}
    assert form[(1, 1)] == 1.0 and form[(5, 1)] == 2.0 and form[(6, 1)] == 0.5
    rest = {(r.match_id, r.team_id): r.rest_days for r in e.side_rest(e.two_sided(matches)).collect()}
    assert rest[(3, 1)] == 7.0 and rest[(6, 1)] == 0.0 and rest[(1, 1)] is None
    table = {r.team_id: r for r in e.form_table(e.two_sided(matches), 2).collect()}
    assert table[1].match_ids == [6, 5] and table[1].clean_sheet_rate == 0.5


def test_season_table_balances(matches):
    rows = e.season_table(e.two_sided(matches)).collect()
    assert sum(r.scored for r in rows) == sum(r.conceded for r in rows) and sum(r.won for r in rows) == sum(r.lost for r in rows)
    assert all(r.home_points + r.away_points == r.points for r in rows)


def test_opponent_context_and_empty(matches):
    rows = {(r.match_id, r.team_id): r for r in e.fixture_context(e.two_sided(matches)).collect()}
    assert rows[(1, 1)].difficulty_attack == pytest.approx(1 / 1.5) and rows[(1, 1)].difficulty_defence == 0.0
    assert rows[(3, 1)].opponent_attack_recent == 0.0 and rows[(3, 1)].difficulty_attack == pytest.approx(1 / 3.5)
    assert e.fixture_context(e.two_sided(matches.limit(0))).count() == 0
