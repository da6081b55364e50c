import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checks as ck
from tidemark.operators import horizon as h
from tidemark.operators import identity as idt
from tidemark.operators import models as m
from tidemark.operators import picks as p
from tidemark.operators import rules as ru
from tidemark.plans.registry import QUERIES, load

load()

EVENTS = "position string, minutes long, goals long, assists long, saves long, penalty_saves long, yellow_cards long, red_cards long, own_goals long, penalty_misses long, conceded long, bonus long, contributions long, clean_sheet boolean, as_goalkeeper boolean"


@pytest.mark.parametrize(
    ("row", "total"),
    [
        (("GKP", 90, 1, 0, 7, 1, 0, 0, 0, 0, 0, 3, 0, True, False), 2 + 10 + 4 + 2 + 5 + 3),
        (("DEF", 59, 0, 1, 0, 0, 1, 0, 0, 0, 3, 0, 10, True, False), 1 + 3 - 1 - 1 + 2),
        (("MID", 90, 0, 0, 0, 0, 1, 1, 1, 1, 5, 0, 11, False, False), 2 - 3 - 2 - 2),
        (("FWD", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 12, True, False), 2),
        (("FWD", 10, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, False, False), None),
        (("MID", 10, 0, 0, 3, 0, 0, 0, 0, 0, 0, 1, 0, False, True), 1 + 1 + 1),
        (("XXX", 10, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, False, False), None),
    ],
)
def test_match_scores(spark, row, total):
    assert ru.score(spark.createDataFrame([row], EVENTS)).first().total_points == total


def pool(seed, n=18):
    draw = random.Random(seed)
    rows = [("s", i, ["GKP", "DEF", "MID", "FWD"][i % 4], draw.randint(1, 6), draw.randint(3, 12), draw.randint(0, 30)) for i in range(n)]
    return pd.DataFrame(rows, columns=["scenario", "player_id", "position", "club", "price", "points"])


QUOTAS = {"GKP": 1, "DEF": 2, "MID": 2, "FWD": 1}


def brute(pdf, budget, per_club):
    best = None
    groups = [itertools.combinations(pdf[pdf.position == k].to_dict("records"), n) for k, n in QUOTAS.items()]
    for parts in itertools.product(*map(list, groups)):
        team = [x for part in parts for x in part]
        clubs = [x["club"] for x in team]
        if sum(x["price"] for x in team) <= budget and max(map(clubs.count, clubs)) <= per_club:
            best = max(best or 0, sum(x["points"] for x in team))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_the_best_squad_is_the_best_of_all(seed):
    pdf = pool(seed)
    for budget, per_club in ((40, 2), (35, 1), (60, 3)):
        chosen, proved = p.exact_squad(pdf, QUOTAS, budget, per_club)
        want = brute(pdf, budget, per_club)
        assert proved and (chosen["points"].sum() if want is not None else len(chosen)) == (want or 0)
        greedy = p.greedy_squad(pdf, QUOTAS, budget, per_club)
        if len(greedy):
            assert greedy["price"].sum() <= budget and greedy["points"].sum() <= want and greedy["club"].value_counts().max() <= per_club


def test_squads_in_spark_and_pruning_changes_nothing(spark):
    pdf = pool(99, 40)
    df = spark.createDataFrame(pdf)
    got = p.squads(df, True, QUOTAS, 45, 2).collect()
    assert sum(r.points for r in got) == p.exact_squad(pdf, QUOTAS, 45, 2)[0]["points"].sum() and all(r.proved for r in got)
    assert p.candidates(df, per_club=2).count() < len(pdf)


def test_legality(spark):
    team = [("x", i, pos, i % 5, 60) for i, pos in enumerate(["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3)]
    bad = [("y", 1, "GKP", 1, 2000), ("y", 1, "GKP", 1, 1)]
    got = {r.squad_id: r.errors for r in ru.squad_legality(spark.createDataFrame(team + bad, "squad_id string, player_id long, position string, club long, price long")).collect()}
    assert got["x"] == [] and got["y"] == ["squad_size", "duplicate_players", "position_quotas", "budget"]
    starts = {0, 2, 3, 4, 7, 8, 9, 10, 12, 13, 14}
    lines = [("x", i, pos, i in starts, i == 14, i == 13) for _, i, pos, *_ in team]
    schema = "squad_id string, player_id long, position string, starts boolean, captain boolean, vice boolean"
    assert ru.lineup_legality(spark.createDataFrame(lines, schema)).first().valid
    worse = [(s, i, pos, st, i == 1, v) for s, i, pos, st, _, v in lines]
    assert ru.lineup_legality(spark.createDataFrame(worse, schema)).first().errors == ["captain_not_starting"]
    assert p.best_lineup(pd.DataFrame([(i, pos, 5.0 if i in starts else 1.0) for _, i, pos, *_ in team], columns=["player_id", "position", "points"])) == sorted(starts)


def test_transfer_bank_against_a_loop(spark):
    draw = random.Random(2)
    rows = [(g, w, draw.randint(0, 3), draw.choice([None, None, None, "wildcard"])) for g in range(20) for w in range(1, 12)]
    got = {r.manager_id: r.free_transfers for r in ru.bank_after(spark.createDataFrame(rows, "manager_id long, week long, used long, chip string"), {6: 5}).collect()}
    for g in range(20):
        bank = 1
        for _, w, used, chip in (r for r in rows if r[0] == g):
            bank = bank if chip else min(5, bank - min(bank, used) + 1)
            bank = max(bank, 5) if w == 6 else bank
        assert got[g] == bank


def test_missing_predictions_stay_missing(spark):
    players = spark.createDataFrame([(1, 10, True), (2, 20, True), (3, 10, False)], "player_id long, team_id long, selectable boolean")
    sides = spark.createDataFrame([(10, 1, 7, 20, "2024-01-01"), (20, 1, 7, 10, "2024-01-01"), (10, 2, 8, 30, None)], "team_id long, period long, match_id long, opponent_id long, kickoff string").withColumn("kickoff", F.to_timestamp("kickoff"))
    long = h.long_horizon(h.eligibility(players, sides, 1, 2), spark.createDataFrame([(1, 1, 4.0), (2, 1, 0.0)], "player_id long, period long, points double"), 1)
    got = {(r.player_id, r.period): (r.row_status, r.points, r.discounted) for r in long.collect()}
    assert got == {(1, 1): ("available", 4.0, 4.0), (2, 1): ("available", 0.0, 0.0), (3, 1): ("ineligible", None, None), (1, 2): ("ineligible", None, None), (2, 2): ("blank", None, None), (3, 2): ("ineligible", None, None)}
    assert h.mode_of(long.where("player_id < 3"), 1, 2).first().mode == "first_only"
    totals = {r.player_id: (r.points, r.missing_periods) for r in h.player_totals(long).collect()}
    assert totals == {1: (4.0, "2"), 2: (0.0, "2"), 3: (None, "1|2")}


def test_predictions_meet_players_before_fixtures_multiply_them(spark):
    """What the fixtures multiply was dealt and sorted again for the join with the predictions."""
    players = spark.createDataFrame([(1, 10, True), (2, 11, True), (3, 10, False)], "player_id long, team_id long, selectable boolean")
    sides = spark.createDataFrame([(10, 1, 5, 11), (10, 1, 6, 12), (11, 1, 5, 10), (10, 3, 7, 11)], "team_id long, period long, match_id long, opponent_id long").withColumn("kickoff", F.lit(0))
    predictions = spark.createDataFrame([(1, 1, 4.0), (2, 1, 0.0), (2, 2, None), (9, 1, 1.0)], "player_id long, period long, points double")
    late = h.long_horizon(h.eligibility(players, sides, 1, 3), predictions, 1)
    early = h.long_horizon(h.eligibility(players, sides, 1, 3, predictions), None, 1)
    assert early.count() == late.count() == 11 and early.select(*late.columns).exceptAll(late).isEmpty()
    joins = [x for x in QUERIES["p16_long_horizon"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "team_id" in joins[0] and "player_id" in joins[1]


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 1.5), (None, None)], "k long, p double")
    got = {r.name: (r.passed, r.value) for r in ck.suite(ck.column_spec(df, "t", unique=["k"], required=["k"]), ck.row_checks(df, "t", {"range": ~F.col("p").between(0, 1)})).collect()}
    assert got == {"t.k_null": (False, 1), "t.duplicate_keys": (False, 1), "t.range": (False, 1)}


def test_identity(spark):
    left = idt.with_variants(spark.createDataFrame([(1, "José Müller"), (2, "Ann Lee")], "l long, name string"), "name")
    right = idt.with_variants(spark.createDataFrame([(7, "J. Muller"), (8, "Jose Muller"), (9, "Bob Stone")], "r long, other string"), "other").withColumnRenamed("variants", "others")
    pairs = idt.blocked_pairs(left, right.withColumnRenamed("others", "variants"), "l", "r").join(left, "l").join(right, "r")
    scores = {(x.l, x.r): x.name_score for x in idt.variant_score(pairs, "variants", "others", ["l", "r"]).collect()}
    assert scores[(1, 8)] == 1.0 and scores[(1, 7)] == 1.0 and (2, 7) not in scores
    rows = spark.createDataFrame([(1, 7, 0.97), (1, 8, 0.9), (2, 7, 0.99), (3, 9, 0.98), (3, 8, 0.975), (4, 5, 0.5)], "l long, r long, s double")
    got = {x.l: x.status for x in idt.approve(idt.rank_candidates(rows, "l", "r", "s"), "l", "r", "s").collect()}
    assert got == {1: "duplicate_target", 2: "auto_approved", 3: "manual_review", 4: "manual_review"}


def test_probabilities(spark):
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(m.softmax([F.lit(1.0), F.lit(2.0), F.lit(800.0)]), "abc")), m.argmax_label({"H": F.lit(0.4), "D": F.lit(0.4), "A": F.lit(0.2)}).alias("best"), m.weighted_blend(F.lit(None).cast("double"), F.lit(3.0), 0.7).alias("blend")).first()
    assert row.a + row.b + row.c == pytest.approx(1) and (row.best, row.blend) == ("H", 3.0)
    grid = m.score_grid(spark.createDataFrame([(1, 1.4, 0.9)], "k long, h_mean double, a_mean double"), ["k"], "h_mean", "a_mean")
    out = m.outcome_chances(grid, ["k"]).first()
    assert grid.count() == 121 and out.p_home + out.p_draw + out.p_away == pytest.approx(1) and 0 < out.tail < 1e-5
    assert [r.score for r in m.top_scores(grid, ["k"], 2).orderBy("place").collect()] == ["1-0", "1-1"]


def test_score_grid_within_the_row(spark):
    """Every scoreline was a row that was dealt twice, to be summed and to be ranked."""
    rows = spark.createDataFrame([(i, 0.3 + i % 7 / 3, 0.3 + i // 7 / 3) for i in range(49)], "k long, lh double, la double")
    grid = m.score_grid(rows, ["k"], "lh", "la")
    want = m.outcome_chances(grid, ["k"]).join(m.top_scores(grid, ["k"], 1).select("k", "score"), "k")
    got = m.scored_grid(rows, "lh", "la")
    assert got.count() == 49 and got.select(want.columns).exceptAll(want).isEmpty()
    plan = QUERIES["m18_scoreline_preview"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "row_number" not in plan


def test_locked_players_and_relaxation():
    pdf = pool(3, 40)
    got = p.greedy_squad(pdf, QUOTAS, 60, 3, locked=[0, 5])
    assert {0, 5} <= set(got["player_id"]) and got["position"].value_counts().to_dict() == QUOTAS and got["price"].sum() <= 60
    assert len(p.greedy_squad(pdf, QUOTAS, 60, 3, locked=[0, 4])) == 0 and len(p.greedy_squad(pdf, QUOTAS, 60, 3, locked=[999])) == 0
    chosen, step, proved = p.relaxed_squad(pdf, [(1, 1), (2, 3), (60, 2)], QUOTAS)
    assert step == 2 and proved and chosen["price"].sum() <= 60 and p.relaxed_squad(pdf, [(1, 1)], QUOTAS)[1] == -1
