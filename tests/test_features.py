import itertools
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import contracts as co
from tidemark.operators import events
from tidemark.operators import features as f
from tidemark.operators import identity as idt
from tidemark.operators import picks as p
from tidemark.operators import rolling as r
from tidemark.sources import readers

QUOTAS = {"GKP": 1, "DEF": 2, "MID": 2, "FWD": 1}
PLAYER = "season long, player_id long, period long, team_id long, position string, status string, price double, points long, minutes long, goals long, assists long, clean_sheets long"
MATCH = "match_id long, season long, period long, kickoff timestamp, home_id long, away_id long, home_score long, away_score long"


@pytest.fixture(scope="module")
def matches(spark):
    draw, rows, i = random.Random(3), [], 0
    for period in range(1, 9):
        teams = list(range(6))
        draw.shuffle(teams)
        for a, b in zip(teams[::2], teams[1::2]):
            i += 1
            rows.append((i, 2024, period, datetime(2024, 1, 1) + timedelta(days=7 * period + i % 3), a, b, draw.randint(0, 4), draw.randint(0, 4)))
    return spark.createDataFrame(rows, MATCH)


def test_match_features_see_nothing_of_their_own_period(spark, matches):
    got = {x.match_id: x.asDict() for x in f.match_features(matches).collect()}
    rows = [x.asDict() for x in matches.collect()]
    assert len(got) == len(rows) and len(next(iter(got.values()))) == 40
    for m in rows:
        before = [x for x in rows if x["period"] < m["period"]]

        def side(team, before=before):
            mine = [(x["home_score"], x["away_score"]) if x["home_id"] == team else (x["away_score"], x["home_score"]) for x in before if team in (x["home_id"], x["away_id"])]
            points = [3 if a > b else 1 if a == b else 0 for a, b in mine]
            return (sum(points) / len(points), sum(a for a, _ in mine[-5:]) / len(mine[-5:])) if mine else (None, None)

        g = got[m["match_id"]]
        (hp, ha), (ap, _) = side(m["home_id"]), side(m["away_id"])
        assert g["home_points_per_match"] == pytest.approx(hp) and g["away_points_per_match"] == pytest.approx(ap) and g["home_attack_recent"] == pytest.approx(ha)
        met = sorted((x["kickoff"], x["match_id"], x) for x in before if {x["home_id"], x["away_id"]} == {m["home_id"], m["away_id"]})[-3:]
        diffs = [x["home_score"] - x["away_score"] if x["home_id"] == m["home_id"] else x["away_score"] - x["home_score"] for *_, x in met]
        assert g["meetings"] == len(met)
        assert g["home_goal_diff_mean"] == (pytest.approx(sum(diffs) / len(diffs)) if diffs else None)
        assert g["home_points_mean"] == (pytest.approx(sum(3 if d > 0 else 1 if d == 0 else 0 for d in diffs) / len(diffs)) if diffs else None)


def test_match_features_are_rounded_by_period(spark, matches):
    """What a team's period says was spread over the sides, grouped back by match in 22 columns and rounded for every match."""
    odd = spark.createDataFrame([(901, 2024, 3, datetime(2024, 2, 1), None, 2, 1, 1), (902, 2024, 3, datetime(2024, 2, 1), 4, None, 0, 1), (903, 2024, 3, datetime(2024, 2, 1), None, None, 0, 1), (904, None, 3, datetime(2024, 2, 1), 1, 2, 0, 1)], MATCH)
    rows = matches.union(odd)
    exact, rounded = f.match_features(rows), f.match_features(rows, digits=2)
    real = [c for c, kind in exact.dtypes if kind == "double"]
    assert exact.dtypes == rounded.dtypes and len(real) == 25
    want = exact.withColumns({c: F.round(c, 2) for c in real})
    assert want.exceptAll(rounded).isEmpty() and rounded.exceptAll(want).isEmpty()
    got = {x.match_id: x for x in exact.collect()}
    assert len(got) == matches.count() + 2 and not {903, 904} & set(got)  # a match of one known side stays, with what that side says
    one = got[901]
    assert one.away_rank_before is not None and one.away_rest_days is not None and one.away_difficulty == one.away_difficulty_attack == pytest.approx(2 / 3) and one.away_difficulty_defence == 0
    assert all(one[f"home_{c}"] is None for c in f.SIDE) and one.rank_diff is None and one.strength_diff is None
    assert got[902].home_difficulty == pytest.approx(2 / 3) and got[902].away_difficulty is None
    plan = f.match_features(matches, digits=2)._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("max(") for line in plan.splitlines()) == 2  # by match only the two sides' days of rest are grouped


def test_player_features(spark, matches):
    rows = [(2024, i, period, i % 7, "MID" if i else None, "a", 5.0, period * (i + 1), 90 if period % 2 else 0, 1, 0, 0) for i in range(9) for period in range(1, 6)]
    rows.append((2024, 50, 1, 0, "GKP", "d", None, 1, None, 0, 0, 0))
    got = {(x.player_id, x.period): x.asDict() for x in f.player_features(spark.createDataFrame(rows, PLAYER), events.two_sided(matches), ["GKP", "MID"], ["a"]).collect()}
    assert set(got) == {(i, period) for i in range(9) for period in range(2, 6)}
    assert got[2, 4]["points_mean3"] == pytest.approx((3 + 6 + 9) / 3) and got[2, 4]["points_last1"] == 9 and got[2, 4]["long_matches5"] == 2
    assert got[6, 3]["fixtures"] is None and got[6, 3]["is_home"] == 0 and got[1, 3]["position_MID"] == 1 and got[0, 3]["position_MID"] in (0, None)
    assert f.player_features(spark.createDataFrame([], PLAYER), events.two_sided(matches.limit(0)), ["GKP"], ["a"]).count() == 0


def test_places_over_ranges_are_those_of_one_sort(spark):
    draw = random.Random(4)
    rows = [(i, float(draw.choice([1, 1, 1, 2, draw.random()]))) for i in range(700)]
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    got = {x.i: x["rank"] for x in r.ranked(spark.createDataFrame(rows, "i long, score double"), "score", ["i"], ranges=9).collect()}
    assert got == want
    assert r.ranked(spark.createDataFrame([], "i long, score double"), "score", ["i"]).count() == 0


def test_a_greedy_pick_from_the_candidates_is_that_from_all(spark):
    frames = []
    for seed in range(25):
        draw = random.Random(seed)
        frames += [(f"s{seed}", i, ["GKP", "DEF", "MID", "FWD"][i % 4], draw.randint(1, 4), draw.randint(3, 12), draw.randint(-2, 30)) for i in range(90)]
    columns = "scenario string, player_id long, position string, club long, price long, points long"
    pool = spark.createDataFrame(frames, columns)
    kept = p.greedy_candidates(pool, QUOTAS, 2)
    few = kept.toPandas()
    assert len(few) < 0.9 * len(frames)
    for budget in (30, 45, 70):
        for by_position in (False, True):
            for name, pdf in pd.DataFrame(frames, columns=few.columns).groupby("scenario"):
                want = p.greedy_squad(pdf.reset_index(drop=True), QUOTAS, budget, 2, by_position=by_position)
                got = p.greedy_squad(few[few["scenario"] == name].reset_index(drop=True), QUOTAS, budget, 2, by_position=by_position)
                assert got["player_id"].tolist() == want["player_id"].tolist()


def test_relaxed_squads_of_several_scenarios(spark):
    draw = random.Random(9)
    rows = [(s, i, ["GKP", "DEF", "MID", "FWD"][i % 4], draw.randint(1, 6), price, draw.randint(0, 30)) for s, price in (("cheap", 1), ("dear", 9)) for i in range(24)]
    got = p.relaxed_squads(spark.createDataFrame(rows, "scenario string, player_id long, position string, club long, price long, points long"), [(6, 1), (60, 2)], QUOTAS).toPandas()
    assert got.groupby("scenario")["step"].first().to_dict() == {"cheap": 0, "dear": 1} and len(got) == 12 and got["proved"].all()


def test_blocks_keep_misspelt_names(spark):
    """Recall of the candidates against all pairs that score 0.85 or more, spellings that start otherwise among them."""
    draw = random.Random(6)
    syllables = "ka to mi re su no ber gen au las nhe do que san ver mon tor lin".split()
    name = lambda: " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(2, 3))) for _ in range(2))
    names = [name() for _ in range(120)]

    def misspelt(n):
        at = draw.randrange(len(n))
        return draw.choice([n[:at] + n[at + 1 :], n[:at] + "x" + n[at:], n.replace(" ", "-"), "K" + n[1:], n.split(" ")[1]])

    left = idt.with_variants(spark.createDataFrame(list(enumerate(names)), "l long, name string"), "name")
    right = idt.with_variants(spark.createDataFrame([(i, misspelt(n)) for i, n in enumerate(names)], "r long, other string"), "other").withColumnRenamed("variants", "others")
    every = left.crossJoin(right)
    scored = {(x.l, x.r) for x in idt.variant_score(every, "variants", "others", ["l", "r"]).where("name_score >= 0.85").collect()}
    found = {(x.l, x.r) for x in idt.blocked_pairs(left, right.withColumnRenamed("others", "variants"), "l", "r").collect()}
    assert len(scored & found) / len(scored) >= 0.97 and len(found) < 0.5 * 120 * 120


def test_nested_values(spark):
    docs = spark.createDataFrame([('{"a": {"b": 3, "n": null}}',), ("[1]",), (None,), ("nope",)], "d string")
    got = docs.select(t.nested_get("d", ["a", "b"], "x").alias("b"), t.nested_get("d", ["a", "n"], "x").alias("n"), t.nested_get("d", ["a", "b", "c"], "x").alias("c")).collect()
    assert [tuple(x) for x in got] == [("3", None, "x")] + [("x", "x", "x")] * 3


def test_letters_and_positions(spark):
    got = spark.createDataFrame([("Ğıł ß",), ("Ødegaard",)], "n string").select(t.fold("n").alias("n")).collect()
    assert [x.n for x in got] == ["gil ss", "odegaard"]
    said = spark.createDataFrame([("1",), ("for",), ("4",), ("x",), (None,)], "s string").select(t.position_code("s").alias("c")).collect()
    assert [x.c for x in said] == ["GKP", "FWD", "FWD", None, None]


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "season string, gw long")
    assert co.scoped(df, "rows", season="a", gw=1).count() == 1
    with pytest.raises(ValueError, match="rows has no rows"):
        co.scoped(df, "rows", season="a", gw=2)
    assert co.feature_columns(df, ["gw"]) == ["season"]
    df.createOrReplaceTempView("contract_probe")
    assert readers.table_columns(spark, "contract_probe") == ["season", "gw"] and readers.table_columns(spark, "no_such_table") == []
    long = spark.createDataFrame([(1, 1, 2.0, True), (2, 1, None, True), (1, 2, 1.0, False)], "player_id long, period long, points double, ok boolean")
    audit = co.snapshot_audit(long, 1, F.col("ok"), F.col("ok"), ["points"]).first()
    assert (audit["rows"], audit.missing_points, audit.repeated_keys) == (2, 1, 0)
    with pytest.raises(Exception, match="may not be published"):
        co.snapshot_rows(long, 1, F.col("ok"), ["points"]).collect()
    old = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k long, v long")
    assert sorted(tuple(x) for x in co.replaced(old, spark.createDataFrame([(1, 9)], "k long, v long"), ["k"]).collect()) == [(1, 9), (2, 7)]


def test_a_guarded_join_fails_where_its_side_repeats_keys(spark):
    players = spark.createDataFrame([(1, 1, "MID", "a", "5")], "player_id long, team_id long, position string, status string, price string")
    teams = spark.createDataFrame([(1, "A", "a"), (1, "B", "b")], "team_id long, team string, short string")
    empty = lambda schema: spark.createDataFrame([], schema)
    rest = (empty("team_id long, fixture_id long, opponent_id long, opponent_short string"), empty("player_id long, raw_key string, mapping_status string"), empty("raw_key string, prior_source string, minutes_prior long"), empty("fixture_id long, team_id long, team_fallback boolean, opponent_fallback boolean, s double"))
    one = f.preseason_players(players, teams.limit(1), *rest, ["a"], [], ["s"]).first()
    assert one.blank and one.no_prior and one.missing_strength and one.promoted and not one.missing_price and one.mapping_status == "no_safe_accepted_mapping"
    with pytest.raises(Exception, match="right side repeats keys"):
        f.preseason_players(players, teams, *rest, ["a"], [], ["s"]).collect()


def test_lineup_plans_against_all_plans(spark):
    draw = random.Random(12)
    squads = {s: [(s, 100 * k + i, pos, 4, 50, draw.choice([0, 1, 2, 5, draw.randint(0, 9)])) for i, pos in enumerate(["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3)] for k, s in enumerate("abc")}
    rows = [r for squad in squads.values() for r in squad]
    got = p.lineup_plans(spark.createDataFrame(rows, "scenario string, player_id long, position string, club long, price long, points long")).toPandas()
    for s, squad in squads.items():
        worth, pos = {r[1]: r[5] for r in squad}, {r[1]: r[2] for r in squad}

        def value(starters, captain):
            rest = sorted((i for i in worth if i not in starters), key=lambda i: (pos[i] != "GKP", -worth[i]))
            return sum(worth[i] for i in starters) + p.CAPTAIN_BONUS * worth[captain] + sum(w * worth[i] for w, i in zip(p.BENCH_WEIGHTS, rest))

        def legal(starters):
            return all(low <= sum(pos[i] == x for i in starters) <= high for x, (low, high) in p.FORMATION.items())

        every = [c for c in itertools.combinations(worth, 11) if legal(c)]
        best = max(value(c, max(c, key=worth.get)) for c in every)
        plans = {k: v.set_index("player_id") for k, v in got[got["scenario"] == s].groupby("plan")}
        assert set(plans) == {"primary", "lineup", "captaincy"} and all(len(v) == 15 for v in plans.values())
        starters = {k: frozenset(v.index[~v["role"].str.startswith("bench")]) for k, v in plans.items()}
        assert plans["primary"]["value"].iloc[0] == pytest.approx(best)
        near = [value(c, max(c, key=worth.get)) for c in every if len(starters["primary"] - set(c)) == 1]
        assert plans["lineup"]["value"].iloc[0] == pytest.approx(max(near)) and starters["lineup"] != starters["primary"] == starters["captaincy"]
        captain = plans["primary"].index[plans["primary"]["role"] == "captain"][0]
        assert plans["captaincy"]["value"].iloc[0] == pytest.approx(max(value(starters["primary"], i) for i in starters["primary"] if i != captain))


@pytest.mark.parametrize("seed", range(8))
def test_role_squads_against_all_squads(seed):
    draw = random.Random(seed)
    quotas, formation, bench = {"GKP": 2, "DEF": 3, "MID": 2, "FWD": 1}, {"GKP": (1, 1), "DEF": (1, 2), "MID": (1, 2), "FWD": (1, 1)}, (0.05, 0.3, 0.1)
    sizes = {"GKP": 3, "DEF": 5, "MID": 4, "FWD": 3}
    rows = [(i, pos, draw.randint(1, 5), draw.randint(3, 9), draw.randint(0, 12), draw.choice([0.0, 0.5, 1.0])) for i, pos in enumerate(p_ for p_, n in sizes.items() for _ in range(n))]
    pdf = pd.DataFrame(rows, columns=["player_id", "position", "club", "price", "points", "risk"])
    worth, pos = dict(zip(pdf["player_id"], pdf["points"])), dict(zip(pdf["player_id"], pdf["position"]))
    caps = [p.Caps(), p.Caps(bench_cost=16), p.Caps(overlaps=((frozenset(range(0, 15, 2)), 3),)), p.Caps(risk=3.0)][seed % 4]

    def best_value(squad):
        found = float("-inf")
        for c in itertools.combinations(squad, 5):
            rest = sorted((i for i in squad if i not in c), key=lambda i: (pos[i] != "GKP", -worth[i]))
            legal = all(low <= sum(pos[i] == x for i in c) <= high for x, (low, high) in formation.items())
            cheap = caps.bench_cost is None or pdf[pdf["player_id"].isin(rest)]["price"].sum() <= caps.bench_cost
            if legal and cheap:
                found = max(found, sum(worth[i] for i in c) + max(worth[i] for i in c) + sum(w * worth[i] for w, i in zip(bench, rest)))
        return found

    want = float("-inf")
    for parts in itertools.product(*(itertools.combinations(pdf[pdf["position"] == x]["player_id"], n) for x, n in quotas.items())):
        squad = [i for part in parts for i in part]
        mine = pdf[pdf["player_id"].isin(squad)]
        if mine["price"].sum() > 48 or mine["club"].value_counts().max() > 2 or any(len(ids & set(squad)) > most for ids, most in caps.overlaps) or (caps.risk is not None and mine["risk"].sum() > caps.risk):
            continue
        want = max(want, best_value(squad))
    roles, value, proved = p.role_squad(pdf, quotas, formation, 48, 2, bench, 1.0, caps, starting=5)
    assert proved and (value == pytest.approx(want) if want > float("-inf") else not roles)
    assert not roles or (len(roles) == 8 and sorted(roles.values()).count("captain") == 1)
