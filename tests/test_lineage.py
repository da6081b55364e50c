import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage as li
from tidemark.operators import picks as p
from tidemark.operators import rules as ru
from tidemark.operators.projection import keeper_share, project
from tidemark.sources import staging as st

PLAYER = "player_id long, position string, club long, price double, tier string, safe_prior boolean, unknown_role boolean, appearance double, start double, minutes_if_playing double, minutes double, points_per_90 double, goals_per_90 double, assists_per_90 double, bonus_per_90 double, minutes_signal double, rate_signal double, chance double, team_goals double, opponent_goals double"
FALLBACK = {"appearance": 0.5, "start": 0.4, "minutes_if_playing": 70.0, "minutes": 40.0, "points_per_90": 3.0, "goals_per_90": 0.1, "assists_per_90": 0.1, "bonus_per_90": 0.2}


def projected(spark, *rows, fallback=FALLBACK):
    df = spark.createDataFrame(rows, PLAYER).withColumns({f"fallback_{k}": F.lit(v).cast("double") for k, v in fallback.items()})
    return {r.player_id: r for r in project(df, 1.4, 0.25).collect()}


def player(i, position="MID", tier="high_sample", safe=True, unknown=False, chance=None, goals=(1.4, 1.4), own=(1.0, 0.9, 80.0, 80.0, 6.0, 0.4, 0.3, 0.5), price=5.0):
    return (i, position, 1, price, tier, safe, unknown, *own, 1.05, 0.95, chance, *goals)


def test_parts_add_up_and_stay_in_their_ranges(spark):
    rows = [player(i, position, tier, safe, unknown, chance) for i, (position, tier, safe, unknown, chance) in enumerate(itertools.product(("GKP", "DEF", "MID", "FWD"), ("zero_sample", "low_sample", "high_sample", None), (True, False, None), (True, False), (None, 0.0, 0.5)))]
    for r in projected(spark, *rows).values():
        parts = r.appearance_points + r.goal_points + r.assist_points + r.clean_sheet_points + r.bonus_points + r.other_points
        assert parts == pytest.approx(r.points) and 0 <= r.points <= 15
        assert 0 <= r.start_chance <= r.appearance_chance <= 1 and 0 <= r.minutes_low <= r.expected_minutes <= r.minutes_high <= 90


def test_a_prior_counts_as_far_as_its_sample(spark):
    got = projected(spark, player(1), player(2, safe=False), player(3, tier="zero_sample"), player(4, chance=0.0))
    assert got[1].expected_minutes == pytest.approx(0.85 * 80 + 0.15 * 40)
    assert got[2].expected_minutes == got[3].expected_minutes == pytest.approx(40)
    assert got[4].expected_minutes == got[4].points == 0
    width = {i: (r.minutes_low, r.minutes_high) for i, r in got.items()}
    assert width[2] == (pytest.approx(2), pytest.approx(78)) and width[3] == (pytest.approx(0), pytest.approx(80))  # 38 without a safe prior, 40 without a sample


def test_values_missing_on_one_side_or_both(spark):
    nothing = (None,) * 8
    assert projected(spark, player(1, own=nothing))[1].expected_minutes == pytest.approx(40)
    none = dict.fromkeys(FALLBACK)
    assert projected(spark, player(1), fallback=none)[1].expected_minutes == pytest.approx(80)
    assert projected(spark, player(1, own=nothing), fallback=none)[1].points == 0


def test_points_beyond_the_guardrail(spark):
    r = projected(spark, player(1, own=(1.0, 1.0, 90.0, 90.0, 60.0, 0.4, 0.3, 0.5), goals=(3.0, 0.2)))[1]
    assert r.points == 15 and r.guardrail < 0 and r.fixture_multiplier == pytest.approx(1.1125)


def test_goalkeepers_of_a_club_share_its_matches(spark):
    rows = [(1, "GKP", 5.0, 0.9), (1, "GKP", 4.0, None), (1, "GKP", None, 0.2), (1, "DEF", 5.0, 0.9), (2, "GKP", 4.0, 0.0)]
    got = spark.createDataFrame(rows, "club long, position string, price double, appearance double").withColumn("share", keeper_share()).collect()
    assert sum(r.share for r in got if r.club == 1 and r.position == "GKP") == pytest.approx(0.98)
    assert [r.share for r in got if r.position == "DEF"] == [None] and [r.share for r in got if r.club == 2] == [pytest.approx(0.98)]


MEMBER = "squad_id long, player_id long, position string, club long, price long"
SQUAD = [(1, i, position, i, 60) for i, position in enumerate(["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3)]


@pytest.mark.parametrize(
    ("out", "into", "errors"),
    [
        ([], [], []),
        ([14], [(1, 99, "FWD", 99, 60)], []),
        ([14], [(1, 99, "MID", 99, 60)], ["squad_after"]),
        ([14], [(1, 99, "FWD", 99, 161)], ["squad_after"]),
        ([14], [], ["counts_differ", "squad_after"]),
        ([77], [(1, 99, "FWD", 99, 60)], ["outgoing_not_owned", "squad_after"]),
        ([14, 14], [(1, 99, "FWD", 99, 60)], ["repeated_outgoing", "counts_differ"]),
        ([14], [(1, 13, "FWD", 13, 60)], ["incoming_owned", "squad_after"]),
        ([14, 13], [(1, 99, "FWD", 99, 60), (1, 99, "FWD", 99, 60)], ["repeated_incoming", "squad_after"]),
    ],
)
def test_transfers(spark, out, into, errors):
    current, outgoing = spark.createDataFrame(SQUAD, MEMBER), spark.createDataFrame([(1, i) for i in out], "squad_id long, player_id long")
    got = ru.transfer_legality(current, outgoing, spark.createDataFrame(into, MEMBER)).first()
    assert got.errors == errors and got.valid == (not errors) and got.transfers == max(len(out), len(into))


def test_wildcard_squads(spark):
    rows = [("s", i, ("GKP", "DEF", "MID", "FWD")[i % 4], i % 9, 40, period, (i * 7 + period * 3) % 11) for i in range(48) for period in (1, 2, 3)]
    horizon = spark.createDataFrame(rows, "scenario string, player_id long, position string, club long, price long, period long, points long")
    got = p.wildcard_squads(horizon, 1, 2, locked=[0, 3]).collect()
    members = spark.createDataFrame([(1, r.player_id, r.position, r.club, r.price) for r in got], MEMBER)
    assert ru.squad_legality(members).first().valid and {0, 3} <= {r.player_id for r in got}
    starters = [r for r in got if r.starts]
    order = sorted(starters, key=lambda r: (-r.first_points, -r.points, r.player_id))
    assert len(starters) == 11 and order[0].captain and order[1].vice and sum(r.captain + r.vice for r in got) == 2
    assert p.wildcard_squads(horizon, 1, 2, locked=[999]).count() == 0


RUN = "run_id string, run_type string, season string, source_season string, period long, horizon long, as_of timestamp, created_at timestamp, started_at timestamp, completed_at timestamp, parents array<string>, feature_version string, artifact_version string, model_version string, manifest_version string, rules_versions string"
T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


@pytest.mark.parametrize(
    ("changed", "problems"),
    [
        ({}, []),
        ({"run_type": None}, ["unknown_run_type"]),
        ({"season": "2025"}, ["season_format"]),
        ({"season": "2025_27"}, ["season_format"]),
        ({"source_season": "2026_27"}, ["source_after_target"]),
        ({"period": 36}, ["horizon_too_long"]),
        ({"period": 34}, []),
        ({"horizon": None}, ["horizon_required"]),
        ({"period": None}, ["period_required", "horizon_without_period"]),
        ({"period": None, "horizon": None}, ["period_required"]),
        ({"run_type": "model", "period": None, "horizon": None}, []),
        ({"run_type": "publishing", "period": None, "horizon": None}, ["period_required"]),
        ({"rules_versions": ""}, ["rules_versions_required"]),
        ({"created_at": T1, "as_of": T2}, ["as_of_after_created"]),
        ({"started_at": T2, "completed_at": T1}, ["started_after_completed"]),
        ({"parents": ["r"]}, ["own_parent"]),
        ({"rules_versions": None}, ["rules_versions_required"]),
        ({"run_type": "feature", "model_version": None}, []),
    ],
)
def test_run_records(spark, changed, problems):
    run = {"run_id": "r", "run_type": "prediction", "season": "2025_26", "source_season": "2024_25", "period": 1, "horizon": 5, "as_of": T1, "created_at": T2, "started_at": None, "completed_at": None, "parents": [], **dict.fromkeys(("feature_version", "artifact_version", "model_version", "manifest_version", "rules_versions"), "v1")} | changed
    got = li.run_problems(spark.createDataFrame([tuple(run[c.split()[0]] for c in RUN.split(", "))], RUN)).first()
    assert got.problems == problems and got.valid == (not problems)


def test_run_ids(spark):
    rows = [("model", " My  Model_v1.2! ", "2025_26", None, T1), ("model", None, "2025_26", 3, T1)]
    got = [r[0] for r in spark.createDataFrame(rows, "run_type string, artifact string, season string, period long, created_at timestamp").select(li.run_id()).collect()]
    assert got[0].startswith("My-Model_v1.2_2025_26_season_20250101T000000000000Z_") and got[1].startswith("model_2025_26_gw3_") and len(set(got)) == 2


def test_registries(spark):
    rows = [("a", "goals", ["live"], {"f": "1"}, "active", True, True), ("b", "goals", ["live", "test"], {"f": "2"}, "active", False, True), ("c", "goals", ["live"], {}, "archived", True, False), ("d", "goals", ["test"], {"f": "1", "g": "9"}, "active", True, False)]
    models = spark.createDataFrame(rows, "name string, task string, modes array<string>, features map<string,string>, status string, production_ready boolean, is_default boolean")
    names = lambda *a, **k: sorted(r.name for r in li.compatible(models, "goals", *a, **k).collect())
    assert names("live", {"f": "1"}) == ["a"] and names("test", {"f": "2"}) == ["b"] and names("test", {"f": "2"}, production_only=True) == [] and names("live", {}) == []
    assert [tuple(r) for r in li.default_problems(models).collect()] == [("goals", "live", 2)]


def test_snapshots_are_written_once_and_counted(spark, tmp_path):
    record = li.snapshot(spark.range(7), str(tmp_path / "s"), {"run_id": "r"}).first()
    assert (record.run_id, record.rows, record.columns) == ("r", 7, 1) and spark.read.parquet(record.path).count() == 7
    with pytest.raises(Exception, match="(?i)exists"):
        li.snapshot(spark.range(7), str(tmp_path / "s"), {})


def test_older_rows(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, "none", None), (3, "club", 0), (4, "full_prior", 2)], "old long, fallback_policy string, fallback_level int")
    got = li.adapt(rows, {"id": "old", "unit": "absent"}, {"unit": "x"}).collect()
    assert [(r.id, r.unit, r.fallback_used, r.fallback_level) for r in got] == [(1, "x", False, None), (2, "x", False, None), (3, "x", True, 0), (4, "x", True, 2)]


def test_staging_rows(spark):
    raw = spark.createDataFrame([("7.0", " A ", "3", "12.0", None), ("x9", "nan", "three", "NaN", " kept "), (" ", "B", "1", "1", None), (None, None, None, None, None)], "raw_id string, name string, points string, canonical_id string, mapping_status string")
    got = st.staging_rows(raw, "2025_26", ["raw_id"], ["name", "absent"], {"points": "long"}, "canonical_id").collect()
    assert [tuple(r) for r in got] == [("2025_26", "7", "A", None, 3, 12, "mapped"), ("2025_26", "x9", None, None, None, None, "kept")]
    with pytest.raises(ValueError, match="raw_id"):
        st.staging_rows(raw.drop("raw_id"), "2025_26", ["raw_id"])


def test_the_pool_and_its_problems(spark):
    rows = [("1", "a", "2", "mid", "5.5", None, "75", "True"), ("2", "b", "2", "fwd", "x", "d", "101", "no"), ("3", "c", "2", None, None, None, "often", None), ("4", "d", None, "mid", "5", None, None, "1"), ("5", "e", "1", "gkp", "5", None, "", "1"), ("5", "e", "1", "gkp", "5", None, None, "1")]
    df = spark.createDataFrame(rows, "player_id string, name string, team_id string, position string, price string, status string, chance string, eligible string")
    got = {(r.player_id, r.chance): (r.problem, r.price, r.eligible) for r in st.player_pool(df).collect()}
    assert got == {(1, 75.0): (None, 5.5, True), (2, 101.0): ("chance_out_of_range", None, False), (3, None): ("chance_out_of_range", None, False), (4, None): ("missing_id", 5.0, True), (5, None): ("repeated_id", 5.0, True)}


def test_imports_are_dry_unless_told_and_replace_one_season(spark, tmp_path):
    rows, path = spark.createDataFrame([("7", 1), ("8", 2)], "raw string, points int"), str(tmp_path / "t")
    mapping = spark.createDataFrame([("7", 70), ("7", 71), ("9", None)], "raw_id string, canonical_id long")
    part, whole = st.mapped(rows, mapping, "raw", "id"), st.mapped(rows, mapping, "raw", "id", direct=True)
    assert sorted(tuple(r) for r in whole.select("raw", "id").collect()) == [("7", 70), ("8", 8)]
    assert [r.id for r in st.mapped(rows, None, "raw", "id").collect()] == [None, None]
    tell = lambda df, season, write: tuple(st.import_rows(df, path, season, ["id"], write).first())
    assert tell(whole, "a", False) == (2, 0, False) and tell(part, "a", True) == (2, 1, False) and not (tmp_path / "t").exists()
    assert tell(whole, "a", True) == tell(whole, "b", True) == tell(whole, "a", True) == (2, 0, True)
    assert spark.read.parquet(path).groupBy("season").count().where("count = 2").count() == 2
    assert tell(whole.limit(0), "a", True) == (0, 0, False)


def test_templates_take_the_most_frequent_name(spark):
    rows = spark.createDataFrame([("1.0", "b"), ("1", "b"), ("1", "a"), ("2", None), ("2", "z"), (None, "q")], "raw string, name string")
    got = sorted((r.raw, r.name, r.rows) for r in st.mapping_template(rows, "raw", "name").collect())
    assert got == [("1", "b", 3), ("2", "z", 2)]
