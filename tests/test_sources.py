import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import learned
from tidemark.operators import relational as rel
from tidemark.operators import summaries as s
from tidemark.sources import readers as rd
from tidemark.sources import writers as wr
from tidemark.streaming import live


def test_csv_aliases_and_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Element,ROUND,minutes\n1,2,90\n")
    rows = rd.resolve_aliases(rd.read_csv(spark, f"{tmp_path}/a.csv"), {"player": ["element"], "gw": ["round", "event"], "bonus": ["bps"]}, optional=["bonus"])
    assert rows.first().asDict() == {"player": "1", "gw": "2", "bonus": None}
    with pytest.raises(ValueError, match="minutes"):
        rd.require_columns(rows, ["minutes"])
    with pytest.raises(ValueError, match="x"):
        rd.resolve_aliases(rows, {"x": []})
    assert rd.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/a.csv"]) == f"{tmp_path}/a.csv"


def test_json_artifacts_newest_first_broken_ones_left_out(spark, tmp_path):
    for i, body in enumerate(['{"name": "a", "kind": "x"}', "{broken", '{"name": "b", "kind": "x"}', '{"name": "c", "kind": "y"}']):
        (tmp_path / f"{i}.json").write_text(body)
        time.sleep(0.02)
    got = rd.read_json_artifacts(spark, str(tmp_path), "name string, kind string", F.col("kind") == "x")
    assert [r.name for r in got.collect()] == ["b", "a"]
    assert rd.list_objects(spark, str(tmp_path), with_digest=True).count() == 4


def test_nested_documents(spark, tmp_path):
    doc = {"teams": [{"id": 1, "name": "A"}, {"id": 2, "name": "B"}], "element_types": [{"id": 1, "singular_name_short": "GKP"}], "elements": [{"id": 9, "element_type": 1}, {"id": 8, "element_type": 5}], "events": [{"id": 1, "deadline": "2024-01-01"}], "fixtures": [{"id": 5, "event": 1, "team_h": 1, "team_a": 2}, {"id": 6, "event": 9, "team_h": 2, "team_a": 1}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    df = spark.read.json(f"{tmp_path}/d.json", multiLine=True)
    teams, players, events = rd.flatten_bootstrap(df)
    assert teams.count() == 2 and {r.id: r.position for r in players.collect()} == {9: "GKP", 8: None} and events.count() == 1
    assert [(r.id, r.home_name, r.away_name) for r in rd.flatten_fixtures(df, teams, 1, 3).collect()] == [(5, "A", "B")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k long, part string, v double")
    wr.replace_partitions(df, f"{tmp_path}/t", ["part"])
    wr.replace_partitions(df.where("part = 'a'").withColumn("v", F.lit(9.0)), f"{tmp_path}/t", ["part"])
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {1: 9.0, 2: 3.0}
    wr.write_once(df, f"{tmp_path}/once")
    with pytest.raises(Exception, match="already exists"):
        wr.write_once(df, f"{tmp_path}/once")
    counts = wr.partition_counts(df, df.where("k = 1"), ["k"]).first()
    assert (counts.inserted, counts.updated) == (1, 1)
    assert wr.artifact_key("2024_25", 3, "20240101", "v1", "r-1") == "season=2024_25/gw=3/as_of=20240101/version=v1/run_id=r-1"
    for bad in ("../x", "", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            wr.artifact_key("2024_25", 3, "d", "v", bad)
    for value in (1, 2):
        wr.put_pointer(spark, f"{tmp_path}/latest.json", {"run": value})
    assert json.loads((tmp_path / "latest.json").read_text()) == {"run": 2}
    assert wr.report_lines(df.orderBy("k"), "T").splitlines()[4] == "| 1 | a | 2.0 |"
    schema = spark.createDataFrame([], "k long, extra string").schema
    wr.append_known(df, f"{tmp_path}/known", schema)
    assert spark.read.parquet(f"{tmp_path}/known").columns == ["k", "extra"]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    schema = "id long, gw long, points long, version long"
    batches = [[(1, 1, 2, 1), (2, 1, 3, 1)], [(1, 1, 5, 2), (3, 2, 1, 1)], [(2, 1, 9, 0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    for i in range(3):
        live.upsert_stream(spark, f"{tmp_path}/in/{i}", schema, f"{tmp_path}/out", ["id", "gw"], "version", f"{tmp_path}/ck{i}", "gw").awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = live.latest(every, ["id", "gw"], [F.desc("version")])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("id", "gw", "points", "version").collect())) == sorted(map(tuple, want.select("id", "gw", "points", "version").collect()))


def test_text_rules(spark):
    df = spark.createDataFrame([(" Ødegård & Söns-Straße ", "12.0", "YES", "[\"a\", \"\"]", "2026_27"), ("Son", " ", "maybe", "a, b,,", "2026_28"), (None, None, None, None, None)], "n string, i string, b string, l string, s string")
    got = df.select(t.normal_name("n").alias("n"), t.initial_surname("n").alias("v"), t.raw_id("i").alias("i"), t.to_bool("b").alias("b"), t.text_list("l").alias("l"), t.season_valid("s").alias("s")).collect()
    assert [tuple(r) for r in got] == [("odegard and sons strasse", "o strasse", "12", True, ["a"], True), ("son", None, None, None, ["a", "b"], False), (None, None, None, None, [], False)]
    ts, status = t.kickoff("k")
    got = spark.createDataFrame([("2024-05-01T12:00:00Z",), ("nope",), ("",), (None,)], "k string").select(ts.alias("t"), status.alias("s")).collect()
    assert [r.s for r in got] == ["known", "invalid", "missing", "missing"]
    assert spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(t.matching_ratio("a", "b").alias("r")).collect()[0].r == 0.75


def test_relational_rules(spark):
    a = spark.createDataFrame([(1, 5.0, "x"), (2, None, "y")], "k long, v double, w string")
    b = spark.createDataFrame([(1, 5.0, "x"), (2, None, "z"), (3, 1.0, "n")], "k long, v double, w string")
    diff = {r.k: r.status for r in rel.snapshot_diff(a, b, ["k"], ["v", "w"]).collect()}
    assert diff == {1: "unchanged", 2: "changed", 3: "new"}
    assert {r.k: r.status for r in rel.snapshot_diff(b, b, ["k"], ["v", "w"]).collect()} == dict.fromkeys((1, 2, 3), "unchanged")
    with pytest.raises(Exception, match="the right side repeats keys"):
        rel.guarded_join(a, b.union(b), ["k"]).collect()
    with pytest.raises(Exception, match="the left side repeats keys"):
        rel.guarded_join(a.union(a), b.drop("v", "w"), ["k"], cardinality="one_to_one").collect()
    assert rel.guarded_join(a.union(a), b.select("k", F.lit(1).alias("one")), ["k"]).count() == 4
    assert rel.where_given(a, k=None, v=(4.0, None)).count() == 1
    assert spark.createDataFrame([("50%",), ("500",)], "s string").where(rel.contains_text("s", "0%")).count() == 1
    with pytest.raises(ValueError):
        rel.page(a, [F.col("k")], 0, 500)


@pytest.mark.parametrize("how", ["left", "inner", "full", "right", "full_outer"])
@pytest.mark.parametrize("cardinality", ["one_to_one", "many_to_one"])
def test_guarded_joins_with_null_keys(spark, how, cardinality):
    a = spark.createDataFrame([(1, 1, "a"), (1, None, "b"), (None, None, "c"), (None, 1, "d"), (3, 1, "e"), (1, None, "f")], "k int, j int, x string")
    b = spark.createDataFrame([(1, 1, "p"), (None, 1, "q"), (1, None, "r"), (1, None, "s"), (4, 1, "t")], "k int, j int, y string")
    got, want = rel.guarded_join(a, b, ["k", "j"], how, cardinality), a.join(b, ["k", "j"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 1, None, 4), ("a", 2, None, None), ("b", 1, 3, 1)], "g string, t long, m long, v long")
    got = {r.g: (r.minutes, r.value_last, r.appearances) for r in s.season_summary(rows.withColumn("p", F.lit(1)), ["g"], "t", "m", "p", "v", 60).collect()}
    assert got == {"a": (0, 4, 0), "b": (3, 1, 1)}
    assert {r.g: r.p_per_90 for r in s.priors(rows.withColumn("p", F.lit(1)), ["g"], "m", ["p"]).collect()} == {"a": None, "b": 30.0}
    bands = s.quantile_bands(spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)], "g string, x long"), ["g"], "x")
    assert [r.band for r in bands.orderBy("x").collect()] == ["low", "mid", "high", "top"]


def test_ridge_is_the_closed_form(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + draw.normal(size=60)
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    model = learned.ridge(rows, ["a", "b", "c"], "y", 5.0).stages[-1]
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-6)
