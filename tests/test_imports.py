"""Imports of dirty files, the newest artifacts, snapshots by version."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lineage as li
from tidemark.sources import checked_csv as cc
from tidemark.sources import readers, writers

FIELDS = {"player_id": cc.Field("long", ("id", "element")), "name": cc.Field("string", ("web_name",)), "minutes": cc.Field("int", ("mins",)), "note": cc.Field("string", (), False)}
LINES = [
    "Element,Web_Name,MINS,season",
    "1,Ann,90,2024_25",
    '2,"Smith, Bob",45,2024_25',
    "three,Cat,1,2024_25",
    "4,Dan",
    "5,Eve,1,2024_25,extra",
    '6,"Fay,3,2024_25',
    "",
    "7,,3,2024_25",
    "8,Gus,3,2023_24",
    "9,Hal, 12 ,2024_25",
    "9,Hal again,13,2024_25",
    "10,Ida,9.5,2024_25",
    "11,Cut o",
]


def test_each_line_is_told_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join(LINES))
    (tmp_path / "in" / "b.csv").write_text("\n".join([LINES[0], "20,Zoe,5,2024_25", "x,Yan,5,2024_25"]) + "\n")
    got = cc.import_csv(spark, str(tmp_path / "in"), FIELDS, str(tmp_path / "out"), ["player_id"], "2024_25")
    want = {("a", 4): "mistyped", ("a", 5): "ragged", ("a", 6): "ragged", ("a", 7): "open_quote", ("a", 9): "missing", ("a", 10): "other_season", ("a", 13): "mistyped", ("a", 14): "ragged", ("b", 3): "mistyped"}
    assert {(r.file[-5], r.number): r.problem for r in got.bad.collect()} == want and got.bad.count() == len(want)
    assert {r.number: r.line for r in got.bad.where("file LIKE '%a.csv'").collect()} == {n: LINES[n - 1] for f, n in want if f == "a"}
    assert sorted((r.player_id, r.name, r.minutes, r.note) for r in got.good.collect()) == [(1, "Ann", 90, None), (2, "Smith, Bob", 45, None), (9, "Hal", 12, None), (9, "Hal again", 13, None), (20, "Zoe", 5, None)]
    r = got.report
    assert r["lines"] == r["good"] + r["bad"] == 14 and (r["ragged"], r["mistyped"], r["duplicate_rows"], r["passed"]) == (3, 3, 1, False)
    assert r["resolved"] == {"player_id": "Element", "name": "Web_Name", "minutes": "MINS", "note": None} and not r["warnings"]


def test_clean_and_unfit_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,minutes\n1,x,2\n2,y,3\n")
    got = cc.import_csv(spark, str(tmp_path / "a.csv"), FIELDS, str(tmp_path / "a"), ["player_id"], "2024_25")
    assert got.report["passed"] and got.report["good"] == 2 and got.report["warnings"] and got.bad.isEmpty()
    (tmp_path / "b.csv").write_text("id,minutes\n1,2\n")
    got = cc.import_csv(spark, str(tmp_path / "b.csv"), FIELDS, str(tmp_path / "b"))
    assert got.report["absent"] == ["name"] and got.good.isEmpty() and not got.report["passed"]
    (tmp_path / "c.csv").write_text("id,name,minutes\n")
    assert cc.import_csv(spark, str(tmp_path / "c.csv"), FIELDS, str(tmp_path / "c"), ["player_id"]).report["lines"] == 0


def test_numbers_of_lines_across_splits(spark, tmp_path):
    path = str(tmp_path / "long.txt")
    with open(path, "w") as f:
        f.writelines(f"line {i}\n" for i in range(1, 20_001))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = cc.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert rows.where(F.col("line") != F.concat(F.lit("line "), F.col("number"))).isEmpty() and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_only_the_newest_files_are_opened(spark, tmp_path, monkeypatch):
    for i in range(40):
        file = tmp_path / f"run_{i:02}.json"
        file.write_text("{broken" if i == 38 else json.dumps({"id": i, "kind": "even" if i % 2 == 0 else "odd"}))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    (tmp_path / "other.txt").write_text("x")
    opened, parse = [], readers._parsed

    def counting(spark, files, schema, condition):
        opened.append(len(files))
        return parse(spark, files, schema, condition)

    monkeypatch.setattr(readers, "_parsed", counting)
    read = lambda *a, **k: [r.id for r in readers.newest_artifacts(spark, str(tmp_path), "id long, kind string", *a, name=r"run_.*\.json", **k).collect()]
    assert read(3) == [39, 37, 36] and opened == [3, 6, 1]
    opened.clear()
    assert read(1) == [39] and opened == [1, 1]
    assert read(4, F.col("kind") == "even") == [36, 34, 32, 30]
    assert read(5, since=1_700_000_036_000) == [39, 37, 36] and read(2, F.col("id") < 0) == []
    assert [f[-11:] for f in readers.newest_files(spark, str(tmp_path), r"run_0[01]\.json")] == ["run_01.json", "run_00.json"]


def test_snapshots_by_version(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert [li.publish_snapshot(spark.range(n), folder, {"run_id": f"r{n}"}) for n in (3, 5)] == [1, 2]
    got = li.published(spark, folder).orderBy("version").collect()
    assert [(r.version, r.is_current, r.rows, r.columns, r.record["run_id"]) for r in got] == [(1, False, 3, 1, "r3"), (2, True, 5, 1, "r5")]
    assert [spark.read.parquet(r.path).count() for r in got] == [3, 5] and li.published(spark, str(tmp_path / "none")).isEmpty()


def test_pointers_leave_nothing_behind(spark, tmp_path):
    for i in range(3):
        writers.put_pointer(spark, str(tmp_path / "p.json"), {"n": i})
    assert json.loads((tmp_path / "p.json").read_text()) == {"n": 2} and [f for f in os.listdir(tmp_path) if f.endswith(".new")] == []


@pytest.mark.parametrize("header", [["ID", " Name "], ["web_name", "element"]])
def test_resolved(header):
    assert cc.resolved(header, FIELDS) == {"player_id": "ID" if "ID" in header else "element", "name": header[1] if "ID" in header else "web_name", "minutes": None, "note": None}
