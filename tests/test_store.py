"""Versions with several writers, and merges that leave files alone."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest

from tidemark.sources import store, versions


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert versions.current(spark, folder) is None
    assert [versions.publish(spark, folder, {"n": i}) for i in range(3)] == [1, 2, 3]
    assert versions.current(spark, folder) == (3, {"n": 2}) and versions.read(spark, folder, 1) == {"n": 0}
    with pytest.raises(versions.VersionConflict):
        versions.publish(spark, folder, {"n": 9}, after=2)
    assert versions.publish(spark, folder, {"n": 9}, after=3) == 4
    with pytest.raises(ValueError):
        versions.read(spark, folder, 7)
    (tmp_path / "v" / "_half").write_text('{"n": ')  # what a lost writer leaves behind
    assert versions.current(spark, folder) == (4, {"n": 9})


def test_two_writers_leave_one_winner(spark, tmp_path):
    folder = str(tmp_path / "v")

    def write(i):
        try:
            return versions.publish(spark, folder, {"by": i}, after=0)
        except versions.VersionConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(write, range(8)))
    winners = [i for i, n in enumerate(done) if n == 1]
    assert len(winners) == 1 and versions.current(spark, folder) == (1, {"by": winners[0]})
    with ThreadPoolExecutor(8) as pool:
        found = sorted(pool.map(lambda i: versions.publish(spark, folder, {"by": i}), range(8)))
    assert found == list(range(2, 10)) and sorted(versions.read(spark, folder, n)["by"] for n in found) == list(range(8))


SCHEMA = "a long, b date, x string, y double"


def row(a, b, x, y):
    return (a, date(2024, 1, b), x, y)


def start(spark, path):
    rows = [row(a, b, f"{a}-{b}", float(a)) for a in range(20) for b in range(1, 6)]
    assert store.create(spark.createDataFrame(rows, SCHEMA), path, ["a", "b"], rows_per_file=10) == 1
    return {r[:2]: r for r in rows}


def content(spark, path, version=None):
    found = [tuple(r) for r in store.read(spark, path, version).collect()]
    assert len(found) == len({r[:2] for r in found})
    return {r[:2]: r for r in found}


def files(spark, path):
    return {f["file"] for f in versions.current(spark, f"{path}/versions")[1]["files"]}


def test_merge_rewrites_only_what_it_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    want, before = start(spark, path), files(spark, path)
    changes = [row(3, 2, "changed", None), row(3, 9, "new", 1.0), row(12, 1, "12-1", 12.0), row(99, 1, "last", 0.0)]
    df = spark.createDataFrame(changes, SCHEMA)
    got = store.merge(df, path, rows_per_file=10)
    assert {k: got[k] for k in ("version", "inserted", "updated", "unchanged", "deleted")} == {"version": 2, "inserted": 2, "updated": 1, "unchanged": 1, "deleted": 0}
    want |= {r[:2]: r for r in changes}
    assert content(spark, path) == want and len(content(spark, path, 1)) == 100
    assert len(files(spark, path) & before) == got["kept"] == len(before) - got["rewritten"] and got["rewritten"] <= 3
    manifest = versions.current(spark, f"{path}/versions")[1]["files"]
    assert all(f["high"] < g["low"] for f, g in zip(manifest, manifest[1:])) and sum(f["rows"] for f in manifest) == 102
    again, same = store.merge(df, path, rows_per_file=10), files(spark, path)
    assert again == {"version": 2, "inserted": 0, "updated": 0, "unchanged": 4, "deleted": 0, "rewritten": 0, "kept": len(same)} and files(spark, path) == same


def test_replaced_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    want = start(spark, path)
    changes = [row(4, 1, "kept", 4.0), row(4, 30, "new", 0.5), row(50, 1, "new", 0.0)]
    got = store.merge(spark.createDataFrame(changes, SCHEMA), path, replace_by=["a"], rows_per_file=3)
    assert (got["inserted"], got["updated"], got["deleted"]) == (2, 1, 4)
    want = {k: r for k, r in want.items() if k[0] != 4} | {r[:2]: r for r in changes}
    assert content(spark, path) == want
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame(changes, SCHEMA), path, replace_by=["b"])


def test_unknown_references(spark, tmp_path):
    path = str(tmp_path / "t")
    start(spark, path)
    changes = spark.createDataFrame([row(1, 1, "home", 2.0), row(1, 2, "nowhere", 2.0), row(1, 3, None, 2.0)], SCHEMA)
    got = store.merge_known(changes, path, spark.createDataFrame([("home",), ("home",)], "name string"), "name", ["x"])
    assert (got["updated"], got["unknown"], got["version"]) == (1, 2, 2)


def test_a_merge_that_comes_too_late_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    start(spark, path)
    own = store._write

    def slow(df, p, keys, n):
        versions.publish(spark, f"{path}/versions", versions.read(spark, f"{path}/versions", 1))
        return own(df, p, keys, n)

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(versions.VersionConflict):
        store.merge(spark.createDataFrame([row(1, 1, "late", 0.0)], SCHEMA), path)
    assert content(spark, path)[1, date(2024, 1, 1)][2] == "1-1"


def test_many_merges_equal_a_dictionary(spark, tmp_path):
    draw, path = random.Random(5), str(tmp_path / "t")
    want = start(spark, path)
    for _ in range(3):
        rows = {(r := row(draw.randrange(-3, 25), draw.randrange(1, 8), draw.choice(["x", None]), draw.choice([1.0, None])))[:2]: r for _ in range(15)}
        store.merge(spark.createDataFrame(list(rows.values()), SCHEMA), path, rows_per_file=9)
        want |= rows
        assert content(spark, path) == want


def test_keys_must_be_keys(spark, tmp_path):
    twice = spark.createDataFrame([row(1, 1, "x", 0.0)] * 2, SCHEMA)
    with pytest.raises(ValueError):
        store.create(twice, str(tmp_path / "t"), ["a", "b"])
    with pytest.raises(ValueError):
        store.create(spark.createDataFrame([(None, date(2024, 1, 1), "x", 0.0)], SCHEMA), str(tmp_path / "t"), ["a", "b"])
    store.create(twice.where("false"), str(tmp_path / "e"), ["a", "b"])
    with pytest.raises(ValueError):
        store.merge(twice, str(tmp_path / "e"))
    assert store.merge(twice.distinct(), str(tmp_path / "e"))["inserted"] == 1 and store.read(spark, str(tmp_path / "e")).count() == 1
