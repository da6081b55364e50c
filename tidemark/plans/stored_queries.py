"""Queries that go through a store: merges, replaced keys, snapshots by version and checked imports, read back from what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lineage as li
from tidemark.plans.frames import USER_DAYS, user_days
from tidemark.plans.registry import query
from tidemark.session import work_dir
from tidemark.sources import checked_csv as cc
from tidemark.sources import store
from tidemark.sources.readers import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "k06_stored_merge",
    """WITH base AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderdate < DATE '1999-01-01'),
    changes AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
    SELECT * FROM changes UNION ALL SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changes)""",
)
def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before 1999 as stored, merged with those since 1998 whose customer is known (has money), and merged again, which changes nothing."""
    orders, path = table(spark, sf_dir, "orders"), _folder(spark, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    base = orders.where("o_orderdate < DATE'1999-01-01'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "X").otherwise(F.col("o_orderstatus")))
    store.create(base.select(*names), path, ["o_orderkey"], rows_per_file=100_000)
    changes, known = orders.where("o_orderdate >= DATE'1998-01-01'").select(*names), table(spark, sf_dir, "customer").where("c_acctbal > 0")
    for _ in range(2):
        store.merge_known(changes, path, known, "c_custkey", ["o_custkey"], rows_per_file=100_000)
    return store.read(spark, path)


@query(
    "k06_merge_counts",
    """WITH base AS (SELECT o_orderkey, o_orderstatus, o_orderpriority LIKE '1%' AND o_orderstatus <> 'X' AS other FROM orders WHERE o_orderdate < DATE '1999-01-01'),
    given AS (SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM orders WHERE o_orderdate >= DATE '1998-01-01'),
    j AS (SELECT g.o_orderkey, known, b.o_orderkey IS NULL AS fresh, coalesce(other, false) AS other FROM given g LEFT JOIN base b USING (o_orderkey))
    SELECT count(*) FILTER (known AND fresh) AS inserted, count(*) FILTER (known AND NOT fresh AND other) AS updated, count(*) FILTER (known AND NOT fresh AND NOT other) AS unchanged, count(*) FILTER (NOT known) AS unknown FROM j""",
)
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, path = table(spark, sf_dir, "orders"), _folder(spark, "orders")
    base = orders.where("o_orderdate < DATE'1999-01-01'").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority").startswith("1"), "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    store.create(base, path, ["o_orderkey"], rows_per_file=100_000)
    changes = orders.where("o_orderdate >= DATE'1998-01-01'").select("o_orderkey", "o_custkey", "o_orderstatus")
    found = store.merge_known(changes, path, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey", ["o_custkey"], rows_per_file=100_000)
    return spark.range(1).select(*(F.lit(found[c]).cast("long").alias(c) for c in ("inserted", "updated", "unchanged", "unknown")))


@query(
    "k10_stored_replacement",
    """WITH changes AS (SELECT o_custkey, o_orderkey, 0.0::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%')
    SELECT * FROM changes UNION ALL SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM changes)""",
)
def stored_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers with urgent finished orders only these are left, at no price."""
    orders, path = table(spark, sf_dir, "orders"), _folder(spark, "orders")
    store.create(orders.select("o_custkey", "o_orderkey", "o_totalprice"), path, ["o_custkey", "o_orderkey"], rows_per_file=100_000)
    changes = orders.where("o_orderstatus = 'F' AND o_orderpriority LIKE '1%'").select("o_custkey", "o_orderkey", F.lit(0.0).alias("o_totalprice"))
    store.merge(changes, path, replace_by=["o_custkey"], rows_per_file=100_000)
    return store.read(spark, path)


@query(
    "v25_published_snapshots",
    f"WITH {USER_DAYS} SELECT 1::BIGINT AS version, false AS is_current, count(*) AS rows, 8::BIGINT AS columns, 'early' AS run FROM user_days WHERE day <= 10 UNION ALL SELECT 2, true, count(*), 8, 'all' FROM user_days",
)
def published_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of users' days under one folder; the second is current."""
    folder, days = _folder(spark, "snapshots"), user_days(spark, sf_dir)
    li.publish_snapshot(days.where("day <= 10"), folder, {"run": "early"})
    li.publish_snapshot(days, folder, {"run": "all"})
    return li.published(spark, folder).select("version", "is_current", "rows", "columns", F.col("record")["run"].alias("run"))


@query(
    "v04_checked_import",
    """SELECT c_custkey, CASE WHEN c_custkey % 17 = 8 THEN 'open_quote' WHEN c_custkey % 7 = 3 THEN 'ragged' WHEN c_custkey % 11 = 5 THEN 'mistyped' WHEN c_custkey % 13 = 6 THEN 'missing' WHEN c_nationkey % 5 = 1 THEN 'other_season' ELSE 'good' END AS problem FROM customer""",
)
def checked_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as lines of text, some cut off, with a word for a number, without a name, with an open quote or of another season; imported, and both parts read back."""
    key, path = F.col("c_custkey"), _folder(spark, "lines")
    number = F.when(key % 11 == 5, "none").otherwise(F.col("c_nationkey").cast("string"))
    name = F.when(key % 17 == 8, F.concat(F.lit('"'), "c_name")).when(key % 13 == 6, "").otherwise(F.col("c_name"))
    season = F.when(F.col("c_nationkey") % 5 == 1, "2023_24").otherwise("2024_25")
    line = F.when(key % 7 == 3, F.concat_ws(",", key, season, name)).otherwise(F.concat_ws(",", key, season, name, number))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    head = spark.createDataFrame([("id,season,name,nation",)], "value string")
    head.unionByName(spark.read.text(path)).coalesce(1).write.text(f"{path}-file")  # one file with a header, as an export has
    fields = {"c_custkey": cc.Field("long", ("id",)), "name": cc.Field(), "nation": cc.Field("int")}
    done = cc.import_csv(spark, f"{path}-file", fields, f"{path}-done", ["c_custkey"], "2024_25")
    bad = done.bad.select(F.substring_index("line", ",", 1).cast("long").alias("c_custkey"), "problem")
    return done.good.select("c_custkey", F.lit("good").alias("problem")).unionByName(bad)
