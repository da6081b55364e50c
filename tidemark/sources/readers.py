"""Reading tables, CSV and JSON into DataFrames with explicit schemas."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a directory; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_frame(spark: SparkSession, text: str, args: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """The result of SQL over the given frames, with bound parameters (`:name`); frames are written as `{name}`."""
    return spark.sql(text, args=dict(args or {}), **frames)


def require_columns(df: DataFrame, required: Iterable[str], label: str = "table") -> DataFrame:
    """`df`, if it has the columns; else a ValueError that names the missing ones."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks the columns {missing}")
    return df


def read_csv(spark: SparkSession, path: str | list[str], schema: str | StructType | None = None, required: Iterable[str] = ()) -> DataFrame:
    """A CSV file with a header. Without a schema every column is a string: types are cast, not guessed."""
    reader = spark.read.option("header", True)
    return require_columns(reader.schema(schema).csv(path) if schema else reader.csv(path), required, str(path))


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]], optional: Iterable[str] = ()) -> DataFrame:
    """Columns renamed to their canonical names by the first alias that is there, in any case.

    Optional columns that are absent become null strings; a required one that is absent is an error.
    """
    present, optional = {c.lower(): c for c in df.columns}, set(optional)
    out, missing = [], []
    for name, choices in aliases.items():
        found = next((present[a.lower()] for a in [name, *choices] if a.lower() in present), None)
        if found is None and name not in optional:
            missing.append(name)
        out.append(F.lit(None).cast("string").alias(name) if found is None else F.col(found).alias(name))
    if missing:
        raise ValueError(f"no column stands for {missing}")
    return df.select(*out)


def null_filled(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """`df` with a null column of the given type for each name that it lacks, so that what follows need not ask."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns})


def table_columns(spark: SparkSession, name: str) -> list[str]:
    """The columns of a table or view of the catalog, in order; none if it is not there."""
    return [c.name for c in spark.catalog.listColumns(name)] if spark.catalog.tableExists(name) else []


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of the paths that exists in the store it points to."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).exists(where):
            return path
    return None


def read_json_artifacts(spark: SparkSession, path: str, schema: str, condition: Column | None = None, limit: int | None = None) -> DataFrame:
    """JSON documents of a folder, newest file first and name last, broken ones left out."""
    fields = StructType.fromDDL(schema).add("_broken", "string")
    rows = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_changed", F.col("_metadata.file_modification_time"))
    rows = rows.where("_broken IS NULL").drop("_broken")
    rows = (rows if condition is None else rows.where(condition)).orderBy(F.desc("_changed"), "_file")
    return rows if limit is None else rows.limit(limit)


def newest_files(spark: SparkSession, path: str, name: str = ".*", since: int = 0) -> list[str]:
    """The files of a folder whose name matches and that are no older than `since` (milliseconds), newest first, of one time by name. Nothing is opened."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    found = [(-s.getModificationTime(), s.getPath().getName(), s.getPath().toString()) for s in listed if s.isFile() and re.fullmatch(name, s.getPath().getName())]
    return [p for changed, _, p in sorted(found) if -changed >= since]


def _parsed(spark: SparkSession, files: Sequence[str], schema: str, condition: Column | None) -> DataFrame:
    fields = StructType.fromDDL(schema).add("_broken", "string")
    rows = spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(list(files))
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_changed": F.col("_metadata.file_modification_time")}).where("_broken IS NULL").drop("_broken")
    return rows if condition is None else rows.where(condition)


def newest_artifacts(spark: SparkSession, path: str, schema: str, limit: int, condition: Column | None = None, name: str = ".*", since: int = 0) -> DataFrame:
    """Up to `limit` JSON documents of a folder that meet a condition, newest file first; broken ones are left out.

    Files are cut by name and time before any is opened. As many as are asked for are read first, then twice as many each time, and only
    while matches are lacking.
    """
    files, kept, at, step = newest_files(spark, path, name, since), [], 0, limit
    while at < len(files) and len(kept) < limit:
        rows = _parsed(spark, files[at : at + step], schema, condition)
        kept += rows.orderBy(F.desc("_changed"), "_file").limit(limit - len(kept)).collect()  # at most `limit` rows in all
        at, step = at + step, 2 * step
    shape = _parsed(spark, files[:1], schema, condition).schema if files else StructType.fromDDL(schema).add("_file", "string").add("_changed", "timestamp")
    return spark.createDataFrame(kept, shape)


def list_objects(spark: SparkSession, path: str, with_digest: bool = False) -> DataFrame:
    """path, length and modificationTime of the files under a folder, and the sha256 of their content on demand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = ["path", "length", "modificationTime"]
    return files.select(*found, F.sha2("content", 256).alias("sha256")) if with_digest else files.select(*found)


def flatten_bootstrap(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Teams, players (with the name of their kind) and deadlines out of one nested document per row.

    `document` has the array-of-struct columns teams, element_types, elements and events.
    """
    teams = document.select(F.inline("teams"))
    kinds = document.select(F.inline("element_types")).select(F.col("id").alias("_kind"), F.col("singular_name_short").alias("position"))
    players = document.select(F.inline("elements")).join(F.broadcast(kinds), F.col("element_type") == F.col("_kind"), "left").drop("_kind", "element_type")
    return teams, players, document.select(F.inline("events"))


def flatten_fixtures(document: DataFrame, teams: DataFrame, first: int, last: int) -> DataFrame:
    """Fixtures of a range of periods, with the names of both sides. `document` has an array-of-struct column fixtures."""
    side = lambda s: F.broadcast(teams.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name")))
    rows = document.select(F.inline("fixtures")).where(F.col("event").between(first, last))
    rows = rows.withColumnsRenamed({"team_h": "home_id", "team_a": "away_id"})
    return rows.join(side("home"), "home_id", "left").join(side("away"), "away_id", "left")


def flatten_live(document: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per element of a live document, missing measures as 0. `document` has period and elements (id, stats map)."""
    rows = document.select("period", F.explode("elements").alias("e"))
    return rows.select("period", F.col("e.id").alias("id"), *(F.coalesce(F.col("e.stats")[m], F.lit(0)).alias(m) for m in measures))
