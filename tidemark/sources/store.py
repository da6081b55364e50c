"""A table in files of key ranges, merged in place by versions.

A version's manifest lists the files with the first and last key and the rows of each; the ranges do not overlap. A merge finds the files
that its keys fall into, compares there, and writes anew only files in which something changes. Everything else, and everything where
nothing changes, is carried over by name. A version is published with compare-and-set, so of two merges at once one wins and the other is told.
"""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.sources import versions

ROWS_PER_FILE = 1_000_000


def _plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else value


#: The name of a file in the manifest, out of its path.
ENTRY = r"(data/[0-9a-f]{32}/.*)$"


def _entry() -> Column:
    return F.regexp_extract("_metadata.file_path", ENTRY, 1)


def _write(df: DataFrame, path: str, keys: Sequence[str], n: int) -> list[dict]:
    """Sorted files of key ranges, and their entries for the manifest: each new file is read once for its keys. No file has rows of two values of `span`."""
    folder = f"data/{uuid.uuid4().hex}"
    df.repartitionByRange(n, "span", *keys).sortWithinPartitions("span", *keys).write.partitionBy("span").parquet(f"{path}/{folder}")
    stats = df.sparkSession.read.schema(df.drop("span").schema).parquet(f"{path}/{folder}").groupBy(_entry().alias("file")).agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"), F.count("*").alias("rows"))
    return [{"file": r.file, "low": [_plain(v) for v in r.low], "high": [_plain(v) for v in r.high], "rows": r.rows} for r in stats.collect()]  # a row for each new file


def _manifest(keys: Sequence[str], schema: str, files: list[dict]) -> dict:
    return {"keys": list(keys), "schema": schema, "files": sorted(files, key=lambda f: f["low"])}


def create(df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Store a table as version 1. Keys must be unique and not null; a ValueError says so."""
    found = df.agg(F.count("*").alias("n"), F.count_if(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))).alias("nulls")).first()
    if found.nulls:
        raise ValueError("a key is null")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a key is there twice")
    files = _write(df.withColumn("span", F.lit(0)), path, keys, max(1, -(-found.n // rows_per_file)))
    return versions.publish(df.sparkSession, f"{path}/versions", _manifest(keys, df.schema.json(), files), after=0)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at a version, the current one by default."""
    from pyspark.sql.types import StructType
    import json

    manifest = versions.read(spark, f"{path}/versions", version) if version else versions.current(spark, f"{path}/versions")[1]
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    files = [f"{path}/{f['file']}" for f in manifest["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _place(files: list[dict], keys: Sequence[str], first: bool) -> Column:
    """The file that a row's keys fall into, or would be put into; by leading keys alone, the first or the last such file."""
    edges = [f["low"] if not first else f["high"] for f in files]
    last = len(files) - 1

    @pandas_udf("int")
    def place(key: pd.DataFrame) -> pd.Series:
        found = []
        for row in key.itertuples(index=False):
            k = [_plain(v.item() if hasattr(v, "item") else v) for v in row]
            cut = [e[: len(k)] for e in edges]
            found.append(min(last, bisect.bisect_left(cut, k)) if first else max(0, bisect.bisect_right(cut, k) - 1))
        return pd.Series(found, dtype="int32")

    return place(F.struct(*keys))


def merge(changes: DataFrame, path: str, replace_by: Sequence[str] = (), rows_per_file: int = ROWS_PER_FILE) -> dict:
    """Merge rows by key and give {version, inserted, updated, unchanged, deleted, rewritten, kept}: the last two are numbers of files.

    `changes` has the table's columns, each key once. With `replace_by`, leading keys, the changes are all that is to be left of those keys: stored rows of theirs
    that are not among the changes are deleted. Where nothing changes no file is written and the version stays. Counts come from
    one comparison of the changes with the files that they meet.
    """
    spark = changes.sparkSession
    version, manifest = versions.current(spark, f"{path}/versions")
    keys, files = manifest["keys"], manifest["files"]
    if list(replace_by) != keys[: len(replace_by)]:
        raise ValueError(f"rows are replaced by leading keys of {keys}")
    table = read(spark, path, version)
    values = [c for c in table.columns if c not in keys]
    new = changes.select(*(F.col(f.name).cast(f.dataType) for f in table.schema))
    if not new.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a key is there twice")
    if not files:
        number = new.count()
        if number:
            version = versions.publish(spark, f"{path}/versions", _manifest(keys, manifest["schema"], _write(new.withColumn("span", F.lit(0)), path, keys, max(1, -(-number // rows_per_file)))), after=version)
        return {"version": version, "inserted": number, "updated": 0, "unchanged": 0, "deleted": 0, "rewritten": 0, "kept": 0}

    placed = new.withColumn("_file", _place(files, keys, first=False))
    met = {r[0] for r in placed.select("_file").distinct().collect()}  # numbers of files
    if replace_by:
        spans = new.select(*replace_by).distinct().select(_place(files, replace_by, first=True).alias("a"), _place(files, replace_by, first=False).alias("b")).distinct().collect()
        met |= {i for r in spans for i in range(r.a, r.b + 1)}
    met = sorted(met)
    name = {files[i]["file"]: i for i in met}
    old = spark.read.schema(table.schema).parquet(*(f"{path}/{files[i]['file']}" for i in met)) if met else table.where("false")
    number = F.element_at(F.create_map(*(F.lit(v) for pair in name.items() for v in pair)), _entry()).cast("int") if met else F.lit(None).cast("int")
    old = old.select("*", number.alias("_file"))

    a = old.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*values).alias("_old"), F.col("_file").alias("_of"))
    b = placed.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*values).alias("_new"), "_file", F.lit(True).alias("_given"))
    both = a.join(b, [f"_k{i}" for i in range(len(keys))], "full")
    if replace_by:
        lead = [f"_k{i}" for i in range(len(replace_by))]
        given = b.select(*lead).distinct().withColumn("_theirs", F.lit(True))
        both = both.join(given, lead, "left")
    else:
        both = both.withColumn("_theirs", F.lit(None).cast("boolean"))
    is_new = F.col("_given").isNotNull()
    status = F.when(is_new & F.col("_of").isNull(), "inserted").when(is_new & F.col("_old").eqNullSafe(F.col("_new")), "unchanged").when(is_new, "updated").when(F.col("_theirs"), "deleted").otherwise("other")
    both = both.withColumn("_status", status).withColumn("_file", F.coalesce("_of", "_file"))
    counts = {(r["_file"], r["_status"]): r["count"] for r in both.groupBy("_file", "_status").count().collect()}  # a few rows a file
    total = {s: sum(n for (_, t), n in counts.items() if t == s) for s in ("inserted", "updated", "unchanged", "deleted")}
    touched = sorted({f for (f, s) in counts if s in ("inserted", "updated", "deleted")})
    if touched:
        rows = both.where(F.col("_file").isin(touched) & (F.col("_status") != "deleted"))
        kept = rows.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), F.when(is_new, F.col("_new")).otherwise(F.col("_old")).alias("_v"), F.col("_file").alias("span")).select(*keys, "_v.*", "span").select(*table.columns, "span")
        left = sum(n for (f, s), n in counts.items() if f in touched and s != "deleted")
        fresh = _write(kept, path, keys, max(1, -(-left // rows_per_file))) if left else []
        rest = [f for i, f in enumerate(files) if i not in touched]
        version = versions.publish(spark, f"{path}/versions", _manifest(keys, manifest["schema"], rest + fresh), after=version)
    return {"version": version, **total, "rewritten": len(touched), "kept": len(files) - len(touched)}


def merge_known(changes: DataFrame, path: str, known: DataFrame, known_key: str, references: Sequence[str], **how) -> dict:
    """Like `merge`, for the rows all of whose references are known; `unknown` counts the rows that are left out."""
    rows = changes
    for i, c in enumerate(references):
        names = known.select(F.col(known_key).alias(f"_r{i}")).distinct()
        rows = rows.join(names, rows[c] == names[f"_r{i}"], "left")
    good = reduce(lambda a, b: a & b, (F.col(f"_r{i}").isNotNull() for i in range(len(references))))
    unknown = rows.where(~good).count()
    return merge(rows.where(good).select(*changes.columns), path, **how) | {"unknown": unknown}
