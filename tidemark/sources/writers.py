"""Writing results: partition replacement, write-once artifacts, pointers and schema-checked appends."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A path segment: letters, digits, dot, dash and underscore, not starting with a dot.
SEGMENT = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9._-]*")


def partition_counts(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many new rows are inserted (no old row has their keys) and how many updated."""
    marked = new.select(*keys).join(old.select(*keys).distinct().withColumn("_old", F.lit(True)), list(keys), "left")
    return marked.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_old").isNotNull()).alias("updated"))


def replace_partitions(new: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrite the partitions that `new` holds and leave the others alone."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_known(rows: DataFrame, path: str, schema: StructType) -> None:
    """Append the columns that the table has. A column that may not be null and is absent is an error."""
    absent = [f.name for f in schema if not f.nullable and f.name not in rows.columns]
    if absent:
        raise ValueError(f"the table needs {absent}")
    rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)


def without_partition(old: DataFrame, column: str, value) -> DataFrame:
    """The rows of all other partitions, for an overwrite that drops one."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value)))


def artifact_key(season: str, gw: int, as_of: str, version: str, run_id: str) -> str:
    """The Hive-style key of an immutable artifact; every value must be a safe segment."""
    parts = {"season": season, "gw": str(gw), "as_of": as_of, "version": version, "run_id": run_id}
    for name, value in parts.items():
        if not SEGMENT.fullmatch(value):
            raise ValueError(f"{name} is no safe path segment: {value!r}")
    return "/".join(f"{k}={v}" for k, v in parts.items())


def write_once(df: DataFrame, path: str) -> None:
    """Write a folder that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def put_pointer(spark: SparkSession, path: str, value: Mapping) -> None:
    """Replace a small JSON file in one step: write beside it under a name of its own, then rename over it. The last of several writers stays; see `versions` where none may be lost."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own, target = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    out = fs.create(own, True)
    out.write(bytearray(json.dumps(dict(value), sort_keys=True).encode()))
    out.close()
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(own, target, _overwrite(spark))


def _overwrite(spark: SparkSession):
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename") and rename, 1)
    array[0] = rename.OVERWRITE
    return array


def report_lines(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small report as a Markdown table. It is for summaries: more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
