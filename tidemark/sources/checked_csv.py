"""CSV files with bad lines: every line is kept, the good ones typed, the bad ones as they are with what is wrong with them.

Files are read line by line, each line with its file and number, so a line that does not fit is found again. A record
stands on one line. Counts are observed while the rows are written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

PROBLEMS = ("open_quote", "ragged", "mistyped", "missing", "other_season")
PLACE_BITS = 33


class Field(NamedTuple):
    """A column by its canonical name: type, what else a file may call it, and whether it must be there and filled."""

    kind: str = "string"
    aliases: Sequence[str] = ()
    required: bool = True


class Imported(NamedTuple):
    """good and bad rows as stored, and the report."""

    good: DataFrame
    bad: DataFrame
    report: dict


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file and number (from 1) of every line.

    A line's number is its place in its part of the file, after the lines of the parts before, of which there is one row each.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    parts = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "_start", "_first", before.alias("_before"))
    return lines.join(parts, ["file", "_start"]).select("line", "file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("number"))


def resolved(header: Sequence[str], fields: Mapping[str, Field]) -> dict[str, str | None]:
    """The file's column for each canonical name, in any case; null where there is none."""
    present = {c.strip().lower(): c for c in header}
    return {name: next((present[a.lower()] for a in (name, *f.aliases) if a.lower() in present), None) for name, f in fields.items()}


def checked_lines(spark: SparkSession, path: str, fields: Mapping[str, Field], season: str | None = None) -> tuple[DataFrame, list[str], dict[str, str | None]]:
    """Every line but headers and empty ones with the typed fields, file, number, line and problem (null: none), the file's columns, and which of them are used.

    `open_quote`: a quote is not closed on the line. `ragged`: too few or too many values, as of a line that was cut off. `mistyped`: a value is none of its type.
    `missing`: a required value is empty. `other_season`: the file's season column says another one. A line has the first of these. All
    files of the path have the same columns.
    """
    header = [c for c in spark.read.option("header", True).csv(path).columns]
    used = resolved(header, fields)
    as_text = ", ".join(f"`c{i}` string" for i in range(len(header)))
    lines = numbered_lines(spark, path).where(F.length(F.trim("line")) > 0)
    lines = lines.where((F.col("number") > 1) | (F.from_csv("line", as_text, {"mode": "PERMISSIVE"})["c0"] != header[0]))
    parsed = lines.withColumn("_t", F.from_csv("line", f"{as_text}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    text = lambda c: F.nullif(F.trim(F.col("_t")[f"c{header.index(c)}"]), F.lit(""))
    typed = {n: (F.lit(None).cast(f.kind) if used[n] is None else text(used[n]).try_cast(f.kind)) for n, f in fields.items()}
    given = [(n, f) for n, f in fields.items() if used[n] is not None]
    some = lambda conditions: F.exists(F.array(*conditions), lambda x: x) if conditions else F.lit(False)
    mistyped = some([text(used[n]).isNotNull() & typed[n].isNull() for n, _ in given])
    missing = some([text(used[n]).isNull() for n, f in given if f.required])
    season_column = next((c for c in header if c.strip().lower() == "season"), None)
    other = F.coalesce(text(season_column) != season, F.lit(True)) if season and season_column else F.lit(False)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    problem = F.when(quotes % 2 == 1, "open_quote").when(F.col("_t")["_broken"].isNotNull(), "ragged").when(mistyped, "mistyped").when(missing, "missing").when(other, "other_season")
    whole = lambda c: F.when(F.col("problem").isNull(), c)
    rows = parsed.withColumn("problem", problem).select(*(whole(c).alias(n) for n, c in typed.items()), "file", "number", "line", "problem")
    return rows, header, used


def import_csv(spark: SparkSession, path: str, fields: Mapping[str, Field], into: str, keys: Sequence[str] = (), season: str | None = None) -> Imported:
    """Read, check and store a file or folder in one pass: good rows under `into`/bad=false, bad lines under `into`/bad=true.

    The report has lines, good, bad, each problem's count, columns, resolved, absent (required columns that the file lacks; then nothing is
    stored as good), duplicate_rows (good rows that repeat the keys of another), errors, warnings and passed. Bad lines do not stop an import; they keep it from passing.
    """
    rows, header, used = checked_lines(spark, path, fields, season)
    absent = [n for n, f in fields.items() if f.required and used[n] is None]
    if absent:
        rows = rows.withColumn("problem", F.coalesce("problem", F.lit("missing")))
    counted = Observation("import")
    counts: list[Column] = [F.count(F.lit(1)).alias("lines"), *(F.count_if(F.col("problem") == p).alias(p) for p in PROBLEMS)]
    rows.withColumn("bad", F.col("problem").isNotNull()).observe(counted, *counts).write.mode("errorifexists").partitionBy("bad").parquet(into)
    found = counted.get
    stored = spark.read.schema(rows.schema.add("bad", "boolean")).parquet(into)
    good = stored.where("NOT bad").drop("bad", "problem", "line")
    bad = stored.where("bad").select("file", "number", "line", "problem")
    repeated = good.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0] if keys else 0
    n_bad = sum(found[p] for p in PROBLEMS)
    errors = [f"no column for {n}" for n in absent] + [f"{found[p]} lines: {p}" for p in PROBLEMS if found[p]] + ([f"{repeated} rows repeat a key"] if repeated else [])
    warnings = [] if season is None or any(c.strip().lower() == "season" for c in header) else ["no season column: the season has to be attached"]
    report = {"lines": found["lines"], "good": found["lines"] - n_bad, "bad": n_bad, **{p: found[p] for p in PROBLEMS}, "columns": header, "resolved": used, "absent": absent, "duplicate_rows": repeated, "errors": errors, "warnings": warnings, "passed": not errors}
    return Imported(good, bad, report)
