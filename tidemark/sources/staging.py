"""Season files into staging tables and on into the canonical ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import raw_id
from tidemark.sources.readers import require_columns


def text_or_null(c: str) -> Column:
    """Trimmed text; blanks and the usual words for nothing are null."""
    value = F.trim(F.col(c).cast("string"))
    return F.when(~F.lower(value).isin("", "nan", "none", "null"), value)


def number_or_null(c: str, kind: str) -> Column:
    """A number of a type out of text; what is none, or does not fit, is null. Whole numbers keep all their digits."""
    text = text_or_null(c)
    return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))


def staging_rows(df: DataFrame, season: str, key: Sequence[str], texts: Sequence[str] = (), numbers: Mapping[str, str] | None = None, canonical: str | None = None) -> DataFrame:
    """Typed rows of a season: raw ids as text, texts trimmed, numbers cast (null where they are none). Rows without an id go.

    With `canonical`, the column of the mapped id, mapping_status is mapped or unmapped unless the file says it.
    """
    rows = require_columns(df, key, season)
    types = dict(numbers or {}) | ({canonical: "long"} if canonical else {})
    absent = lambda c, kind: F.lit(None).cast(kind).alias(c)
    number = lambda c, kind: number_or_null(c, kind).alias(c) if c in df.columns else absent(c, kind)
    text = lambda c: text_or_null(c).alias(c) if c in df.columns else absent(c, "string")
    columns = [F.lit(season).alias("season"), *(raw_id(text_or_null(c)).alias(c) for c in key), *map(text, texts), *(number(c, kind) for c, kind in types.items())]
    if canonical:
        said = text_or_null("mapping_status") if "mapping_status" in df.columns else F.lit(None).cast("string")
        columns.append(said.alias("mapping_status"))
    out = rows.select(*columns)
    if canonical:
        out = out.withColumn("mapping_status", F.coalesce("mapping_status", F.when(F.col(canonical).isNotNull(), "mapped").otherwise("unmapped")))
    return reduce(lambda a, c: a.where(F.col(c).isNotNull()), key, out)


def player_pool(df: DataFrame) -> DataFrame:
    """The current pool as typed rows, each with `problem`: the first thing that is wrong with it, or null.

    `df` has player_id, name, team_id, position, price, status, chance (percent), eligible, as text or numbers.
    """
    number = number_or_null
    chance, raw = number("chance", "double"), text_or_null("chance")
    rows = df.select(
        number("player_id", "long").alias("player_id"),
        text_or_null("name").alias("name"),
        number("team_id", "long").alias("team_id"),
        F.upper(text_or_null("position")).alias("position"),
        number("price", "double").alias("price"),
        F.coalesce(text_or_null("status"), F.lit("")).alias("status"),
        chance.alias("chance"),
        F.coalesce(F.lower(F.col("eligible").cast("string")).isin("true", "1", "yes", "t"), F.lit(False)).alias("eligible"),
        (raw.isNotNull() & (chance.isNull() | ~chance.between(0, 100))).alias("_bad_chance"),
    )
    repeats = rows.groupBy("player_id").agg(F.count("*").alias("_n"))
    problem = F.when(F.col("player_id").isNull() | F.col("team_id").isNull(), "missing_id").when(F.col("_n") > 1, "repeated_id").when(F.col("_bad_chance"), "chance_out_of_range")
    return rows.join(repeats, "player_id", "left").withColumn("problem", problem).drop("_n", "_bad_chance")


def mapping_template(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row per raw id with its most frequent name (of equals the first) and empty columns for the mapping."""
    rows = df.select(raw_id(text_or_null(key)).alias(key), text_or_null(name).alias(name)).where(F.col(key).isNotNull())
    named = rows.groupBy(key, name).agg(F.count("*").alias("_n")).groupBy(key)
    best = named.agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(name).isNull().alias("none"), F.col(name).alias("name"))).alias("_best"), F.sum("_n").alias("rows"))
    return best.select(key, F.col("_best.name").alias(name), "rows", F.lit(None).cast("long").alias("canonical_id"), F.lit("unmapped").alias("mapping_status"))


def mapped(df: DataFrame, mapping: DataFrame | None, key: str, out: str, direct: bool = False) -> DataFrame:
    """`df` with the canonical id of `key`: from `mapping` (raw_id, canonical_id), or with `direct` the number itself."""
    own = F.col(key).try_cast("long") if direct else F.lit(None).cast("long")
    if mapping is None:
        return df.withColumn(out, own)
    pairs = mapping.where("canonical_id IS NOT NULL").groupBy(F.col("raw_id").cast("string").alias("_raw")).agg(F.min("canonical_id").cast("long").alias("_canonical"))
    return df.join(pairs, F.col(key) == F.col("_raw"), "left").withColumn(out, F.coalesce("_canonical", own)).drop("_raw", "_canonical")


def import_rows(rows: DataFrame, path: str, season: str, required: Sequence[str], write: bool = False) -> DataFrame:
    """One row: rows, rows without a required id, and whether they were written. Without `write` nothing is; nor if an id is missing.

    The season's partition is replaced and the others stay.
    """
    unmapped = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in required), F.lit(False))
    report = rows.agg(F.count("*").alias("rows"), F.count_if(unmapped).alias("unmapped")).first()
    done = write and report["rows"] > 0 and report["unmapped"] == 0
    if done:
        rows.withColumn("season", F.lit(season)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    return rows.sparkSession.range(1).select(F.lit(report["rows"]).alias("rows"), F.lit(report["unmapped"]).alias("unmapped"), F.lit(done).alias("written"))
