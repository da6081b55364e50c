"""Filters, guarded joins, ordering and set operations with the rules that the queries share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **conditions) -> DataFrame:
    """Filters of which each is optional: a value, a list (any of), a pair as a range (None: open), or None for no filter."""
    for name, value in conditions.items():
        if value is None:
            continue
        if isinstance(value, tuple):
            low, high = value
            df = df if low is None else df.where(F.col(name) >= low)
            df = df if high is None else df.where(F.col(name) <= high)
        else:
            df = df.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return df


def either_side(df: DataFrame, value, first: str, second: str) -> DataFrame:
    """Rows with the value on one side or the other."""
    return df.where((F.col(first) == value) | (F.col(second) == value))


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive substring; %, _ and \\ stand for themselves."""
    quoted = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{quoted}%")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def guarded_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """A join that fails if the sides it takes for unique repeat a key: `one_to_one` or `many_to_one`.

    Keys are counted in the join's own exchange, so the guard is part of the plan and costs no pass of its own;
    the query fails when it runs. Null keys match nothing and may repeat: where `how` keeps them they are set apart
    before a guarded side is counted, so that they never meet in one task.
    """
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    one_to_one, how = cardinality == "one_to_one", how.replace("outer", "").strip("_") or "full"

    def guarded(df: DataFrame, side: str) -> DataFrame:
        times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        alone = F.assert_true(F.col("_times") == 1, f"the {side} side repeats keys of {list(keys)}")
        return df.where(known).withColumn("_times", times).where(alone.isNull()).drop("_times")

    out = (guarded(left, "left") if one_to_one else left).join(guarded(right, "right"), list(keys), how)
    if one_to_one and how in ("left", "full", "leftanti", "left_anti"):
        out = out.unionByName(left.where(~known), allowMissingColumns=True)
    if how in ("right", "full"):
        out = out.unionByName(right.where(~known), allowMissingColumns=True)
    return out


def lookup(df: DataFrame, names: DataFrame, key: str, name: str, into: str) -> DataFrame:
    """`df` with the name of a key, or Unknown(key). `names` is a dimension with `key` and `name`."""
    known = names.select(F.col(key).alias("_key"), F.col(name).alias(into))
    return df.join(known, df[key] == known["_key"], "left").withColumn(into, F.coalesce(into, F.concat(F.lit("Unknown("), F.col(key).cast("string"), F.lit(")")))).drop("_key")


def fallback_join(df: DataFrame, fine: DataFrame, coarse: DataFrame, fine_keys: Sequence[str], coarse_keys: Sequence[str], value: str, count: str, minimum: int) -> DataFrame:
    """`df` with `value` of the fine group if it has `minimum` members, else of the coarse group, and the level it is from."""
    fine = fine.select(*fine_keys, F.col(value).alias("_fine"), F.col(count).alias("_n"))
    coarse = coarse.select(*coarse_keys, F.col(value).alias("_coarse"))
    good = F.col("_n") >= minimum
    out = df.join(fine, list(fine_keys), "left").join(coarse, list(coarse_keys), "left")
    level = F.when(good, "fine").when(F.col("_coarse").isNotNull(), "coarse").otherwise("none")
    return out.withColumn(value, F.when(good, F.col("_fine")).otherwise(F.col("_coarse"))).withColumn("level", level).drop("_fine", "_coarse", "_n")


def grid(entities: DataFrame, first: int, last: int, period: str = "period") -> DataFrame:
    """Every entity in every period of a range: the periods are exploded on each row, nothing is cross-joined."""
    return entities.withColumn(period, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def reconcile(sources: Mapping[str, DataFrame], keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose value differs between the named sources by more than the tolerance, or is absent in one."""
    names = list(sources)
    rows = reduce(DataFrame.unionByName, (df.select(*keys, F.lit(n).alias("_source"), F.col(value).cast("double").alias("_value")) for n, df in sources.items()))
    wide = rows.groupBy(*keys).agg(*(F.max(F.when(F.col("_source") == n, F.col("_value"))).alias(n) for n in names))
    spread = F.greatest(*map(F.col, names)) - F.least(*map(F.col, names)) if len(names) > 1 else F.lit(0.0)
    missing = reduce(lambda a, b: a | b, (F.col(n).isNull() for n in names))
    return wide.withColumn("status", F.when(missing, "missing").when(spread > tolerance, "mismatch")).where("status IS NOT NULL")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of 1 to 200 rows in a total order."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 rows")
    return df.orderBy(*order).offset(offset).limit(limit)


def set_status(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key of either side with its status: unchanged, added or removed."""
    a, b = before.select(*keys).distinct().withColumn("_before", F.lit(True)), after.select(*keys).distinct().withColumn("_after", F.lit(True))
    return a.join(b, list(keys), "full").select(*keys, F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("unchanged").alias("status"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each key with its status (new, removed, changed, unchanged), the new values and the old ones as old_<value>.

    Values are compared null-safely. It serves kickoff changes and upserts alike: new rows are inserted,
    changed ones updated, unchanged ones skipped.
    """
    a = before.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("_before"))
    b = after.select(*keys, *values, F.lit(True).alias("_after"))
    same = reduce(lambda x, y: x & y, (F.col(v).eqNullSafe(F.col(f"old_{v}")) for v in values), F.lit(True))
    status = F.when(F.col("_before").isNull(), "new").when(F.col("_after").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, list(keys), "full").withColumn("status", status).select(*keys, "status", *values, *(f"old_{v}" for v in values))


def upsert_counts(diff: DataFrame) -> DataFrame:
    """inserted, updated and skipped rows of a snapshot diff."""
    n = lambda s: F.count_if(F.col("status") == s)
    return diff.agg(n("new").alias("inserted"), n("changed").alias("updated"), n("unchanged").alias("skipped"))


def unknown_keys(rows: DataFrame, known: DataFrame, key: str, show: int = 20) -> DataFrame:
    """One row: how many distinct keys are unknown and the first few of them in order."""
    lost = rows.select(key).join(known.select(key), key, "left_anti").distinct()
    few = lost.orderBy(key).limit(show)
    return lost.agg(F.count("*").alias("unknown")).crossJoin(few.agg(F.array_sort(F.collect_list(key)).alias("shown")))
