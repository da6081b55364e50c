"""Rows of one table with what was known at their time from another, and rows of the period that comes next.

The rows that ask are united with the history and each entity is walked once in order of time, so there is no join on time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach(probes: DataFrame, history: DataFrame, entity: Sequence[str], at: str, values: Sequence[str], inclusive: bool = False) -> DataFrame:
    """`probes` with the values of the entity's latest history row before their time (at it too, if `inclusive`); null where there is none.

    A value that is null in the latest row stays null. Rows of one entity and time in the history: the largest values count as the latest, compared in the order
    of `values`. Rows without a time or with a null in `entity` know nothing. Probes keep their columns, repeated ones too; `values` must not be among them.
    """
    known = F.struct(*(F.col(v) for v in values))
    late = F.lit(0 if inclusive else 1)
    own = probes.select(*(F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)), F.col(at).alias("_at"), F.struct(*probes.columns).alias("_probe"))
    past = history.where(F.col(at).isNotNull()).select(*(F.col(e).alias(f"_e{i}") for i, e in enumerate(entity)), F.col(at).alias("_at"), known.alias("_known"))
    keys = [f"_e{i}" for i in range(len(entity))]
    whole = reduce_and(F.col(k).isNotNull() for k in [*keys, "_at"])
    asking = own.where(whole)
    united = asking.withColumn("_known", F.lit(None).cast(past.schema["_known"].dataType)).withColumn("_turn", 1 - late).unionByName(past.withColumn("_probe", F.lit(None).cast(own.schema["_probe"].dataType)).withColumn("_turn", late))
    # at one time the history comes first where it counts, else last
    order = Window.partitionBy(*keys).orderBy("_at", "_turn", "_known").rowsBetween(Window.unboundedPreceding, -1)
    found = united.withColumn("_last", F.last("_known", ignorenulls=True).over(order)).where("_probe IS NOT NULL")
    rest = own.where(~whole).select("_probe", F.lit(None).cast(past.schema["_known"].dataType).alias("_last"))
    return found.select("_probe", "_last").unionByName(rest).select("_probe.*", *(F.col("_last")[v].alias(v) for v in values))


def reduce_and(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def next_period(history: DataFrame, entity: Sequence[str], period: str, carried: Sequence[str] = (), target: int | None = None) -> DataFrame:
    """`history` with one more row for every entity, for the period after its own last one, or for `target`.

    Its measures are null; columns in `carried` (a price, a position) hold their last known value. `is_next` marks it. Trailing features over the
    result see all of an entity's past in that row and nothing later. With `target` rows of that period and later are no past and go.
    """
    past = history.where(F.col(period) < target) if target is not None else history
    when = F.lit(target) if target is not None else F.max(period) + 1
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(period))).alias(c) for c in carried]
    rows = past.where(reduce_and(F.col(e).isNotNull() for e in entity)).groupBy(*entity).agg(when.cast(past.schema[period].dataType).alias(period), *last)
    return past.withColumn("is_next", F.lit(False)).unionByName(rows.withColumn("is_next", F.lit(True)), allowMissingColumns=True)
