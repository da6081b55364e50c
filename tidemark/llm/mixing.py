"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the number of times each of its documents is taken on average:
everyone is taken the whole part of it, and the fraction is the inclusion probability of one more
copy. The cube method turns the probabilities into zeros and ones: as long as three documents of a
source are undecided, their probabilities move along a direction in which neither the expected
words nor the expected number of documents changes, until one of the three is decided. Two
documents are left at most, and are landed by a draw.

A source is dealt to buckets of bounded size. Each bucket is balanced by itself and leaves two
documents at most; what is left of all buckets of a source is balanced again in the same way, until
one bucket is left. So no task meets a whole source, however much of the corpus it holds, and the
totals are kept at every level. Draws come from hashes of the ids: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
BUCKET = 2_000
SEED = 42
#: Closer to 0 or 1 than this, a probability is decided.
TINY = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """_source, _docs, _size and _target out of one row per source (_source, _docs, _size).

    Sources in code-point order, null last, take the weights in turn and share the total size. A
    target above `limit` times its source's size stops there and its excess is shared by weight among
    the others, until none is above. The level that this ends in is found from running sums over the
    sources in the order in which they fill up; the table has one row per source.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("_weight", F.element_at(turn, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(limit) * F.col("_size"))
    full = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before, rest, all_ = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    total = F.sum("_size").over(all_)
    ranked = ranked.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
    open_ = F.col("_level") <= F.col("_cap") / F.col("_weight")
    # The first source that doesn't fill up sets the level of all from there on; those before it are full.
    level = F.min(F.when(open_, F.struct((F.col("_cap") / F.col("_weight")).alias("at"), F.col("_level").alias("level")))).over(all_)["level"]
    return ranked.select("_source", "_docs", "_size", F.least("_cap", F.coalesce(level * F.col("_weight"), "_cap")).alias("_target"))


def _draw(*parts) -> float:
    """A number from 0 to 1 that depends on the parts alone."""
    return xxhash.xxh64_intdigest(repr(parts), SEED) / 2.0**64


def _direction(s: list[float]) -> tuple[float, float, float]:
    """A direction that changes neither the sum of p nor that of s * p."""
    a, b, c = s[1] - s[2], s[2] - s[0], s[0] - s[1]
    return (a, b, c) if a or b or c else (1.0, -1.0, 0.0)


def flight(sizes: np.ndarray, chances: np.ndarray, key) -> np.ndarray:
    """The chances after the flight: zeros and ones, but for two at most. Sums of chances and of sizes * chances stay."""
    p = chances.astype(float).tolist()
    s = sizes.astype(float).tolist()
    held: list[int] = []
    for i in range(len(p)):
        if not TINY < p[i] < 1 - TINY:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        u = _direction([s[j] for j in held])
        up = min(((1 - p[j]) / d if d > 0 else -p[j] / d) for j, d in zip(held, u) if d)
        down = min((p[j] / d if d > 0 else (p[j] - 1) / d) for j, d in zip(held, u) if d)
        step = up if _draw(key, i) * (up + down) < down else -down
        for j, d in zip(held, u):
            p[j] += step * d
            if not TINY < p[j] < 1 - TINY:
                p[j] = float(round(p[j]))
        held = [j for j in held if 0 < p[j] < 1]
    return np.array(p)


def landing(sizes: np.ndarray, chances: np.ndarray, key) -> np.ndarray:
    """Decide the two chances or fewer that a flight has left, so that the expected words are met as well as can be."""
    p, left = chances.copy(), [i for i in range(len(chances)) if 0 < chances[i] < 1]
    want = sum(sizes[i] * p[i] for i in left)
    choices = sorted(range(1 << len(left)), key=lambda c: (abs(want - sum(sizes[i] for k, i in enumerate(left) if c >> k & 1)), _draw(key, c)))
    for k, i in enumerate(left):
        p[i] = choices[0] >> k & 1
    return p


def _balanced(undecided: DataFrame, buckets: int, level: int) -> DataFrame:
    """_row, _words, _group, _p after the flight in each bucket, or after flight and landing where a source has one bucket."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", ignore_index=True)
        draw_by = (level, *map(int, key))
        p = flight(pdf["_words"].to_numpy(), pdf["_p"].to_numpy(), draw_by)
        return pdf.assign(_p=landing(pdf["_words"].to_numpy(), p, draw_by) if buckets == 1 else p)[["_row", "_words", "_group", "_p"]]

    dealt = undecided.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(buckets)))
    return dealt.groupBy("_group", "_bucket").applyInPandas(one, "_row long, _words long, _group long, _p double")


def _levels(most: int, bucket: int) -> Iterator[int]:
    """Buckets of each level for a source of `most` documents; the last level has one."""
    while most > bucket:
        buckets = -(-most // bucket)
        yield buckets
        most = 2 * buckets
    yield 1


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, times, taken.

    size is the number of words (null text: 0), target what the row's source should give, times how
    often the row is taken (a whole number up to `limit`), taken the words that makes. Sources get the
    weights in code-point order, null last; together they share the size of the corpus. A source
    without words has target 0. Rows with the same id are drawn for alike; rows with a null id count
    as one id each source. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("_words"))
    rows = cut(rows.withColumn("_row", F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")))), "sizes")
    sizes = rows.groupBy("_source").agg(F.count("*").alias("_docs"), F.sum("_words").alias("_size"))
    ratio = F.coalesce(F.try_divide(F.col("_target"), F.col("_size")), F.lit(0.0))
    by_source = cut(targets(sizes, weights, limit).withColumn("_group", F.xxhash64(F.col("_source").isNull(), "_source")).withColumn("_whole", F.floor(ratio + F.lit(TINY)).cast("int")).withColumn("_p", F.greatest(ratio - F.col("_whole"), F.lit(0.0))), "targets")
    most = by_source.where(F.col("_p") > TINY).agg(F.max("_docs")).first()[0] or 0
    everyone = rows.join(by_source, rows["_source"].eqNullSafe(by_source["_source"])).drop(by_source["_source"])
    undecided = everyone.where(F.col("_p") > TINY).groupBy("_group", "_row").agg(F.first("_p").alias("_p"), F.sum("_words").alias("_words"))
    taken = None
    for level, buckets in enumerate(_levels(most, bucket)):
        after = cut(_balanced(undecided, buckets, level), "flight")
        chosen = after.where("_p = 1").select("_group", "_row", F.lit(1).alias("_more"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        undecided = after.where("_p > 0 AND _p < 1")
    times = F.col("_whole") + F.coalesce("_more", F.lit(0))
    return everyone.join(taken, ["_group", "_row"], "left").select(
        F.col("_id").alias(id_col),
        F.col("_words").alias("size"),
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        times.alias("times"),
        (times * F.col("_words")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as the mix takes them: rows that it takes several times are repeated, the others go. All columns stay as they are."""
    chosen = mix(docs, weights, limit, BUCKET, id_col, text_col, source_col).select(F.col(id_col).alias("_taken"), "times").where("times > 0").distinct()
    together = docs.join(chosen, docs[id_col].eqNullSafe(chosen["_taken"]))
    rows = together.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), chosen["times"])))
    places = [f"_{i}" for i in range(len(docs.columns))]
    return rows.toDF(*places, "_copy").select(*(F.col(p).alias(c) for p, c in zip(places, docs.columns)))
