"""Similarity joins of texts that lose no pair.

Two texts that some insertions and deletions (or replacements) turn into one another keep most of their letters in place: if one is cut into
d + k segments and d edits lie between them, at least k segments stand in the other text as they are, each moved by what
was inserted and deleted before it. So pairs meet by equal segments, never all with all. One segment that very many
texts share would be a group without bound: such a key is left out, and texts that have one meet again by two segments, then by three, where d + k
segments are cut. What meets is then filtered by bounds that no similar pair can miss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import matching_ratio

#: Texts of either side that one key may have before they meet by more segments.
GROUP_LIMIT = 1000
#: Most segments that texts meet by; keys of the last round are dealt over several tasks instead.
ROUNDS = 3


@dataclass(frozen=True)
class Reach:
    """How far apart two texts may be: edits by both lengths, and the shortest and longest partner of a length."""

    edits: Callable[[Column, Column], Column]
    shortest: Callable[[Column], Column]
    longest: Callable[[Column], Column]


def within_distance(edits: int) -> Reach:
    """Texts within so many insertions, deletions and replacements."""
    return Reach(lambda a, b: F.lit(edits), lambda n: F.greatest(F.lit(1), n - edits), lambda n: n + edits)


def within_ratio(minimum: float) -> Reach:
    """Texts whose matching blocks hold at least this share of all letters, 2 M / (m + n): all else, (1 - minimum)(m + n) letters at most, is inserted or deleted."""
    if not 2 / 3 < minimum <= 1:
        raise ValueError("a ratio over 2/3 is needed: below it a text has fewer letters than segments")
    near = 1e-9
    return Reach(
        lambda a, b: F.floor((1 - minimum) * (a + b) + near).cast("int"),
        lambda n: F.greatest(F.lit(1), F.ceil(n * (minimum / (2 - minimum)) - near).cast("int")),
        lambda n: F.floor(n * ((2 - minimum) / minimum) + near).cast("int"),
    )


def letter_bound(a: str, b: str) -> Column:
    """2 common letters / all letters. No matching ratio is above it, as matching blocks are common letters."""
    n = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    letters = F.array_distinct(F.split(a, ""))
    common = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda sum_, c: sum_ + F.least(n(F.col(a), c), n(F.col(b), c)))
    return 2 * common / (F.length(a) + F.length(b))


def _cut(step: Column, length: Column, n: Column) -> Column:
    """Where segment number `step` of n starts."""
    return F.floor(step * length / n).cast("int")


def _keys(texts: DataFrame, text: str, reach: Reach, k: int, segmented: bool) -> DataFrame:
    """`text` and _key for every choice of k segments: those of the text itself, or what stands where they may be in it."""
    own, other = ("_m", "_n") if segmented else ("_n", "_m")
    rows = texts.select(text, F.length(text).alias(own)).withColumn(other, F.explode(F.sequence(reach.shortest(F.col(own)), F.greatest(reach.shortest(F.col(own)), reach.longest(F.col(own))))))
    rows = rows.withColumn("_d", reach.edits(F.col("_m"), F.col("_n"))).where(F.abs(F.col("_n") - F.col("_m")) <= F.col("_d"))
    parts, chosen, before, moved = F.col("_d") + k, [F.col("_m"), F.col("_n")], F.lit(-1), F.lit(0)
    for i in range(k):
        step, shift = f"_s{i}", f"_v{i}"
        rows = rows.withColumn(step, F.explode(F.sequence(before + 1, parts - (k - i))))
        start, end = _cut(F.col(step), F.col("_m"), parts), _cut(F.col(step) + 1, F.col("_m"), parts)
        if segmented:
            at = start
        else:
            # moved by s: |s| edits before it and |n - m - s| after it at least
            gap = F.col("_n") - F.col("_m")
            rows = rows.withColumn(shift, F.explode(F.sequence(F.ceil((gap - F.col("_d")) / 2).cast("int"), F.floor((gap + F.col("_d")) / 2).cast("int"))))
            at = start + F.col(shift)
            rows = rows.where((at >= 0) & (end + F.col(shift) <= F.col("_n")) & (F.abs(moved) + F.abs(F.col(shift) - moved) + F.abs(gap - F.col(shift)) <= F.col("_d")))
            moved = F.col(shift)
        chosen += [F.col(step), F.substring(F.col(text), at + 1, end - start)]
        before = F.col(step)
    return rows.select(text, F.xxhash64(*chosen).alias("_key")).distinct()


def _dealt(rows: DataFrame, mine: str, theirs: str, text: str) -> DataFrame:
    """Rows of a key as one of `mine` shares, repeated for each of the `theirs` shares of the other side."""
    rows = rows.withColumn(mine, F.pmod(F.xxhash64(text), F.col(f"{mine}_n")).cast("int"))
    return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"{theirs}_n") - 1)))


def candidate_pairs(left: DataFrame, right: DataFrame, a: str, b: str, reach: Reach, group_limit: int = GROUP_LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """The distinct pairs (a, b) of different or equal texts that may be within `reach`; none that is lacks.

    Null and empty texts pair with nothing. No task meets more than some `group_limit` texts of either side under one key.
    """
    side = lambda df, c: df.where(F.length(c) > 0).select(c).distinct()
    mine, theirs, found = side(left, a), side(right, b), []
    for k in range(1, rounds + 1):
        x, y = _keys(mine, a, reach, k, True), _keys(theirs, b, reach, k, False)
        count = x.select("_key", F.lit(1).alias("_x")).unionAll(y.select("_key", F.lit(0).alias("_x"))).groupBy("_key").agg(F.sum("_x").alias("_nx"), F.count("*").alias("_all"))
        met = count.select("_key", "_nx", (F.col("_all") - F.col("_nx")).alias("_ny")).where("_nx > 0 AND _ny > 0")
        small = F.greatest("_nx", "_ny") <= group_limit
        if k < rounds:
            cool, hot = met.where(small).select("_key"), met.where(~small).select("_key")
            found.append(x.join(cool, "_key").join(y, "_key").select(a, b))
            mine, theirs = x.join(hot, "_key").select(a).distinct(), y.join(hot, "_key").select(b).distinct()
        else:
            shares = met.select("_key", *(F.ceil(F.col(n) / group_limit).cast("int").alias(f"{p}_n") for n, p in (("_nx", "_p"), ("_ny", "_q"))))
            dealt = _dealt(x.join(shares, "_key"), "_p", "_q", a).join(_dealt(y.join(shares, "_key"), "_q", "_p", b), ["_key", "_p", "_q"])
            found.append(dealt.select(a, b))
    return reduce(DataFrame.unionByName, found).distinct()


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, edits: int, **how) -> DataFrame:
    """Pairs of distinct texts at most so many insertions, deletions and replacements apart, with their distance."""
    pairs = candidate_pairs(left, right, a, b, within_distance(edits), **how)
    return pairs.withColumn("distance", F.levenshtein(a, b)).where(F.col("distance") <= edits)


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, minimum: float, **how) -> DataFrame:
    """Pairs of distinct texts whose matching ratio is `minimum` or more, with the ratio. Only pairs whose letters allow it are matched."""
    pairs = candidate_pairs(left, right, a, b, within_ratio(minimum), **how).where(letter_bound(a, b) >= minimum - 1e-12)
    return pairs.withColumn("ratio", matching_ratio(a, b)).where(F.col("ratio") >= minimum)


def contained_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least_share: float = 0.0) -> DataFrame:
    """Pairs of distinct texts of which one stands in the other and has at least this share of its letters. The longer text's substrings are the keys."""
    side = lambda df, c: df.where(F.length(c) > 0).select(c).distinct()

    def within(long: DataFrame, x: str, short: DataFrame, y: str) -> DataFrame:
        sizes = F.sequence(F.greatest(F.lit(1), F.ceil(F.length(x) * least_share - 1e-9).cast("int")), F.length(x))
        parts = long.select(x, F.explode(sizes).alias("_size")).select(x, "_size", F.explode(F.sequence(F.lit(1), F.length(x) - F.col("_size") + 1)).alias("_at"))
        parts = parts.select(x, F.substring(F.col(x), F.col("_at"), F.col("_size")).alias("_part")).distinct()
        return parts.join(short.withColumnRenamed(y, "_part"), "_part").select(F.col(x), F.col("_part").alias(y))

    mine, theirs = side(left, a), side(right, b)
    return within(mine, a, theirs, b).unionByName(within(theirs, b, mine, a)).distinct()
