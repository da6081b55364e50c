"""Matching records of two pools that share no key, and deciding which matches are safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import compact_name, initial_surname, matching_ratio, name_variants, normal_name
from tidemark.operators.similarity import contained_pairs, similar_pairs


def with_variants(pool: DataFrame, name: str) -> DataFrame:
    return pool.withColumn("variants", name_variants(name))


def block_keys(variants: str | Column, letters: int = 3) -> Column:
    """What two spellings of one name have in common somewhere: the first and the last letters of each word of each variant, marked apart."""
    words = F.array_distinct(F.flatten(F.transform(variants, lambda v: F.split(v, " "))))
    first = F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, letters)))
    last = F.transform(words, lambda w: F.concat(F.lit("$"), F.substring(w, -letters, letters)))
    return F.array_distinct(F.concat(first, last))


def blocked_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, letters: int = 3) -> DataFrame:
    """Candidate pairs that share a block key of their variants; each pair once.

    Pools are met by key instead of all with all. A pair with no word that starts or ends alike is no
    candidate; the tests hold the recall on misspelt names against all pairs.
    """
    keys = lambda df, i: df.select(i, F.explode(block_keys(F.col("variants"), letters)).alias("_key"))
    return keys(left, left_id).join(keys(right, right_id), "_key").select(left_id, right_id).distinct()


def variant_score(pairs: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """The best score of any two spellings: 1.0 (0.85 if short) where equal, 0.78 + 0.12 * short / long where one holds the other, else the matching ratio."""
    rows = pairs.select(*keys, F.explode(left).alias("_a"), right).select(*keys, "_a", F.explode(right).alias("_b"))
    short, long = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    equal, held = F.col("_a") == F.col("_b"), F.contains("_a", "_b") | F.contains("_b", "_a")
    plain = F.when(equal, F.when(short >= 4, 1.0).otherwise(0.85)).when(held, 0.78 + 0.12 * short / long)
    known, fuzzy = rows.withColumn("_score", plain).where("_score IS NOT NULL"), rows.where(~equal & ~held).withColumn("_score", matching_ratio("_a", "_b"))
    return known.unionByName(fuzzy).groupBy(*keys).agg(F.max("_score").alias("name_score"))


def needed_name_score(score: float, position: float = 0.12, team: float = 0.06, weight: float = 0.82) -> float:
    """The least name score with which `match_score` can still reach `score`."""
    return (score - position - team) / weight


def scored_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, a: str, b: str, minimum: float, **how) -> DataFrame:
    """Every pair of records with a name score of `minimum` or more, and the score, as `variant_score` over all pairs would give it.

    Spellings meet by similarity joins over the distinct ones, so no pair is lost and none is formed that shares nothing. Records with
    one spelling meet by it alone: those of a very frequent spelling are pairs that the result has to have.
    """
    spelt = lambda df, i, c, out: df.select(i, F.explode(c).alias(out)).distinct()
    mine, theirs = spelt(left, left_id, a, "_a"), spelt(right, right_id, b, "_b")
    short, long = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    plain = F.when(F.col("_a") == F.col("_b"), F.when(short >= 4, 1.0).otherwise(0.85)).otherwise(0.78 + 0.12 * short / long)
    held = contained_pairs(mine, theirs, "_a", "_b", min(1.0, max(0.0, (minimum - 0.78) / 0.12))).withColumn("_score", plain)
    like = similar_pairs(mine, theirs, "_a", "_b", minimum, **how).where(~F.contains("_a", "_b") & ~F.contains("_b", "_a")).withColumnRenamed("ratio", "_score")
    scores = held.unionByName(like).where(F.col("_score") >= minimum)
    return mine.join(scores, "_a").join(theirs, "_b").groupBy(left_id, right_id).agg(F.max("_score").alias("name_score"))


def match_score(name_score: str | Column, position_match: Column, position_known: Column, team_match: Column, exact_initial: Column, exact_name: Column) -> Column:
    """Name, position and team evidence as one score from 0 to 1, raised where an exact name says so."""
    base = F.col(name_score) * 0.82 if isinstance(name_score, str) else name_score * 0.82
    base = base + F.when(position_match, 0.12).when(position_known, -0.10).otherwise(0.0) + F.when(team_match, 0.06).otherwise(0.0)
    base = F.when(exact_initial, F.greatest(base, F.when(position_match, 0.98).otherwise(0.92))).otherwise(base)
    base = F.when(exact_name & position_match, F.greatest(base, F.lit(0.94))).otherwise(base)
    return F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))


def team_score(name_score: str | Column, same_short: Column, same_name: Column) -> tuple[Column, Column, Column]:
    """(score, kind of match, whether it is safe to approve) of a pair of clubs: short names count most, an exact name raises the score."""
    name = F.col(name_score) if isinstance(name_score, str) else name_score
    short, exact = F.coalesce(same_short, F.lit(False)), F.coalesce(same_name, F.lit(False))
    base = name * 0.35 + F.when(short, 0.65).otherwise(0.0)
    score = F.when(short & exact, F.lit(1.0)).when(short, F.greatest(base, F.lit(0.96))).when(exact, F.greatest(base, F.lit(0.94))).otherwise(base)
    kind = F.when(short & exact, "exact_short_name_and_exact_name").when(short, "exact_short_name").when(exact, "exact_name").otherwise("similar_name")
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), kind, short | exact


def rank_candidates(scored: DataFrame, left_id: str, right_id: str, score: str, ambiguous_within: float = 0.03) -> DataFrame:
    """Candidates of each left record in order, the gap to the next, and whether the first is ambiguous."""
    w = Window.partitionBy(left_id).orderBy(F.desc(score), right_id)
    rows = scored.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col(score) - F.lead(score).over(w))
    return rows.withColumn("ambiguous", F.coalesce((F.col("rank") == 1) & (F.col("gap") < ambiguous_within), F.lit(False)))


def approve(ranked: DataFrame, left_id: str, right_id: str, score: str, minimum: float = 0.95) -> DataFrame:
    """Each left record's first candidate with its status; a right record that several win goes to the best, to none on a tie."""
    first = ranked.where("rank = 1")
    good = (F.col(score) >= minimum) & ~F.col("ambiguous")
    place = F.rank().over(Window.partitionBy(right_id).orderBy(F.when(good, 0).otherwise(1), F.desc(score)))
    rows = first.withColumn("_good", good).withColumn("_place", place)
    winners = F.count_if(F.col("_good") & (F.col("_place") == 1)).over(Window.partitionBy(right_id))
    status = F.when(F.col("_good") & (F.col("_place") == 1) & (winners == 1), "auto_approved").when(F.col("_good"), "duplicate_target").otherwise("manual_review")
    return rows.withColumn("status", status).drop("_good", "_place")


def rollover_map(before: DataFrame, after: DataFrame, before_id: str, after_id: str, name: str, web: str, team: str) -> DataFrame:
    """Pairs by a full name that both sides have once, else by a web name that both have once within an unchanged team."""

    def unique(df: DataFrame, i: str, keys: list[Column]) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(i).alias(i)).where("_n = 1").drop("_n")

    full = [normal_name(name).alias("_name")]
    by_name = unique(before, before_id, full).join(unique(after, after_id, full), "_name").select(before_id, after_id, F.lit("full_name").alias("how"))
    left, right = before.join(by_name, before_id, "left_anti"), after.join(by_name, after_id, "left_anti")
    short = [compact_name(web).alias("_web"), F.col(team).alias("_team")]
    by_web = unique(left, before_id, short).join(unique(right, after_id, short), ["_web", "_team"]).select(before_id, after_id, F.lit("web_name_and_team").alias("how"))
    return by_name.unionByName(by_web)


def accepted(mapping: DataFrame, statuses: list[str], right_id: str) -> DataFrame:
    """Mapped rows of the accepted statuses."""
    return mapping.where(F.col("status").isin(statuses) & F.col(right_id).isNotNull())


def same_initial(a: str, b: str) -> Column:
    return F.coalesce(initial_surname(a) == initial_surname(b), F.lit(False))
