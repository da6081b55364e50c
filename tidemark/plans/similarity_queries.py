"""Queries of the similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import similarity as sim
from tidemark.plans.registry import query
from tidemark.sources.readers import table

#: Common letters of two texts, each as often as both have it, in DuckDB.
COMMON = "list_sum(list_transform(list_distinct(string_split(a.name, '')), lambda c: least(length(a.name) - length(replace(a.name, c, '')), length(b.name) - length(replace(b.name, c, '')))))"


def labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parts by name and brand, each once."""
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias(name)).distinct()


LABELS = "names AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part)"


@query(
    "j13_names_within_edits",
    f"""WITH {LABELS}
    SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name) AS distance, round(2.0 * {COMMON} / (length(a.name) + length(b.name)), 6) AS letter_bound
    FROM names a JOIN names b ON a.name < b.name WHERE levenshtein(a.name, b.name) <= 2""",
)
def names_within_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that two edits turn into one another: the edits may be anywhere, so neither beginnings nor ends need be alike."""
    pairs = sim.within_edits(labels(spark, sf_dir, "a"), labels(spark, sf_dir, "b"), "a", "b", 2).where("a < b")
    return pairs.select("a", "b", F.col("distance").cast("long").alias("distance"), F.round(sim.letter_bound("a", "b"), 6).alias("letter_bound"))


@query(
    "j13_names_contained",
    """WITH parts AS (SELECT DISTINCT p_name AS whole FROM part), words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT DISTINCT substr(p_name, 3, 6) FROM part)
    SELECT whole, word, round(0.78 + 0.12 * length(word) / length(whole), 6) AS score FROM parts JOIN words ON contains(whole, word) AND length(word) >= 0.4 * length(whole)""",
)
def names_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a word, or six letters from the third on, of any name: at least two fifths of their letters."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("whole")).distinct()
    words = names.select(F.explode(F.split("whole", " ")).alias("word")).union(names.select(F.substring("whole", 3, 6)))
    pairs = sim.contained_pairs(names, words, "whole", "word", 0.4)
    return pairs.select("whole", "word", F.round(0.78 + 0.12 * F.length("word") / F.length("whole"), 6).alias("score"))


@query("j13_similar_names")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose matching ratio is 0.85 or more. SQL has no such ratio; the tests hold the join against all pairs."""
    pairs = sim.similar_pairs(labels(spark, sf_dir, "a"), labels(spark, sf_dir, "b"), "a", "b", 0.85).where("a < b")
    return pairs.select("a", "b", F.round("ratio", 6).alias("ratio"))
