"""The numbered operators over their whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, ann, bpe, exact_dedup, katz, langid, mixing, resample, simhash, substring_dedup, token_counts, token_store, url_filter
from tidemark.llm.common import new_path


#: verdict, host, path
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt anew where the scan has fewer splits than the cluster has cores: a row group is one split.

    `table` is a bare scan, so that counting its splits runs nothing.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(spread(documents(spark, sf_dir)), vocabulary, decoded="decoded").select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(spread(documents(spark, sf_dir)), shingle=3, radius=3)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(spread(documents(spark, sf_dir)), window=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5.0, 2.0, 1.0), limit=3.0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(documents(spark, sf_dir))


#: Numbers of three digits and more, and mail addresses: what op6 masks.
MASKED = r"(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+|\d{3,}"
MASK = "[masked]"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and after every number and mail address in it is masked, counted from the edits alone."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    trees = token_counts.build_trees(spread(documents(spark, sf_dir)), vocabulary, keep=("text",)).withColumn("n_tokens", token_counts.count())
    after = token_counts.apply_edits(trees, vocabulary, finder=token_counts.replacing(MASKED, MASK), keep=("n_tokens",))
    return after.select("doc_id", "n_tokens", F.col("n_edits").cast("long").alias("n_edits"), token_counts.count().alias("n_tokens_after"), F.col("encoded").alias("chars_encoded"))


def held_out(col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(documents(spark, sf_dir))
    found = langid.identify(docs, langid.fit(docs.where(~F.coalesce(held_out(), F.lit(False)))))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    manifest = token_store.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    stored = token_store.read_tokens(manifest, path)
    return stored.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, url_filter.default_model(spark))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(spread(documents(spark, sf_dir)), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), links="ends")
    return found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability by a model of those whose crc32 of the id as text does not leave 2 when divided by 7."""
    docs = spread(documents(spark, sf_dir))
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = katz.katz(docs, ~apart)
    return model.scores.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", F.lit(model.stats[0].tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spread(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=10, least_words=20, longest=1, buckets=10_000, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_token_store": op8_token_store,
    "op9_url_filter": op9_url_filter,
    "op10_nearest": op10_nearest,
    "op11_alignment": op11_alignment,
    "op12_katz": op12_katz,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
