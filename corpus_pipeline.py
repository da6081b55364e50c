"""From raw documents to token ids: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor has kept. `run` writes each
result as Parquet to the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, langid, mixing, simhash
from tidemark.llm.common import shared_dir, sweep, tables
from tidemark.llm.queries import held_out

#: The calibrated share of its language under which a text counts as not told.
MIN_SCORE = 0.6
VOCABULARY = "word_bpe_49k.json"
#: Rows of a batch that goes to a Python worker: texts can be long, and the JVM and the worker both hold a batch.
BATCH_ROWS = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    model = langid.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return langid.accepted(docs, model, MIN_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles the document with the smallest id stays."""
    return simhash.near_dedup(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target weights; a document that the mix takes several times is repeated."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed) and decoded_sha256 of every row of the mix."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs, vocabulary, keep=("doc_id", "lang", "source"), decoded="decoded")
    return encoded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


#: The working tables of the stage before, by application.
_made: dict[str, list[str]] = {}


def drop_working_tables(spark: SparkSession) -> None:
    sweep(spark, _made.pop(spark.sparkContext.applicationId, []))


def _stage(work):
    """The stage, after the working tables of the one before it, whose result is stored by now, are dropped. It sets the session's Arrow batches to BATCH_ROWS."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_working_tables(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        before = set(tables())
        out = work(spark, docs, sf_dir)
        _made[spark.sparkContext.applicationId] = [t for t in tables() if t not in before]
        return out

    return run_stage


STAGES = [
    ("language_id", _stage(language_id)),
    ("exact_dedup", _stage(exact)),
    ("near_dedup", _stage(near)),
    ("mixing", _stage(mix)),
    ("bpe", _stage(encode)),
]

#: SQL cannot express SimHash, the cube method or byte-pair encoding; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    drop_working_tables(spark)
    return docs
