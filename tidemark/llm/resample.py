"""Importance resampling towards a target distribution.

The features of a text are its runs of consecutive words, hashed to buckets. A bucket's gain is the logarithm of its share in
the target over its share in the corpus, a text's weight the sum of the gains of its features, and the documents to draw are
those with the highest weight plus Gumbel noise, which is a draw without replacement in proportion to the weights.

Identical texts are collapsed first, by grouping the full text: features are computed and weighed once for each distinct
text, the corpus counts are those of the distinct texts times their multiplicity. Weights return to the documents by the text's digest, and only
then comes the noise, which belongs to a document and not to its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.batches import pack_places, unpack_places
from tidemark.llm.bpe import _Table
from tidemark.llm.common import cut, map_arrow

BUCKETS = 10_000
#: Words whose bucket a worker keeps.
KNOWN = 200_000
#: Letters and digits as they are, A-Z lower-cased, all bytes beyond ASCII; everything else separates words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PLACE_BITS = 33


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def feature_buckets(found: list[bytes], longest: int, buckets: int, known: dict) -> np.ndarray:
    """The bucket of each run of 1 to `longest` consecutive words, repeats included."""
    out = [np.fromiter(map(known.__getitem__, found), np.int64, len(found))]
    for k in range(2, longest + 1):
        out.append(np.fromiter((crc32(b" ".join(found[i : i + k])) % buckets for i in range(len(found) - k + 1)), np.int64))
    return np.concatenate(out)


def features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """A row for each distinct text: digest (sha256), times, n_words, n_features, and the buckets it has with how often (packed)."""
    known = _Table(lambda word: crc32(word) % buckets, KNOWN)

    def rows(batch: pa.RecordBatch) -> dict:
        found = [words(t) for t in batch.column(2).to_pylist()]
        made = [np.unique(feature_buckets(w, longest, buckets, known), return_counts=True) for w in found]
        return {"digest": batch.column(0), "times": batch.column(1), "n_words": list(map(len, found)), "n_features": [int(n.sum()) for _, n in made], "buckets": [pack_places(b) for b, _ in made], "counts": [pack_places(n) for _, n in made]}

    distinct = texts.groupBy("text").agg(F.count("*").alias("times")).select(F.unhex(F.sha2("text", 256)), "times", "text")
    return map_arrow(distinct, rows, "digest binary, times long, n_words long, n_features long, buckets binary, counts binary")


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """The features in each bucket over all texts, copies counted. One row for each bucket and task is added up; the driver gets a number for each bucket."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for times, where, n in zip(*(c.to_pylist() for c in batch.columns)):
                total[unpack_places(where)] += times * unpack_places(n)
        yield pa.record_batch({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(buckets, np.int64)
    for r in found.select("times", "buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 ln of each bucket's share in the target over that in the corpus, every bucket counted once more, rounded down."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the sha256 of `seed:id`. A null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank of every row; rank is null where the row is not drawn.

    Of the N rows with at least `least_words` words, floor(percent N / 100) with the highest score are drawn, ties to the
    smaller id, a null id last. `target` has texts under `text_col`. A null text has no words and the weight 0. Repeated ids are rows of their own with the same
    noise. Other columns are not read; an empty table gives no rows, an empty target only lowers common features.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    found = cut(features(rows.select("text"), longest, buckets), "features")
    gain = gains(totals(found, buckets), totals(features(target.select(text.alias("text")), longest, buckets), buckets))

    def weigh(batch: pa.RecordBatch) -> dict:
        weights = [int(gain[unpack_places(b)] @ unpack_places(n)) for b, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        return {"digest": batch.column(0), "n_words": batch.column(1), "n_features": batch.column(2), "weight": weights}

    weighed = map_arrow(found.select("digest", "n_words", "n_features", "buckets", "counts"), weigh, "digest binary, n_words long, n_features long, weight long")
    each = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest")).join(weighed, "digest")
    scored = cut(each.select("id", "n_features", "weight", (F.col("weight") + noise("id", seed)).alias("score"), (F.col("n_words") >= least_words).alias("enough")), "scored")
    sorted_ = cut(scored.orderBy(F.desc("enough"), F.desc("score"), F.asc_nulls_last("id")).withColumn("at", F.monotonically_increasing_id()), "sorted")
    placed = sorted_.withColumn("part", F.shiftright("at", PLACE_BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("enough").alias("n_enough"))  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.floor(F.lit(percent) * F.sum("n_enough").over(Window.partitionBy()) / 100).cast("long").alias("drawn"))
    place = F.col("first") + F.col("at").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    return placed.join(F.broadcast(parts), "part").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(place <= F.col("drawn"), place).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` whose id is drawn by `resample`, as they are."""
    ids = resample(docs, target, id_col=id_col, **how).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_drawn"]), "left_semi")
