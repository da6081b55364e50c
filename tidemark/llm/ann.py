"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are scaled by the largest norm and get one more component that makes them unit vectors, so
that the largest inner product is the smallest distance. Each curve projects them to a few random
directions, shifts them, and sorts them by their place on a Hilbert curve, range-partitioned in Spark.
A query's candidates are the vectors in a window around its own place on every curve; the windows
of all curves are merged and ranked by the exact inner product of the original vectors.

The window is measured, not guessed: for a fixed number of sample queries the true neighbours are
found by brute force, and the half-width is that which brings `recall` of them into one window at
least. Where the vectors have structure it is small; where they have none, as for independent
directions, no ordering helps and the windows grow toward the whole table, at the cost of a block-wise
scan by the query set.

Equal vectors are indexed once, with their smallest ids (as many as an answer can hold), so no number
of copies crowds a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions

CURVES = 4
DIRECTIONS = 6
CURVE_BITS = 8
SEED = 42
#: Vectors of a block: half a half-width, between these.
LEAST_BLOCK, MOST_BLOCK = 4096, 1 << 16
#: Queries that meet a block in one task, and products that it forms at once.
QUERIES = 1 << 16
PRODUCTS = 1 << 23
SAMPLE_QUERIES = 64
RECALL = 0.96
#: Standard deviations that the grid of a curve spans on either side.
SPAN = 3.0


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of grid points (rows of coordinates below 2 ** bits)."""
    x = places.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    while q > 1:  # undo the excess work of each level, highest bit first
        low = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | x[i] >> np.uint64(bit) & np.uint64(1)
    return key


def curve_frames(width: int, curves: int = CURVES, directions: int = DIRECTIONS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Orthonormal directions and a shift (of grid cells) for each curve, from a fixed seed."""
    draw = np.random.default_rng(seed)
    m = min(directions, width)
    return [(np.linalg.qr(draw.normal(size=(width, m)))[0], draw.random(m)) for _ in range(curves)]


def curve_keys(unit: np.ndarray, frame: tuple[np.ndarray, np.ndarray], bits: int = CURVE_BITS) -> np.ndarray:
    directions, shift = frame
    spread = SPAN / np.sqrt(unit.shape[1])
    cells = 1 << bits
    grid = np.floor((unit @ directions + spread) / (2 * spread) * (cells - 2) + shift)
    return hilbert(np.clip(grid, 0, cells - 1), bits).astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def inner(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact products of one query with many vectors; equal vectors give equal products."""
    return (vectors * query).sum(axis=1)


def _best(query: np.ndarray, near: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact products of the k best, ties to the smaller id. near: products as the matrix product gives them."""
    if len(ids) > k:
        slack = 1e-9 * (1 + np.abs(near).max())
        pick = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k] - slack)
    else:
        pick = np.arange(len(ids))
    exact = inner(query, vectors[pick])
    order = np.lexsort((ids[pick], -exact))[:k]
    return ids[pick][order], exact[order]


def products(queries: np.ndarray, vectors: np.ndarray, at_once: int = PRODUCTS) -> Iterator[np.ndarray]:
    """The products of each query with all vectors, query by query, formed for a few queries at a time."""
    step = max(1, at_once // max(1, len(vectors)))
    for start in range(0, len(queries), step):
        yield from queries[start : start + step] @ vectors.T


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _indexed(reps: DataFrame, width: int, longest: float, curves: int) -> tuple[DataFrame, DataFrame]:
    """curve, rep, vector, query, position (on its curve) of every distinct vector; and one row per curve with its length."""
    frames = curve_frames(width + 1, curves)

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, vector, query = batch.columns
            x = _matrix(vector) / longest
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
            unit = np.column_stack([x, rest])
            for c, frame in enumerate(frames):
                yield pa.record_batch({"curve": pa.array(np.full(len(x), c, np.int32)), "key": curve_keys(unit, frame), "rep": rep, "vector": vector, "query": query})

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch({"part": np.full(n, part, np.int32), "place": np.arange(at, at + n)} | {c: batch.column(c) for c in ("curve", "rep", "vector", "query")})
            at += n

    kind = reps.schema["vector"].dataType.simpleString()
    keys = reps.select("rep", "vector", "query").mapInArrow(keyed, f"curve int, key long, rep long, vector {kind}, query boolean")
    dealt = keys.repartitionByRange(partitions(reps.sparkSession), "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    placed = cut(dealt.mapInArrow(counted, f"part int, place long, curve int, rep long, vector {kind}, query boolean"), "curves")
    parts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    whole = placed.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.col("place"))
    starts = whole.groupBy("curve").agg(F.min("at").alias("first"), F.count("*").alias("length"))
    positions = whole.join(F.broadcast(starts), "curve").select("curve", "rep", "vector", "query", (F.col("at") - F.col("first")).alias("position"))
    return positions, starts.select("curve", "length")


def _true_neighbours(reps: DataFrame, sample: list, k: int) -> pd.DataFrame:
    """rep of the query and of its k nearest, for a few sample queries against all vectors."""
    q_ids, q = np.array([r["rep"] for r in sample]), np.array([r["vector"] for r in sample], np.float64)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                near = q @ x.T
                for i in range(len(q)):
                    best, score = _best(q[i], near[i], x, ids, k + 1)
                    yield pa.record_batch({"q": np.full(len(best), q_ids[i]), "rep": best, "score": score})

    found = reps.select("rep", "vector").mapInArrow(scan, "q long, rep long, score double").where("q <> rep")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rep").toPandas()


def measured_window(reps: DataFrame, positions: DataFrame, k: int, recall: float, sample_queries: int = SAMPLE_QUERIES) -> int:
    """The half-width that brings a share of the sample queries' true neighbours into one window at least."""
    sample = reps.where("query").orderBy(F.xxhash64("rep"), "rep").limit(sample_queries).select("rep", "vector").collect()
    truth = _true_neighbours(reps, sample, k) if sample else pd.DataFrame({"q": [], "rep": []})
    if not len(truth):
        return 1
    wanted = F.broadcast(reps.sparkSession.createDataFrame(pd.DataFrame({"rep": pd.unique(pd.concat([truth["q"], truth["rep"]]).astype("int64"))})))
    at = positions.select("curve", "rep", "position").join(wanted, "rep").toPandas().pivot(index="rep", columns="curve", values="position")
    apart = np.abs(at.loc[truth["q"]].to_numpy() - at.loc[truth["rep"]].to_numpy()).min(axis=1)
    return int(np.quantile(apart, recall, method="higher")) + 1


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, curves: int = CURVES, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", half_width: int | None = None, queries_at_once: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found by inner product, itself left out.

    Ties go to the smaller id. Vectors that are null, zero, or hold a null or non-finite component take
    no part, nor do null ids, nor vectors of another length than the most frequent one (of equals the
    longest). Rows that repeat id and vector are one. Other columns are not read; an empty table, or one
    vector alone, gives no rows. `half_width` fixes the window instead of measuring it. A block meets
    at most about `queries_at_once` queries in one task; where there are more it is repeated for each slice of them.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    widths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return none
    rows = rows.where(F.size("vector") == widths["n"])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = rows.agg(F.max(norm)).first()[0]
    reps = cut(rows.groupBy("vector").agg(F.min("id").alias("rep"), F.bool_or("query").alias("query")), "vectors")
    copies = Window.partitionBy("vector").orderBy("id")
    ids = rows.select("vector", "id").withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).distinct()
    members = cut(ids.join(reps, "vector").select("rep", "id"), "members")
    positions, lengths = _indexed(reps, widths["n"], longest, curves)
    w = half_width or measured_window(reps, positions, k, recall)
    block = block or min(max(LEAST_BLOCK, w // 2), MOST_BLOCK)

    slices = max(1, -(-reps.where("query").count() // queries_at_once))
    blocked = positions.select("curve", "rep", "vector", F.floor(F.col("position") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).toDF("at_curve", "rep", "vector", "at_block", "at_slice")
    last = F.floor((F.col("length") - 1) / block)
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("position") - w) / block)), F.least(last, F.floor((F.col("position") + w) / block)))
    asked = positions.where("query").join(F.broadcast(lengths), "curve").select("curve", "rep", "vector", F.pmod(F.xxhash64("rep"), F.lit(slices)).cast("int").alias("slice"), F.explode(reach).alias("block"))

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, found = np.array(right["vector"].tolist(), np.float64), right["rep"].to_numpy()
            q = np.array(left["vector"].tolist(), np.float64)
            for i, (rep, near) in enumerate(zip(left["rep"], products(q, x))):
                best, score = _best(q[i], near, x, found, k + 1)
                out.append((rep, score, -best))
        return pd.DataFrame(out, columns=["q", "score", "back"])

    met = asked.groupBy("curve", "block", "slice").cogroup(blocked.groupBy("at_curve", "at_block", "at_slice")).applyInPandas(ranked, "q long, score array<double>, back array<long>")
    found = met.select("q", F.explode(F.arrays_zip("score", "back")).alias("x")).select("q", (-F.col("x.back")).alias("rep"), "x.score")
    # A vector that several windows hold has one rank; ranks are cut before and after the exchange, so no list of all blocks is made.
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = found.withColumn("place", F.dense_rank().over(nearest)).where(F.col("place") <= k + 1).select("q", "rep", "score").distinct()
    each = rows.where("query").select("id", "vector").distinct().join(reps, "vector").select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    expanded = each.join(best, "q").join(members, "rep").where("id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return expanded.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
