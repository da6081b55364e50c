"""Questions of a batch of documents to the whole corpus.

A batch is some documents of one partition, up to a number of bytes of text. What it needs to know about its items
(words, n-grams, pairs of ids) it asks once for each distinct item: the items are dealt to buckets by a hash, a
row of packed arrays for each batch and bucket. A bucket goes through the rows of all batches, which is where
counts over the corpus come from, and answers each row with arrays in the same order. So an item that every document has
costs its bucket one entry a batch, and no join by item is needed.

A batch is written to the shared folder before it asks, so its number means the same documents after lost tasks too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions

#: Characters of the corpus for each bucket.
BUCKET_CHARS = 8 << 20
#: The number of a batch: its partition, then its place there.
PLACE_BITS = 20


def pack(values: np.ndarray) -> bytes:
    """Whole numbers or doubles, compressed byte plane by byte plane."""
    data = np.ascontiguousarray(values if values.dtype == np.float64 else values.astype(np.int64))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, dtype=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(dtype).ravel()


def pack_places(places: np.ndarray) -> bytes:
    """Numbers below 2 to the 32, as by `pack`."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_places(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def scattered(values: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)


def buckets_for(docs: DataFrame, text_col: str) -> int:
    """How many buckets the items of a table are dealt to: they grow with its text."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-chars // BUCKET_CHARS))


def in_batches(rows: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The number of each batch and its rows, as tuples of Python values; the last column is the text. A batch ends with the text that reaches `limit` characters. Its rows are to be read before the next one."""
    part, place, held = TaskContext.get().partitionId() << PLACE_BITS, 0, None
    stream = (row for batch in rows for start in range(0, batch.num_rows, 1024) for row in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns)))

    def some(row: tuple) -> Iterator[tuple]:
        nonlocal held
        size = 0
        while row is not None:
            size += len(row[-1])
            yield row
            row = next(stream, None)
            if size >= limit:
                break
        held = row

    held = next(stream, None)
    while held is not None:
        yield part | place, some(held)
        place += 1


def answered(asked: DataFrame, answer: Callable[[int, list[dict]], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """`answer(bucket, its rows by batch)` for every bucket. `asked` has bucket and batch; a task holds one bucket at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for row in (r for b in batches for r in b.to_pylist()):
            if held and row["bucket"] != bucket:
                yield pa.RecordBatch.from_pylist(list(answer(bucket, held)), schema)
                held = []
            bucket = row["bucket"]
            held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(list(answer(bucket, held)), schema)

    n = partitions(asked.sparkSession)
    return asked.repartition(n, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, ddl)
