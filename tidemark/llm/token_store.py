"""Token-id files of bit-plane shuffled, compressed blocks.

A shard file holds the ids of its documents one after another, in blocks of a fixed number of ids.
A block is transposed: byte plane k holds the k-th byte of every id (bit plane k the k-th bit), and
each plane is compressed by itself with zstandard. High planes are nearly constant and almost
vanish. After the blocks comes the index: for every chunk its offset, its ids, the length of each
plane and a checksum, and for every document its id and number of ids. A reader can take any
chunk without the others.

    shard := magic  (plane ...) ...  documents  index  uint64 length of index  magic
    index := JSON: plane kind, block size, chunks [offset, ids, [plane lengths], crc32], documents [offset, length, count]

Documents are range-partitioned and sorted by id, so the shards in order are one stream. Every attempt of a
task writes a file of its own name, and the manifest names those of the attempts that Spark has committed: nothing
is renamed or deleted, so lost executors and speculative tasks leave unnamed files at most. Paths are those that
pyarrow's file systems know (a local or mounted folder, hdfs, viewfs, s3, gs, abfs; s3a is read as s3).
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, filterfalse
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_symbols
from tidemark.llm.common import cut, partitions
from tidemark.llm.pretokens import WIDE, plain

MAGIC = b"TIDEIDS1"
BLOCK_IDS = 1 << 16
LEVEL = 3
KNOWN = 400_000
#: Texts that are split at once.
TEXTS_AT_ONCE = 256
#: Fixed value: the pattern of byte-level vocabularies.
PRE_TOKEN = plain(r"'(?:[stmd]|re|ve|ll)| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+")
BYTES_AT_ONCE = 8 << 20
BYTE_SYMBOLS = {b: s for b, s in enumerate(byte_symbols())}


# Planes


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The byte or bit planes of 32-bit ids, lowest first."""
    data = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [data[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Takes packed ids document by document; holds one block and the document index."""

    def __init__(self, stream, kind: str = "byte", block_ids: int = BLOCK_IDS):
        self._stream, self._kind, self._block = stream, kind, block_ids
        self._held, self._at = bytearray(), len(MAGIC)
        self._chunks: list = []
        self._ids, self._counts = array("q"), array("q")
        self._pack = zstandard.ZstdCompressor(level=LEVEL).compress
        stream.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        self._ids.append(doc_id)
        self._counts.append(len(ids) // 4)
        self._held += ids
        while len(self._held) >= 4 * self._block:
            self._flush(4 * self._block)

    def _flush(self, size: int) -> None:
        data = bytes(self._held[:size])
        del self._held[:size]
        planes = [self._pack(p) for p in to_planes(np.frombuffer(data, "<u4"), self._kind)]
        self._chunks.append([self._at, size // 4, list(map(len, planes)), zlib.crc32(data)])
        for p in planes:
            self._stream.write(p)
            self._at += len(p)

    def close(self) -> tuple[int, int]:
        """Documents and ids of the shard."""
        if self._held:
            self._flush(len(self._held))
        docs = self._pack(np.array([self._ids, self._counts], "<i8").tobytes())
        index = json.dumps({"planes": self._kind, "block": self._block, "chunks": self._chunks, "documents": [self._at, len(docs), len(self._ids)]}).encode()
        self._stream.write(docs + index + len(index).to_bytes(8, "little") + MAGIC)
        return len(self._ids), sum(self._counts)


class ShardReader:
    """Reads a shard through its index, chunk by chunk."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        tail = source.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token shard")
        length = int.from_bytes(tail[:8], "little")
        self._index = json.loads(source.read_at(length, size - 8 - len(MAGIC) - length))
        self.chunks = self._index["chunks"]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token counts of the documents, in order."""
        offset, length, count = self._index["documents"]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._source.read_at(length, offset)), "<i8").reshape(2, count)

    def chunk(self, k: int) -> bytes:
        """The packed ids of chunk k."""
        offset, n, lengths, crc = self.chunks[k]
        data = self._source.read_at(sum(lengths), offset)
        unpack, planes, at = zstandard.ZstdDecompressor().decompress, [], 0
        for size in lengths:
            planes.append(unpack(data[at : at + size]))
            at += size
        ids = from_planes(planes, n, self._index["planes"]).tobytes()
        if zlib.crc32(ids) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """Document id, first position in the shard, packed ids."""
        held, k, start = bytearray(), 0, 0
        for doc, count in zip(*(x.tolist() for x in self.documents())):
            while len(held) < 4 * count:
                held += self.chunk(k)
                k += 1
            yield doc, start, bytes(held[: 4 * count])
            del held[: 4 * count]
            start += count


# Encoding


class Encoder:
    """Whole texts to packed ids with the tokenizers library.

    A byte-level vocabulary encodes each pre-token by itself. Texts are split with the same pattern, and
    the library's model is given each distinct pre-token once, as the symbols of its bytes; a worker keeps the ids
    of those it has met in a bounded table. Texts with special tokens, or with characters beyond U+024F, go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}  # the table before it was full: what recurs moves over

    def _pieces(self, text: str) -> list[str] | None:
        """The pre-tokens, or None if the text is for the library as it is."""
        return None if any(s in text for s in self._special) or WIDE.search(text) else PRE_TOKEN.findall(text)

    def _learn(self, texts: list[list[str] | None]) -> None:
        needed = set(chain.from_iterable(filter(None, texts)))
        new = list(filterfalse(self._known.__contains__, needed))  # set operations with a dict's keys would go through all of it
        if len(self._known) + len(new) > KNOWN:
            self._before, self._known, new = self._known, {}, needed
        for x in new:
            ids = self._before.get(x)
            if ids is None:
                tokens = self._model.tokenize(x.encode().decode("latin-1").translate(BYTE_SYMBOLS))
                ids = packed([t.id for t in tokens])
            self._known[x] = ids

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        self._learn(split)
        return [packed(self._tokenizer.encode(t, add_special_tokens=False).ids) if s is None else b"".join(map(self._known.__getitem__, s)) for s, t in zip(split, texts)]


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


# The operator


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pa.fs.FileSystem.from_uri("s3://" + path.removeprefix("s3a://") if path.startswith("s3a://") else path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, planes: str = "byte", block_ids: int = BLOCK_IDS, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all rows to shard files under `path` (a URI that the cluster shares) and return the manifest.

    The manifest has a row for each shard: shard, file, n_docs, n_ids. Rows are in ascending order of their
    integer ids, a null id first (written as the smallest long), rows with one id by text. A null text
    counts as empty; `end_id` closes each document. An empty table gives no shards.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(vocabulary).read_text())
    end = b"" if end_id is None else packed([end_id])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, stream = None, None
        shard = TaskContext.get().partitionId()
        fs, root = file_system(path)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tids"
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(start, TEXTS_AT_ONCE)
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/{name}")
                    writer = ShardWriter(stream, planes, block_ids)
                for doc, ids in zip(part.column(0).to_pylist(), encoder(spec.value).encode(part.column(1).to_pylist())):
                    writer.add(doc, ids + end)
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    dealt = rows.repartitionByRange(shards or partitions(spark), "_id").sortWithinPartitions("_id", "_text")
    return cut(dealt.mapInArrow(write, "shard int, file string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (packed, end id included) of every document in the shards."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("_base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, starts, ids, size = [], [], [], 0
                with fs.open_input_file(f"{root}/{file}") as source:
                    for doc, start, data in ShardReader(source):
                        docs.append(None if doc == -(2**63) else doc)
                        starts.append(base + start)
                        ids.append(data)
                        size += len(data)
                        if size > BYTES_AT_ONCE:
                            yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": starts, "ids": ids})
                            docs, starts, ids, size = [], [], [], 0
                if docs:
                    yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "start": starts, "ids": ids})

    spread = placed.select("file", "_base").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(read, "doc_id long, start long, ids binary")
