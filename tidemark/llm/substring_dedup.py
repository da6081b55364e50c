"""Substring dedup over word windows with difference-cover anchors.

A difference cover D of a period v holds, for any two places i and j, an offset k below v at which
i + k and j + k both fall on D modulo v. So two documents that share a window of W words also share
a shorter run of W - v + 1 words, an anchor, that starts at a cover place in both. Only runs at cover
places are hashed; documents that share none are done with. An anchor that another document has too
is extended: the windows of W words that contain it are compared by two independent hashes of 64 bits, and
the smallest document that has a window keeps it. (Of n windows two different ones agree in both with a
chance of n squared over 2 to the 129.)

Rows meet by hash and are read in sorted order, one pass with constant memory. Of the documents of a
batch that share a hash one alone goes to the meeting; the batch shows what the others need to know. So a
passage that a large share of all documents has does not bring them all to one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FIRST, FURTHER, STRIDE, map_arrow, meeting, partitions

WINDOW = 50
#: Perfect difference sets by period, every difference modulo the period once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
SEEDS = (1, 2)


def period_for(window: int) -> int:
    """The longest period that leaves anchors of a third of the window or more."""
    return max(v for v in COVERS if v == 1 or 3 * (window - v + 1) >= window)


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the pair (a, b)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b << np.uint64(29) | b >> np.uint64(35))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words: runs of 1, 2, 4 ... are joined in pairs, the last two may overlap."""
    size = 1
    while 2 * size <= length:
        hashes, size = _mixed(hashes[:-size], hashes[size:]), 2 * size
    return hashes if size == length else _mixed(hashes[: len(hashes) - (length - size)], hashes[length - size :])


def _cover_places(n: int, period: int) -> np.ndarray:
    return np.flatnonzero(np.isin(np.arange(period), COVERS[period])[np.arange(n) % period])


def anchors(text: str | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that start on the cover, each once, and the first place of each."""
    words = (text or "").encode().split()
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    period = period_for(window)
    runs = run_hashes(word_hashes(words, SEEDS[0]), window - period + 1)
    places = _cover_places(len(runs), period)
    found, first = np.unique(runs[places], return_index=True)
    return found.view(np.int64), places[first].astype(np.int32)


def windows(text: str, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that contain an anchor as at one of the places, each once: two hashes and the first start."""
    words = text.encode().split()
    last, period = len(words) - window, period_for(window)
    hashes = word_hashes(words, SEEDS[0])
    runs = run_hashes(hashes, window - period + 1)
    cover = _cover_places(len(runs), period)
    places = cover[np.isin(runs[cover], runs[places])]
    edge = np.zeros(last + 2, np.int64)
    np.add.at(edge, np.maximum(places - period + 1, 0), 1)
    np.add.at(edge, np.minimum(places, last) + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    one, two = (run_hashes(word_hashes(words, seed), window)[starts] if seed != SEEDS[0] else run_hashes(hashes, window)[starts] for seed in SEEDS)
    order = np.lexsort((starts, two, one))
    first = order[np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])]
    return one[first].view(np.int64), two[first].view(np.int64), starts[first]


def _dealt(doc: np.ndarray, place: np.ndarray, *hashes: np.ndarray) -> dict:
    """The rows of a batch, each of a document and hash once: _key to deal by, _doc, _place (place and state in one), further hashes."""
    keep = np.lexsort((doc, *hashes[::-1]))
    same = np.ones(max(0, len(keep) - 1), bool)
    for x in (doc, *hashes):
        same &= x[keep][1:] == x[keep][:-1]
    keep = keep[np.concatenate([[True], ~same])[: len(keep)]]
    hashes = [h[keep] for h in hashes]
    key, state = meeting(hashes, doc[keep], np.arange(len(keep)) * STRIDE)
    return {"_key": key, "_doc": doc[keep], "_place": place[keep].astype(np.int64) << 2 | state} | ({"_check": hashes[1]} if len(hashes) > 1 else {})


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Out of (_key, _doc, _place) sorted by key and document: _doc and _pos of the hashes that two documents have.

    Held between batches are the rows of one document with one hash at most.
    """
    known = None
    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        h, doc, place = (batch.column(i).to_numpy() for i in range(3))
        further = (place & 3) == FURTHER
        if further.any():
            yield pa.record_batch({"_doc": doc[further], "_pos": (place[further] >> 2).astype(np.int32)})
        h, doc, place = (np.concatenate([x, y[~further]]) for x, y in zip(held, (h, doc, place)))
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        end = np.append(first[1:], len(h))
        shared = (doc[end - 1] != doc[first]) | np.logical_or.reduceat((place & 3) == FIRST, first)
        shared[0] |= h[0] == known
        open_ = not shared[-1]
        known = None if open_ else h[-1]
        held = [x[first[-1] :] if open_ else x[:0] for x in (h, doc, place)]
        rows = np.repeat(shared, end - first)
        if rows.any():
            yield pa.record_batch({"_doc": doc[rows], "_pos": (place[rows] >> 2).astype(np.int32)})


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Out of (_key, _doc, _place, _check) sorted by window and document: _doc and _pos of the windows that a smaller document has."""
    last = None
    for batch in batches:
        h, doc, place, check = (batch.column(i).to_numpy() for i in range(4))
        further = (place & 3) == FURTHER
        if further.any():
            yield pa.record_batch({"_doc": doc[further], "_pos": (place[further] >> 2).astype(np.int32)})
        h, doc, place, check = (x[~further] for x in (h, doc, place, check))
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])]))
        least = doc[first]
        if last is not None and last[:2] == (h[0], check[0]):
            least[0] = last[2]
        last = (h[-1], check[-1], least[-1])
        rows = doc > np.repeat(least, np.diff(np.append(first, len(h))))
        if rows.any():
            yield pa.record_batch({"_doc": doc[rows], "_pos": (place[rows] >> 2).astype(np.int32)})


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    A word goes if a window of `window` consecutive words that covers it also starts in a document
    with a smaller id. Windows are judged on the input. Ids are integers. A null text has no words; a
    null id neither loses words nor makes others lose them; rows that repeat an id are one document
    and must repeat its text. Other columns are not read; an empty table gives no rows.
    """
    n = partitions(docs.sparkSession)
    no_id = F.lit(-(2**63))  # in place of a null, so that both joins read the very same exchange of the texts
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("_doc"), F.col(text_col).alias("_text"))

    def of_anchors(batch: pa.RecordBatch) -> dict | None:
        found = [anchors(t, window) for t in batch.column(1).to_pylist()]
        counts = [len(h) for h, _ in found]
        if not sum(counts):
            return None
        return _dealt(np.repeat(batch.column(0).to_numpy(), counts), np.concatenate([p for _, p in found]), np.concatenate([h for h, _ in found]))

    def of_windows(batch: pa.RecordBatch) -> dict | None:
        found = [windows(t, np.array(p), window) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        one, two, starts = (np.concatenate(x) for x in zip(*found))
        return _dealt(np.repeat(batch.column(0).to_numpy(), [len(h) for h, *_ in found]), starts, one, two)

    def kept(batch: pa.RecordBatch) -> dict:
        total, gone, texts = [], [], []
        for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            if starts:
                runs = run_hashes(word_hashes(words, SEEDS[0]), window)
                every = np.flatnonzero(np.isin(runs, runs[starts]))
                edge[every] += 1
                edge[every + window] -= 1
            stays = np.cumsum(edge[:-1]) == 0
            total.append(len(words))
            gone.append(len(words) - int(stays.sum()))
            texts.append(b" ".join(words if not gone[-1] else [words[i] for i in np.flatnonzero(stays)]).decode())
        return {"_doc": batch.column(0), "n_words": total, "n_removed": gone, "kept": texts}

    placed = map_arrow(rows.where(F.col("_doc") != no_id), of_anchors, "_key long, _doc long, _place long")
    shared = placed.repartition(n, "_key").sortWithinPartitions("_key", "_doc").mapInArrow(_shared, "_doc long, _pos int")
    by_doc = shared.groupBy("_doc").agg(F.collect_set("_pos").alias("_places"))
    dealt = rows.repartition(n, "_doc")
    wide = map_arrow(dealt.join(by_doc, "_doc").select("_doc", "_text", "_places"), of_windows, "_key long, _doc long, _place long, _check long")
    again = wide.repartition(n, "_key").sortWithinPartitions("_key", "_check", "_doc").mapInArrow(_repeated, "_doc long, _pos int")
    starts = again.groupBy("_doc").agg(F.collect_set("_pos").alias("_starts"))
    done = map_arrow(dealt.join(starts, "_doc", "left").select("_doc", "_text", "_starts"), kept, "_doc long, n_words long, n_removed long, kept string")
    return done.select(F.when(F.col("_doc") != no_id, F.col("_doc")).alias(id_col), "n_words", "n_removed", "kept")
