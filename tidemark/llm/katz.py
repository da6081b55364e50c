"""Language-model scoring with Katz backoff.

The probability of a word after a history is its Good-Turing discounted share of the history's count where the n-gram
was seen, and else the history's backoff weight times the probability after the history without its first word:

    p(w | h) = (n(hw) - a(n(hw))) / n(h)      if n(hw) > 0
             = weight(h) p(w | h')            otherwise, with weight(h) = 1 where h was never seen

a(r), the part taken off a count of r, is Katz's, from the counts of counts n_1 .. n_6 of all n-grams of that length: counts up to a
cutoff are discounted. The weight is exactly what makes the probabilities after h sum to one,

    weight(h) = (1 - sum of p(w | h) over the w seen after h) / (1 - sum of p(w | h') over the same w).

The words are those of the training texts and one unknown word, which gets what the discounts of the single words leave.

Every length is one round over the corpus (see `batches`): a batch asks once for each n-gram it has, by the ids of
history and word, and says how often it has it in training texts and what the shorter history gives. The bucket adds up all batches,
stores its part of the n-gram table, and answers with the counts and the sums that the history's weight needs. A history
with more training tokens than a bucket should hold is dealt over many buckets, and their sums are added up.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.batches import answered, buckets_for, in_batches, pack, pack_places, scattered, unpack, unpack_places
from tidemark.llm.common import bucketed, cut

ORDER = 2
#: Counts up to this are discounted.
CUTOFF = 5
#: Bytes of text of a batch: its n-grams are sorted in the memory of one worker.
BATCH_BYTES = 12 << 20
#: The training tokens of a history that stay in one bucket, and how many histories may be dealt over more at most.
WHOLE_HISTORY = 1 << 20
SPLIT_HISTORIES = 1 << 17
#: The history of a text's first word.
START = -1

STORED = "batch long, id {id}, learns boolean, n_tokens long, tokens binary, bucket int, words binary, counts binary, slots binary"
ANSWERS = "kind string, level int, batch long, bucket int, a binary, b binary, c binary, d binary"
_ANSWERS = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in "abcd")])
ASKED = "bucket int, batch long, histories binary, sizes binary, dealt binary, words binary, counts binary, values binary, places binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *((x, pa.binary()) for x in ("histories", "sizes", "dealt", "words", "counts", "values", "places"))])


class Stats(NamedTuple):
    """What is known of the n-grams of one length over all training texts."""

    counts_of_counts: tuple[int, ...]
    types: int
    tokens: int

    @property
    def taken(self) -> np.ndarray:
        return discounts(self.counts_of_counts)


class Katz(NamedTuple):
    """The scores of all rows, and the stored answers of the rounds with the n-gram tables."""

    scores: DataFrame
    rounds: list[DataFrame]
    stats: list[Stats]


def discounts(counts_of_counts: Iterable[int]) -> np.ndarray:
    """a(r) for r = 1 .. CUTOFF, and for all larger r.

    Katz's discounts with the largest cutoff, CUTOFF or below, for which they all lie between 0 and 1. Where no
    cutoff gives such (repeated texts spoil the counts of counts), every count loses n_1 / (n_1 + 2 n_2), which is the
    Good-Turing estimate from the first two; without single n-grams nothing is taken.
    """
    n = [0, *counts_of_counts]
    for cutoff in range(CUTOFF, 1, -1):
        if not all(n[1 : cutoff + 1]) or (common := (cutoff + 1) * n[cutoff + 1] / n[1]) >= 1:
            continue
        kept = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, cutoff + 1)]
        if all(0 < d < 1 for d in kept):
            return np.array([r * (1 - d) for r, d in enumerate(kept, 1)] + [0.0] * (CUTOFF + 1 - cutoff))
    return np.full(CUTOFF + 1, n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0)


def seen_share(n: np.ndarray, total: np.ndarray, left: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """p(w | h) of seen n-grams. `left`: what the discounts of the history's n-grams leave; where it is nothing, a count of one is set aside."""
    return (n - taken[np.minimum(n, CUTOFF + 1) - 1]) / (total + (left <= 0))


def backoff_weight(total: np.ndarray, left: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.where(left > 0, left, 1.0) / (total + (left <= 0)) / np.maximum(1 - lower, 1e-300)


# A batch


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        return slot


def _read(buckets: int, limit: int, id_type: pa.DataType):
    """Documents as slots of the batch's words, and the words of the batch by bucket. Slot 0 is the end of a text, which no word equals."""
    docs = pa.schema([("batch", pa.int64()), ("id", id_type), ("learns", pa.bool_()), ("n_tokens", pa.int64()), ("tokens", pa.binary()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("words", "counts", "slots"))])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in in_batches(rows, limit):
            slots, learnt, out = _Slots({b"\n": 0}), [np.zeros(0, np.int32)], []
            for doc, learns, text in batch:
                found = list(map(slots.__getitem__, text.encode().lower().split()))
                tokens = np.array([*found, 0], np.int64)
                if learns:
                    learnt.append(tokens.astype(np.int32))
                out.append({"batch": number, "id": doc, "learns": bool(learns), "n_tokens": len(tokens), "tokens": pack_places(tokens)})
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, docs)
                    out = []
            counts, names = np.bincount(np.concatenate(learnt), minlength=len(slots)), sorted(slots)
            at = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in names), np.int64, len(names))
            order = np.argsort(at, kind="stable")
            place = np.fromiter(map(slots.__getitem__, names), np.int64, len(names))
            for chosen in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                words = zstandard.compress(b" ".join(names[i] for i in chosen.tolist()), 1)
                out.append({"batch": number, "bucket": int(at[chosen[0]]), "words": words, "counts": pack(counts[place[chosen]]), "slots": pack(place[chosen])})
            yield pa.RecordBatch.from_pylist(out, docs)

    return run


class _Batch:
    """The tokens of a batch's documents with what the answers so far say of them."""

    def __init__(self, docs: pa.Table, answers: pa.Table, stats: list[Stats], split: list[dict]):
        self.ids, self.learns = docs["id"], np.array(docs["learns"].to_pylist(), bool)
        self.lengths = np.array(docs["n_tokens"].to_pylist(), np.int64)
        self.tokens = np.concatenate([unpack_places(t) for t in docs["tokens"].to_pylist()])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)  # the place in the text
        self._answers = defaultdict(list)
        for row in answers.to_pylist():
            self._answers[row["level"]].append(row)
        self.stats = stats
        self._words()
        for level in range(2, len(stats) + 1):
            self._climb(level, split[level - 2])

    def _words(self) -> None:
        rows, n = self._answers[1], int(self.tokens.max()) + 1
        self.word, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in rows:
            slots = unpack(r["a"])
            self.word[slots], self.count[slots] = unpack(r["b"]), unpack(r["c"])
        stats = self.stats[0]
        taken = stats.taken
        left = float(np.dot(taken, [*stats.counts_of_counts[:CUTOFF], stats.types - sum(stats.counts_of_counts[:CUTOFF])]))
        unknown = (left or 1.0) / (stats.tokens + (left <= 0))
        self.p = np.where(self.count > 0, seen_share(np.maximum(self.count, 1), np.float64(stats.tokens), np.float64(left), taken), unknown)[self.tokens]
        self.gram, self.gram_ids, self.gram_counts = self.tokens, self.word, self.count

    def asks(self, level: int, buckets: int, whole: int) -> None:
        """The n-grams of this length: their places in the text, and each of them once, by bucket."""
        self.where = np.flatnonzero(self.at >= level - 2)
        before = self.where - 1
        first = self.at[self.where] == 0  # at the second level a text's first word follows the start
        history = np.where(first, len(self.gram_ids), self.gram[before])
        ids = np.append(self.gram_ids, START)
        counts = np.append(self.gram_counts, self.count[0])  # a training text has one start and one end
        n = len(self.word)
        keys, place, inverse = np.unique(history * n + self.tokens[self.where], return_index=True, return_inverse=True)
        self.histories, self.words = ids[keys // n], self.word[keys % n]
        self.lower, self.inverse, self.places = self.p[self.where[place]], inverse, place
        learnt = np.repeat(self.learns, self.lengths)[self.where]
        self.n_learnt = np.bincount(inverse, learnt, len(keys)).astype(np.int64)
        shares = -(-counts[keys // n] // whole)  # of a long history the words are dealt as well
        self.dealt = shares > 1
        share = scattered(self.words) % np.maximum(shares, 1).astype(np.uint64)
        self.bucket = (scattered(scattered(self.histories) + share) % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self.edges = np.flatnonzero(np.diff(self.bucket[self.order])) + 1

    def _climb(self, level: int, answer: dict) -> None:
        self.asks(level, answer["buckets"], answer["whole"])
        taken = self.stats[level - 1].taken
        parts = np.split(self.order, self.edges) if len(self.order) else []
        n, total, left, lower, ids = (np.zeros(len(self.order), t) for t in (np.int64, np.int64, np.float64, np.float64, np.int64))
        rows = {r["bucket"]: r for r in self._answers[level]}
        for part in parts:
            row = rows[int(self.bucket[part[0]])]
            n[part] = unpack(row["a"])
            sums = unpack(row["b"]).reshape(CUTOFF + 2, -1)
            group = np.cumsum(np.append(True, self.histories[part][1:] != self.histories[part][:-1])) - 1
            total[part], left[part], lower[part] = sums[0][group], (taken @ sums[1:])[group], unpack(row["c"], np.float64)[group]
            if row["d"]:
                ids[part] = unpack(row["d"])
        if len(answer["histories"]):
            at = np.minimum(np.searchsorted(answer["histories"], self.histories), len(answer["histories"]) - 1)
            mine = answer["histories"][at] == self.histories
            sums = answer["sums"][:, at[mine]]
            total[mine], left[mine], lower[mine] = sums[0], taken @ sums[1:], answer["lower"][at[mine]]
        p = np.where(n > 0, seen_share(np.maximum(n, 1), total, left, taken), np.where(total > 0, backoff_weight(np.maximum(total, 1), left, lower), 1.0) * self.lower)
        self.p = self.p.copy()
        self.p[self.where] = p[self.inverse]
        gram = np.full(len(self.tokens), -1)
        gram[self.where] = self.inverse
        self.gram, self.gram_ids, self.gram_counts = gram, ids, n


def _asking(level: int, buckets: int, whole: int, stats: list[Stats], split: list[dict]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _Batch(docs, answers, stats, split)
        batch.asks(level, buckets, whole)
        number, out = docs["batch"][0].as_py(), []
        for part in np.split(batch.order, batch.edges) if len(batch.order) else []:
            histories = batch.histories[part]
            first = np.flatnonzero(np.append(True, histories[1:] != histories[:-1]))
            values, places = np.unique(batch.lower[part], return_inverse=True)
            sizes = np.diff(np.append(first, len(part)))
            out.append({"bucket": int(batch.bucket[part[0]]), "batch": number} | {k: pack(v) for k, v in (("histories", histories[first]), ("sizes", sizes), ("dealt", batch.dealt[part][first]), ("words", batch.words[part]), ("counts", batch.n_learnt[part]), ("values", values), ("places", places))})
        return pa.Table.from_pylist(out, _ASKED)

    return run


# A bucket


def _row(kind: str, level: int, bucket: int, batch: int | None = None, **arrays: np.ndarray | None) -> dict:
    return {"kind": kind, "level": level, "batch": batch, "bucket": bucket} | {k: None if v is None else pack(v) for k, v in arrays.items()}


def _counted(level: int, bucket: int, n: np.ndarray) -> dict:
    seen = n[n > 0]
    return _row("stats", level, bucket, a=np.array([*np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2], len(seen), seen.sum()]))


def _of_words(buckets: int):
    """Answers of the first round: the slots of a batch's words in this bucket, their ids and training counts."""

    def answer(bucket: int, rows: list[dict]) -> Iterator[dict]:
        known, lists = _Slots(), []
        for r in rows:
            words = zstandard.decompress(r["words"])
            lists.append(np.fromiter(map(known.__getitem__, words.split(b" ")), np.int64))
        n = np.bincount(np.concatenate(lists), np.concatenate([unpack(r["counts"]) for r in rows]), len(known)).astype(np.int64)
        for r, places in zip(rows, lists):
            yield _row("answer", 1, bucket, r["batch"], b=places * buckets + bucket, c=n[places]) | {"a": r["slots"]}
        seen = np.flatnonzero(n)
        names = list(known)
        yield _row("table", 1, bucket, b=seen * buckets + bucket, c=n[seen]) | {"a": zstandard.compress(b" ".join(names[i] for i in seen.tolist()))}
        yield _counted(1, bucket, n)

    return answer


def _of_grams(level: int, buckets: int, names: bool):
    """Answers of a further round: the training counts of a batch's n-grams in this bucket, and for each of their histories its count, how
    many of its n-grams occur once, twice, ... and more often than CUTOFF, and the sum of what the shorter history gives them."""

    def answer(bucket: int, rows: list[dict]) -> Iterator[dict]:
        sizes, asked = [unpack(r["sizes"]) for r in rows], [unpack(r["histories"]) for r in rows]
        history = np.concatenate([np.repeat(h, s) for h, s in zip(asked, sizes)])
        word = np.concatenate([unpack(r["words"]) for r in rows])
        learnt = np.concatenate([unpack(r["counts"]) for r in rows])
        lower = np.concatenate([unpack(r["values"], np.float64)[unpack(r["places"])] for r in rows])
        order = np.lexsort((word, history))
        first = np.flatnonzero(np.append(True, (np.diff(history[order]) != 0) | (np.diff(word[order]) != 0)))
        gram = np.empty(len(order), np.int64)
        gram[order] = np.cumsum(np.isin(np.arange(len(order)), first, assume_unique=True)) - 1
        n = np.add.reduceat(learnt[order], first)
        of, low = history[order][first], np.where(n > 0, lower[order][first], 0.0)
        start = np.flatnonzero(np.append(True, np.diff(of) != 0))
        place = np.cumsum(np.append(True, np.diff(of) != 0)) - 1
        sums = np.array([np.add.reduceat(n, start), *(np.add.reduceat((n == r).astype(np.int64), start) for r in range(1, CUTOFF + 1)), np.add.reduceat((n > CUTOFF).astype(np.int64), start)])
        below = np.add.reduceat(low, start)
        ends = np.cumsum([len(unpack(r["words"])) for r in rows])
        for r, end, size in zip(rows, ends, sizes):
            mine = gram[end - int(size.sum()) : end]
            groups = place[mine[np.cumsum(size) - size]]
            yield _row("answer", level, bucket, r["batch"], a=n[mine], b=sums[:, groups].ravel(), c=below[groups], d=mine * buckets + bucket if names else None)
        seen = np.flatnonzero(n)
        yield _row("table", level, bucket, a=of[seen], b=word[order][first][seen], c=n[seen], d=seen * buckets + bucket)
        yield _counted(level, bucket, n)
        dealt = np.unique(np.concatenate([h[unpack(r["dealt"]) > 0] for r, h in zip(rows, asked)]))
        if len(dealt):
            mine = np.searchsorted(of[start], dealt)
            yield _row("shares", level, bucket, a=dealt, b=sums[:, mine].ravel(), c=below[mine])

    return answer


# The driver


def _stats(found: DataFrame) -> Stats:
    """The counts of counts of all buckets, a row of eight numbers each."""
    total = sum((unpack(r.a) for r in found.where("kind = 'stats'").select("a").toLocalIterator()), np.zeros(CUTOFF + 3, np.int64))
    return Stats(tuple(map(int, total[: CUTOFF + 1])), int(total[-2]), int(total[-1]))


def _dealt(found: DataFrame) -> dict:
    """The sums of the histories that are dealt over buckets: as many shares as `SPLIT_HISTORIES` allows, and one more for each such history."""
    sums, lower = defaultdict(lambda: np.zeros(CUTOFF + 2, np.int64)), defaultdict(list)
    for r in found.where("kind = 'shares'").select("a", "b", "c").toLocalIterator():
        for history, some, low in zip(unpack(r.a).tolist(), unpack(r.b).reshape(CUTOFF + 2, -1).T, unpack(r.c, np.float64).tolist()):
            sums[history] += some
            lower[history].append(low)
    order = sorted(sums)
    return {"histories": np.array(order, np.int64), "sums": np.array([sums[h] for h in order], np.int64).reshape(-1, CUTOFF + 2).T, "lower": np.array([math.fsum(lower[h]) for h in order])}


def katz(docs: DataFrame, learns: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, whole_history: int = WHOLE_HISTORY) -> Katz:
    """Scores of all rows by an n-gram model of this order that is learnt from the rows where `learns` is true.

    `scores` has the row's id, n_tokens, n_known (tokens that training texts have), base_score (add-one single words) and
    score, both log10 of the text's probability. Words are whole-text, A-Z lower-cased; an end follows the last one and counts as a token. A
    null text counts as empty: it is an end alone. Null and repeated ids pass through, each row by itself, and count
    each time; a null in `learns` counts as false. Other columns are not read; an empty table gives no rows. Without training rows
    every word is unknown and has the probability 1.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learns, F.lit(False)).alias("learns"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    buckets = buckets_for(rows, "text")
    stored = bucketed(rows.mapInArrow(_read(buckets, batch_bytes, to_arrow_type(kind)), STORED.format(id=kind.simpleString())), "batch", "texts")
    texts = stored.where("bucket IS NULL").select("batch", "id", "learns", "n_tokens", "tokens")
    rounds = [cut(answered(stored.where("bucket IS NOT NULL").select("bucket", "batch", "words", "counts", "slots"), _of_words(buckets), _ANSWERS, ANSWERS), "words")]
    stats, dealt = [_stats(rounds[0])], []
    whole = max(whole_history, -(-stats[0].tokens // SPLIT_HISTORIES))

    def with_answers(work, ddl: str) -> DataFrame:
        answers = reduce(DataFrame.unionByName, rounds).where("kind = 'answer'").select("batch", "level", "bucket", "a", "b", "c", "d")
        return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(work, ddl)

    for level in range(2, order + 1):
        asked = with_answers(_asking(level, buckets, whole, list(stats), list(dealt)), ASKED)
        rounds.append(cut(answered(asked, _of_grams(level, buckets, level < order), _ANSWERS, ANSWERS), "grams"))
        stats.append(_stats(rounds[-1]))
        dealt.append({"buckets": buckets, "whole": whole} | _dealt(rounds[-1]))

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        batch, n = _Batch(docs, answers, stats, dealt), stats[0]
        known = batch.count[batch.tokens]
        base = np.log10((known + 1) / (n.tokens + n.types + 1))
        sums = [np.add.reduceat(x, batch.starts) for x in (known > 0, base, np.log10(batch.p))]
        return pa.table({"id": batch.ids, "n_tokens": batch.lengths, "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]})

    out = with_answers(score, f"id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return Katz(out.withColumnRenamed("id", id_col), rounds, stats)


def ngrams(model: Katz, level: int) -> DataFrame:
    """The stored table of the n-grams of one length: gram, n, and history and word by their ids (of a single word: the word itself)."""
    table = model.rounds[level - 1].where("kind = 'table'").select("a", "b", "c", "d")

    def of_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            if len(ids := unpack(r["b"])):
                yield pa.record_batch({"gram": ids, "word": zstandard.decompress(r["a"]).decode().split(" "), "n": unpack(r["c"])})

    def of_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            yield pa.record_batch({"gram": unpack(r["d"]), "history": unpack(r["a"]), "word": unpack(r["b"]), "n": unpack(r["c"])})

    return table.mapInArrow(of_words, "gram long, word string, n long") if level == 1 else table.mapInArrow(of_grams, "gram long, history long, word long, n long")
