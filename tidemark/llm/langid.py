"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree: how often a byte followed each context of up to
`order` bytes. A byte seen in a context costs its share there; an unseen one costs an escape, whose
share is the number of distinct bytes seen in the context, and is then predicted from the next
shorter context among the bytes that were not seen (exclusion). Each context's chances sum to one, so
a text has an exact code length in every language; the shortest wins. Statistics are frozen after
fitting.

A-Z are lower-cased, and a run of other ASCII bytes that are no letters is one space; all other
bytes stand for themselves. A tree holds the contexts that were met and no others: sorted codes of
(context, byte) with their bits, for each order. Texts are looked up many at a time, each distinct code once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROWS_AT_ONCE, cut, map_arrow

UNKNOWN = "und"
#: Bound of the labelled sample that statistics are taken from; one row in CALIBRATE of it sets the temperature instead.
DOCS_PER_LANGUAGE = 2000
CALIBRATE = 5
ORDER = 3
#: Bits looked up at once, over all languages.
LOOKUPS = 1 << 20
SPACE = 32
#: 26 letters, the space and the bytes from 128 on.
ALPHABET = 26 + 1 + 128
SYMBOL = np.full(256, SPACE, np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(97, 123)
SYMBOL[128:] = np.arange(128, 256)
#: Bytes that a text's evidence counts for at most; the one under which the calibrating rows are likeliest is taken.
EVIDENCE = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
USUAL_EVIDENCE = 8
#: A language with fewer rows than this spares none for the calibration.
SPARES = 50


def symbol_codes(text: str, order: int = ORDER) -> np.ndarray:
    """For each byte of the text the number of (its context of `order` bytes, it), the latest byte lowest."""
    symbols = SYMBOL[np.frombuffer(text.encode(), np.uint8)]
    if not len(symbols):
        return np.empty(0, np.uint32)
    symbols = symbols[np.concatenate([[True], (symbols[1:] != SPACE) | (symbols[:-1] != SPACE)])]
    padded = np.concatenate([np.full(order, SPACE, np.uint8), symbols]).astype(np.uint32)
    codes = np.zeros(len(symbols), np.uint32)
    for i in range(order + 1):
        codes = codes << np.uint32(8) | padded[i : i + len(symbols)]
    return codes


def _low(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The codes of the last `symbols` bytes alone."""
    return codes & np.uint32((1 << 8 * symbols) - 1)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted number in sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """The frozen contexts of one language: for each order the codes met, their bits, the contexts met and the bits of leaving them."""

    def __init__(self, codes: np.ndarray, times: np.ndarray, order: int):
        counts = [(codes, times)]
        for k in range(order, 0, -1):
            shorter, which = np.unique(_low(counts[0][0], k), return_inverse=True)
            counts.insert(0, (shorter, np.bincount(which, counts[0][1])))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (found, n) in enumerate(counts):
            contexts, which = np.unique(found >> np.uint32(8), return_inverse=True)
            if k:
                keys, bits, *_ = self.levels[-1]
                below = np.exp2(-bits[np.searchsorted(keys, _low(found, k))])
            else:
                below = np.full(len(found), 1 / ALPHABET)
            times_, kinds, rest = np.bincount(which, n), np.bincount(which), 1 - np.bincount(which, below)
            escape = np.where(kinds < ALPHABET, kinds, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = -np.log2(escape / (times_ + escape) / rest)
            self.levels.append((found, np.log2((times_ + escape)[which] / n), contexts, leave))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each byte in its context."""
        total, left = np.zeros(len(codes)), np.arange(len(codes))
        for k in range(len(self.levels) - 1, -1, -1):
            keys, bits, contexts, leave = self.levels[k]
            wanted = _low(codes[left], k + 1)
            at, seen = _found(keys, wanted)
            total[left[seen]] += bits[at[seen]]
            left, wanted = left[~seen], wanted[~seen]
            if not len(left):
                return total
            at, seen = _found(contexts, wanted >> np.uint32(8))
            total[left[seen]] += leave[at[seen]]
        total[left] += np.log2(ALPHABET)
        return total


class Model:
    """The trees of the languages, and how many bytes of evidence a score takes from a text at most."""

    def __init__(self, languages: list[str], trees: list[Tree], order: int, evidence: int = USUAL_EVIDENCE):
        self.languages, self.trees, self.order, self.evidence = languages, trees, order, evidence

    def code_lengths(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each text takes in each language, and the bytes of each text."""
        sizes, bits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.trees)))
        most = max(1, LOOKUPS // max(1, len(self.trees)))
        held, owners, size = [], [], 0

        def flush() -> None:
            codes, ends = np.concatenate(held), np.cumsum(list(map(len, held)))
            distinct = np.unique(codes)
            table = np.stack([tree.bits(distinct) for tree in self.trees], axis=1)
            sums = np.add.reduceat(table[np.searchsorted(distinct, codes)], np.concatenate([[0], ends[:-1]]), axis=0)
            np.add.at(bits, owners, sums)

        for i, text in enumerate(texts):
            codes = symbol_codes(text, self.order)
            sizes[i] = len(codes)
            for start in range(0, len(codes), most):
                held.append(codes[start : start + most])
                owners.append(i)
                size += len(held[-1])
                if size >= most:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        return bits, sizes

    def shares(self, bits: np.ndarray, sizes: np.ndarray, evidence: int | None = None) -> np.ndarray:
        """The share of each language (columns) in each text, if all are as likely beforehand.

        Neighbouring bytes are no independent evidence, so a text counts for `evidence` bytes of its average at most.
        """
        weight = np.minimum(sizes, evidence or self.evidence) / np.maximum(sizes, 1)
        worse = (bits - bits.min(axis=1, keepdims=True)) * weight[:, None]
        share = np.exp2(-worse)
        return share / share.sum(axis=1, keepdims=True)

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code of each text, and its share. Ties go to the first name."""
        bits, sizes = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        return [self.languages[i] for i in best], self.shares(bits, sizes)[np.arange(len(texts)), best]


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Statistics of a sample of about `docs_per_language` whole texts for each language (all, where there are fewer).

    The sample is drawn by a hash of the id. One row in CALIBRATE of a language that can spare it is kept
    from the counts: the evidence under which these rows are likeliest is that of the scores. Rows with a
    null text or language, or without an id, teach nothing; None if there are no others. What comes to the driver is a
    count for each context met in the sample and a number for each evidence. `order` is 3 at most.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_id IS NOT NULL AND _text IS NOT NULL AND _lang IS NOT NULL")
    sizes = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not sizes:
        return None
    languages, steps = sorted(sizes), 1 << 30
    share = F.create_map(*(x for s in languages for x in (F.lit(s), F.lit(min(steps, steps * docs_per_language // sizes[s])))))
    place = F.create_map(*(x for i, s in enumerate(languages) for x in (F.lit(s), F.lit(i))))
    spared = (F.pmod(F.xxhash64(F.lit(CALIBRATE), "_id"), F.lit(CALIBRATE)) == 0) & F.col("_lang").isin([s for s in languages if sizes[s] >= SPARES])
    drawn = rows.where(F.pmod(F.xxhash64("_id"), F.lit(steps)) < share[F.col("_lang")])
    # The sample is small by its bound: it is brought together into few files, however many tasks read the table.
    sample = cut(drawn.select(place[F.col("_lang")].alias("_lang"), "_text", spared.alias("_spared")).hint("rebalance"), "sample")

    def of_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            codes = np.concatenate([symbol_codes(t, order).astype(np.int64) + (i << 32) for i, t in zip(lang, texts)])
            code, times = np.unique(codes, return_counts=True)
            yield pa.record_batch({"_code": code, "_times": times.astype(np.int64)})

    counted = sample.where("NOT _spared").select("_lang", "_text").mapInArrow(of_contexts, "_code long, _times long").groupBy("_code").agg(F.sum("_times").alias("_times")).toPandas().sort_values("_code")
    lang, code, times = counted["_code"].to_numpy() >> 32, counted["_code"].to_numpy().astype(np.uint32), counted["_times"].to_numpy()
    model = Model(languages, [Tree(code[lang == i], times[lang == i], order) for i in range(len(languages))], order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def likeliness(batch: pa.RecordBatch) -> dict:
        own, truth = shared.value, batch.column(0).to_numpy()
        bits, lengths = own.code_lengths(batch.column(1).to_pylist())
        logs = [np.log2(np.maximum(own.shares(bits, lengths, e)[np.arange(len(truth)), truth], 1e-12)).sum() for e in EVIDENCE]
        return {"_evidence": EVIDENCE, "_log": logs}

    logs = map_arrow(sample.where("_spared").select("_lang", "_text"), likeliness, "_evidence int, _log double").groupBy("_evidence").agg(F.sum("_log").alias("_log")).collect()
    if logs:
        model.evidence = min(logs, key=lambda r: (-round(r["_log"], 3), r["_evidence"]))["_evidence"]
    return model


def _told(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `und` and 0 for a null."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    there = [i for i, t in enumerate(texts) if t is not None]
    found, scores[there] = model.predict([texts[i] for i in there])
    for i, name in zip(there, found):
        names[i] = name
    return names, scores


def _lettered(text_col: str) -> Column:
    """The text, null where it has no letter."""
    return F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row, from its whole text alone.

    A null text, or one without a letter, is `und` with score 0, as is all if nothing was learned.
    Repeated rows and null ids pass through; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), _lettered(text_col).alias("_text"))
    if model is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batch: pa.RecordBatch) -> dict:
        names, scores = _told(shared.value, batch.column(1).to_pylist())
        return {"_id": batch.column(0), "lang_pred": names, "score": scores}

    kind = rows.schema["_id"].dataType.simpleString()
    return map_arrow(rows, predicted, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def accepted(docs: DataFrame, model: Model | None, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose language cannot be told: `und`, or a score under `min_score`. All columns stay as they are.

    Nothing stays if nothing was learned.
    """
    if model is None:
        return docs.limit(0)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                texts = [t if t is not None and regex.search(r"\p{L}", t) else None for t in part.column(place).to_pylist()]
                names, scores = _told(shared.value, texts)
                keep = [name != UNKNOWN and score >= min_score for name, score in zip(names, scores)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
