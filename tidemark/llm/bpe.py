"""Byte-pair encoding and decoding with forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no token of the vocabulary can never be
merged over, so the place between them is a certain cut. A text is cut there, each fragment is
encoded by itself, and the ids are put one after another. Fragments recur, so a worker keeps the
ids of those it has met in a bounded table.

The vocabulary is a tokenizer file in JSON with byte-level symbols and an end-of-word suffix, read
on the driver (its path is a parameter) and broadcast: its size is that of the file.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.llm.pretokens import WIDE, plain

#: Words and fragments kept by a worker, and characters taken from a text at once.
CACHE_ENTRIES = 120_000
PIECE_CHARS = 1 << 20
#: Fragments longer than this are merged with a heap, in n log n steps.
LONG_FRAGMENT = 48


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Table(dict):
    """A dict that computes what it lacks. When it is full it starts anew and takes over from the full one what recurs."""

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit, self._before = make, limit, {}

    def __missing__(self, key):
        value = self._before.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._limit:
            self._before = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder of one vocabulary file. What only one of the two needs is built when it is first used."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        self._model = parsed["model"]
        self.special = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self.tokens = {i: t for t, i in [*self._model["vocab"].items(), *self.special.items()]}
        self._words = plain(next(x["pattern"]["Regex"] for x in parsed["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self._special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._spec, self._library = spec, None
        self._fragments = _Table(self._merge, CACHE_ENTRIES)
        self._known = _Table(lambda word: self._encode_word(word.encode()), CACHE_ENTRIES)

    @cached_property
    def _symbol_ids(self) -> tuple[list[int], list[int]]:
        """The id of each byte inside a word and at its end."""
        vocab, suffix = self._model["vocab"], self._model.get("end_of_word_suffix") or ""
        return [vocab[s] for s in byte_symbols()], [vocab[s + suffix] for s in byte_symbols()]

    @cached_property
    def _merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """Rank and id of what two ids merge to."""
        vocab, out = self._model["vocab"], {}
        for rank, pair in enumerate(self._model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            out[vocab[a], vocab[b]] = (rank, vocab[a + b])
        return out

    @cached_property
    def inside(self) -> np.ndarray:
        return self._inside_pairs(self._model["vocab"], self._model.get("end_of_word_suffix") or "", byte_symbols())

    @cached_property
    def _inside_flags(self) -> bytes:
        return self.inside.tobytes()

    @staticmethod
    def _inside_pairs(vocab: dict[str, int], suffix: str, symbols: list[str]) -> np.ndarray:
        """inside[x, y]: y follows x within some token. The last byte of a word counts as another symbol (256 more)."""
        byte = {s: b for b, s in enumerate(symbols)}
        inside = np.zeros((512, 512), dtype=bool)
        for token in vocab:
            body = token.removesuffix(suffix) if suffix and token != suffix else token
            codes = [byte[c] for c in body]
            if codes and body != token:
                codes[-1] += 256
            for x, y in zip(codes, codes[1:]):
                inside[x, y] = True
        return inside

    def _split(self, text: str) -> list[bytes]:
        """The normalised words of a text with any characters, by the library's normaliser and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in w) for w, _ in words]

    def fragments(self, word: bytes) -> list[tuple[bytes, bool]]:
        """A word cut at the certain boundaries: (bytes, whether the word ends there)."""
        codes, inside = [*word[:-1], word[-1] + 256], self._inside_flags
        cuts = [i for i, (x, y) in enumerate(zip(codes, codes[1:]), 1) if not inside[x << 9 | y]]
        return [(word[a:b], b == len(word)) for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def _merge(self, fragment: tuple[bytes, bool]) -> bytes:
        """Ids of one fragment: the neighbours of lowest rank are merged, leftmost first, until none can be."""
        data, ends = fragment
        first, last = self._symbol_ids
        ids = [first[b] for b in data]
        if ends:
            ids[-1] = last[data[-1]]
        if len(ids) > LONG_FRAGMENT:
            return self._merge_long(ids)
        lookup = self._merges.get
        steps = list(map(lookup, zip(ids, ids[1:])))  # of each neighbour pair: (rank, merged id), or None
        while any(steps):
            i = steps.index(min(filter(None, steps)))
            ids[i : i + 2] = [steps[i][1]]
            del steps[i]
            if i:
                steps[i - 1] = lookup((ids[i - 1], ids[i]))
            if i < len(steps):
                steps[i] = lookup((ids[i], ids[i + 1]))
        return packed(ids)

    def _merge_long(self, ids: list[int]) -> bytes:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges, n = self._merges, len(ids)
        heap = [(m[0], i, m[1], pair) for i, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, m[1], (ids[a], ids[b])))
        return packed([x for x in ids if x >= 0])

    def _encode_word(self, word: bytes) -> bytes:
        return b"".join(self._fragments[f] for f in self.fragments(word))

    def encode(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, piece by piece."""
        for piece in pieces(text):
            parts = self._special_pattern.split(piece) if self._special_pattern and any(s in piece for s in self.special) else [piece]
            for part in parts:
                if part in self.special:
                    yield packed([self.special[part]])
                elif "\u0307" in part or WIDE.search(low := part.lower()):  # a mark of the text's own may compose with the letter before it
                    yield b"".join(map(self._encode_word, self._split(part)))
                else:
                    yield b"".join(map(self._known.__getitem__, self._words.findall(low)))

    def decode(self, ids) -> str:
        """The tokens joined by spaces, as a vocabulary file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_packed(self, data: bytes) -> str:
        return self.decode(np.frombuffer(data, "<u4").tolist())


def pieces(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """A text cut at spaces into pieces of about `chars` characters; no piece boundary lies inside a word."""
    start = 0
    while len(text) - start > chars:
        end = text.find(" ", start + chars)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=2)
def loaded(spec: str) -> Bpe:
    """The encoder of a vocabulary, one for each worker process."""
    return Bpe(spec)


def encode(docs: DataFrame, vocabulary: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns `keep` and the packed ids (binary: little-endian unsigned 32-bit integers) of every row's whole text.

    With `decoded` a column of that name holds the ids decoded again, in the same pass. A null text
    counts as empty and has no ids. Null and repeated ids of rows pass through, each row by itself; an
    empty table gives no rows; columns not in `keep` are not read.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    kept = [f"_{i}" for i in range(len(keep))]

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = loaded(spec.value)
        ids = [b"".join(bpe.encode(t or "")) for t in batch.column(len(kept)).to_pylist()]
        out = dict(zip(kept, batch.columns)) | {"_ids": ids}
        return out | {"_decoded": list(map(bpe.decode_packed, ids))} if decoded else out

    rows_in = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept)), F.col(text_col).alias("_text"))
    shape = rows_in.drop("_text").withColumn("_ids", F.lit(b""))
    shape = shape.withColumn("_decoded", F.lit("")) if decoded else shape
    return map_arrow(rows_in, rows, shape.schema).toDF(*keep, into, *([decoded] if decoded else []))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the decoded text of its packed ids (null: null) in a further column, special tokens included."""
    spec = encoded.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    names = encoded.columns

    def rows(batch: pa.RecordBatch) -> dict:
        bpe = loaded(spec.value)
        texts = [None if data is None else bpe.decode_packed(data) for data in batch.column(names.index(ids_col)).to_pylist()]
        return dict(zip(names, batch.columns)) | {into: texts}

    return map_arrow(encoded, rows, encoded.withColumn(into, F.lit("")).schema)
