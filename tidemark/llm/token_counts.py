"""Edit-aware token counts over segment trees of pre-tokens.

A document's text is split into pre-tokens, which a byte-level vocabulary encodes each by itself.
Runs of LEAF of them are the leaves of a segment tree that holds characters and tokens; each node
holds the sums below it, so the root is the count. An edit is located by descending on characters.
Only the leaves that it touches are encoded again, with boundary context: splitting goes from left
to right and looks a little ahead, so it starts two leaves earlier, and goes on until a boundary
falls on an old leaf's end again, from where on nothing can differ. The sums above the changed
leaves are updated on their paths to the root.

A tree is kept as two arrays in heap order: place 1 is the root, the children of k are 2k and 2k + 1,
leaves fill the second half.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.llm.pretokens import WIDE
from tidemark.llm.token_store import BYTE_SYMBOLS, PRE_TOKEN

LEAF = 32
KNOWN = 250_000

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of a text and the number of tokens of each, by the tokenizers library; what was met is kept in a bounded table."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(spec)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        self._model = self._tokenizer.model
        self.special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, int] = {}
        self._before: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        if WIDE.search(text) is None:
            return PRE_TOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a whole text. A special token in it is a piece by itself."""
        if not any(s in text for s in self.special):
            return self.split(text)
        out, at = [], 0
        while at < len(text):
            place, s = min(((p, s) for s in self.special if (p := text.find(s, at)) >= 0), default=(len(text), ""))
            out += self.split(text[at:place]) + [s] * bool(s)
            at = place + len(s)
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        needed = set(pieces)
        new = {x for x in needed if x not in self._known}
        if len(self._known) + len(new) > KNOWN:
            self._before, self._known, new = self._known, {}, needed
        again = set(filter(self._before.__contains__, new))
        self._known.update((x, self._before[x]) for x in again)
        self._known.update(dict.fromkeys(self.special, 1))
        for x in (new - again).difference(self.special):
            self._known[x] = len(self._model.tokenize(x.encode().decode("latin-1").translate(BYTE_SYMBOLS)))

    def counts(self, pieces: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    return Counter(spec)


class Tree:
    """Heaps of characters and tokens."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.leaves = len(chars) // 2

    @classmethod
    def of(cls, lengths: np.ndarray, counts: np.ndarray, leaf: int = LEAF) -> Tree:
        n = -(-len(lengths) // leaf)
        size = 1 << max(0, n - 1).bit_length()
        heaps = []
        for values in (lengths, counts):
            heap = np.zeros(2 * size, np.int64)
            if n:
                heap[size : size + n] = np.add.reduceat(values, np.arange(0, len(values), leaf))
            width = size
            while width > 1:
                heap[width // 2 : width] = heap[width : 2 * width].reshape(-1, 2).sum(axis=1)
                width //= 2
            heaps.append(heap)
        return cls(*heaps)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, its first character) of the leaf that holds each character; the last leaf that has any, at the end of the text."""
        positions = np.minimum(positions, max(0, int(self.chars[1]) - 1))
        k, start = np.ones(len(positions), np.int64), np.zeros(len(positions), np.int64)
        width = 1
        while width < self.leaves:
            k, width = 2 * k, 2 * width
            right = positions - start >= self.chars[k]
            start += np.where(right, self.chars[k], 0)
            k += right
        return k - self.leaves, start

    def put(self, leaves: np.ndarray, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Set leaves and add up their paths to the root, level by level."""
        k = self.leaves + leaves
        self.chars[k], self.tokens[k] = chars, tokens
        while len(k := np.unique(k // 2)) and k[0]:
            for heap in (self.chars, self.tokens):
                heap[k] = heap[2 * k] + heap[2 * k + 1]


def build(text: str, counter_: Counter, leaf: int = LEAF) -> Tree:
    pieces = counter_.pieces(text)
    counter_.learn(pieces)
    return Tree.of(np.fromiter(map(len, pieces), np.int64, len(pieces)), counter_.counts(pieces), leaf)


def edit(text: str, tree: Tree, changes: Sequence[Edit], counter_: Counter, leaf: int = LEAF) -> tuple[str, Tree, int]:
    """The text with each [start, end) replaced, its tree, and how many characters were encoded again.

    Places are those of the text as it is given and are brought into it. Edits are taken in order of place;
    where one starts before the end of the one before, it starts there. The text is put together once, and edits
    whose surroundings meet are one region. A text that has a special token before or after is counted
    anew, as such a token may reach over any boundary; so is one without leaves.
    """
    parts, spans, at, n = [], [], 0, len(text)
    for start, end, put in sorted(changes):
        start = min(max(start, at), n)
        end = min(max(start, end), n)
        parts += [text[at:start], put]
        spans.append((start, end, len(put) - (end - start)))
        at = end
    if not spans:
        return text, tree, 0
    after = "".join([*parts, text[at:]])
    if not text or any(s in text or s in after for s in counter_.special):
        return after, build(after, counter_, leaf), len(after)
    starts, ends, shifts = (np.array(x, np.int64) for x in zip(*spans))
    shifted = [0, *np.cumsum(shifts).tolist()]
    first, first_at = tree.find(np.maximum(starts - 1, 0))
    for _ in range(2):  # two leaves that have characters: two pre-tokens at least
        first, first_at = tree.find(np.maximum(first_at - 1, 0))
    last, last_at = tree.find(ends)
    last_end = (last_at + tree.chars[tree.leaves + last]).tolist()
    first, first_at, last = first.tolist(), first_at.tolist(), last.tolist()

    def following(end: int, leaves: int) -> tuple[int, int]:
        """The leaf reached and its end, some leaves that have characters further on."""
        found = -1
        while leaves and end < n:
            (place,), (from_,) = tree.find(np.array([end]))
            found, end, leaves = int(place), int(from_ + tree.chars[tree.leaves + place]), leaves - 1
        return found, end

    regions, encoded, i = [], 0, 0
    while i < len(spans):
        to, to_end, j, step = last[i], last_end[i], i + 1, 1
        while True:
            next_leaf, ahead = following(to_end, step)
            if next_leaf < 0:
                next_leaf = to
            if j < len(spans) and first[j] <= next_leaf:
                while j < len(spans) and first[j] <= max(next_leaf, to):
                    to, to_end, j = max(to, last[j]), max(to_end, last_end[j]), j + 1
                continue
            region = after[first_at[i] + shifted[i] : ahead + shifted[j]]
            pieces = counter_.split(region)
            bounds = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            want = to_end + shifted[j] - first_at[i] - shifted[i]
            place = int(np.searchsorted(bounds, want))
            encoded += len(region)
            if want == 0 or (place < len(bounds) and bounds[place] == want):
                regions.append((first[i], to, pieces[: place + 1] if want else []))
                break
            to, to_end, step = next_leaf, ahead, 2 * step
        i = j
    counter_.learn(chain.from_iterable(pieces for *_, pieces in regions))
    if any(len(pieces) > 4 * leaf * (to - from_ + 1) for from_, to, pieces in regions):  # the leaves would grow without bound: the tree is laid out anew
        return after, build(after, counter_, leaf), len(after)
    leaves, chars, tokens = [], [], []
    for from_, to, pieces in regions:
        edges = np.arange(to - from_ + 2) * len(pieces) // (to - from_ + 1)
        leaves.append(np.arange(from_, to + 1))
        chars.append(np.diff(np.append(0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))))[edges]))
        tokens.append(np.diff(np.append(0, np.cumsum(counter_.counts(pieces)))[edges]))
    tree.put(np.concatenate(leaves), np.concatenate(chars), np.concatenate(tokens))
    return after, tree, encoded


# DataFrames


def build_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns `keep`, chars and tokens (arrays in heap order) of every row's whole text; a null text counts as empty.

    Null and repeated ids pass through, each row by itself; an empty table gives no rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    names = [f"_{i}" for i in range(1 + len(keep))]

    def rows(batch: pa.RecordBatch) -> dict:
        own = counter(spec.value)
        texts = [t or "" for t in batch.column(len(names)).to_pylist()]
        split = list(map(own.pieces, texts))
        own.learn(chain.from_iterable(split))
        trees = [Tree.of(np.fromiter(map(len, p), np.int64, len(p)), own.counts(p)) for p in split]
        return dict(zip(names, batch.columns)) | {"_chars": [t.chars for t in trees], "_tokens": [t.tokens for t in trees]}

    rows_in = docs.select(*(F.col(c).alias(n) for c, n in zip((id_col, *keep), names)), F.col(text_col).alias("_text"))
    shape = rows_in.drop("_text").withColumns({c: F.array().cast("array<int>") for c in ("_chars", "_tokens")}).schema
    return map_arrow(rows_in, rows, shape).toDF(id_col, *keep, "chars", "tokens")


def count(tokens: str | Column = "tokens") -> Column:
    """The number of tokens of a tree: the root's sum."""
    return F.get(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(1)).cast("long")


def replacing(pattern: str, put: str) -> Callable[[str], list[Edit]]:
    """Finds the edits that replace every match of a pattern."""
    found = re.compile(pattern)
    return lambda text: [(m.start(), m.end(), put) for m in found.finditer(text)]


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    values, offsets = column.values.to_numpy(), column.offsets.to_pylist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def apply_edits(rows: DataFrame, vocabulary: str, edits_col: str = "edits", finder: Callable[[str], list[Edit]] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns `keep`, text, chars, tokens, n_edits, encoded after the edits of each row.

    `rows` has text and the columns chars and tokens of its tree. Edits are an array of
    struct(start, end, put) on the original text (null: none), or what `finder` finds in the text. All edits of
    a row are applied in one pass, as `edit` says. `encoded` counts the characters that were encoded again. Edits that come as a table are collected by document and joined first.
    """
    spec = rows.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    names = [f"_{i}" for i in range(1 + len(keep))]
    n = len(names)

    def done(batch: pa.RecordBatch) -> dict:
        own, out = counter(spec.value), []
        listed = batch.column(n + 3).to_pylist() if finder is None else [None] * batch.num_rows
        for text, chars, tokens, given in zip(batch.column(n).to_pylist(), _slices(batch.column(n + 1)), _slices(batch.column(n + 2)), listed):
            text, tree, encoded = text or "", Tree(chars, tokens), 0
            edits = finder(text) if finder else [(e["start"], e["end"], e["put"]) for e in given or []]
            if edits:
                text, tree, encoded = edit(text, Tree(chars.astype(np.int64), tokens.astype(np.int64)), edits, own)
            out.append((text, tree.chars, tree.tokens, len(edits), encoded))
        return dict(zip(names, batch.columns)) | dict(zip(("_text", "_chars", "_tokens", "_n", "_encoded"), map(list, zip(*out))))

    columns = [F.col(text_col).alias("_text"), F.col("chars").alias("_chars"), F.col("tokens").alias("_tokens")]
    rows_in = rows.select(*(F.col(c).alias(x) for c, x in zip((id_col, *keep), names)), *columns, *([] if finder else [F.col(edits_col).alias("_edits")]))
    shape = rows_in.drop("_edits").withColumn("_n", F.lit(0)).withColumn("_encoded", F.lit(0).cast("long")).schema
    return map_arrow(rows_in, done, shape).toDF(id_col, *keep, text_col, "chars", "tokens", "n_edits", "encoded")
