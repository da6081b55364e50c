"""Alignment of the tokens of two tokenizers.

Both token sequences of a text cover the same bytes. The tokens are the nodes of a bipartite graph, an edge joins
two tokens that share a byte, and union-find over the edges gives its connected components: the minimal groups of tokens of
one side that cover just the bytes of some tokens of the other. The members of a component are then expanded into links, and
how often two ids are linked is counted over the corpus (see `batches`).

Texts are cut where both tokenizers cut for certain, before the space of a word, so each different word with its space
is encoded and aligned once in a batch. Where a vocabulary does not promise such cuts the text is aligned whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.batches import answered, buckets_for, in_batches, pack, pack_places, scattered, unpack, unpack_places
from tidemark.llm.bpe import byte_symbols
from tidemark.llm.common import cut

#: Bytes of text of a batch, pieces that are encoded as one text, and such texts at once.
BATCH_BYTES = 4 << 20
RUN = 256
RUNS_AT_ONCE = 64
#: What B writes for a space.
SPACE = "▁"
#: Before this space both sides cut: it follows no other space and stands before something else than white space.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")

#: Which pairs of a component's members are links.
LINKS = ("ends", "overlaps", "all")

STORED = "batch long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, words binary, bucket int, a binary, b binary, n binary, sizes binary"
ANSWERS = "kind string, batch long, bucket int, a binary, b binary, n binary, best binary"
_ANSWERS = pa.schema([("kind", pa.string()), ("batch", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("a", "b", "n", "best"))])


class Aligned(NamedTuple):
    """Pieces of text: place (where each piece is in what follows), ok (both sides give its bytes), counts (n_a, n_b, n_groups and links of each), groups as text, and the links (a << 32 | b) one piece after another."""

    place: np.ndarray
    ok: np.ndarray
    counts: np.ndarray
    groups: list[str]
    links: np.ndarray


class Alignment(NamedTuple):
    documents: DataFrame
    stored: DataFrame
    answers: DataFrame


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the graph: pairs of tokens that share a byte. Tokens are given by where they end, each starts where the one before it ends."""
    first = np.searchsorted(ends_b, np.append(0, ends_a[:-1]), "right")
    n = np.searchsorted(ends_b, ends_a, "left") - first + 1
    of_a = np.repeat(np.arange(len(ends_a)), n)
    return of_a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of_a]


def components(nodes: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, by union-find over all edges at once: roots that an edge joins are hooked to the smaller one, then every path is halved until it is short."""
    root = np.arange(nodes)
    while True:
        x, y = root[left], root[right]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def cuts_surely(a_spec: str, b_model: bytes) -> bool:
    """Whether both vocabularies cut before the space of a word wherever CUT finds one. The files are taken apart for this on the driver alone."""
    from sentencepiece.sentencepiece_model_pb2 import ModelProto

    before, proto = json.loads(a_spec), ModelProto.FromString(b_model)
    split, rules = before["pre_tokenizer"] or {}, proto.normalizer_spec
    sure_a = before["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    sure_b = rules.name == "identity" and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    return bool(sure_a and sure_b and not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces))


class Aligner:
    """Aligns pieces of text that start with a space (which B adds by itself)."""

    def __init__(self, a_spec: str, b_model: bytes, links: str, sure: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        if links not in LINKS:
            raise ValueError(f"links: one of {LINKS}")
        self._a, self._b, self._links = Tokenizer.from_str(a_spec), SentencePieceProcessor(model_proto=b_model), links
        self._a.encode_special_tokens = True
        self._a.no_padding()
        self._a.no_truncation()
        byte = {s: b for b, s in enumerate(byte_symbols())}
        special = {i: t.content for i, t in self._a.get_added_tokens_decoder().items()}
        self.bytes_a = {i: special[i].encode() if i in special else bytes(map(byte.__getitem__, t)) for t, i in self._a.get_vocab().items()}
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sure = sure
        self._size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self._size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self._first_b = len(self._size_a)
        self._written = [f"{i}{mark}" for n in (self._first_b, len(pieces)) for i in range(n) for mark in ",|;\n"]

    def pieces(self, text: str) -> list[str]:
        """A text that follows a space, cut at certain places; each piece lacks its first space."""
        return CUT.split(text) if self.sure else [text]

    def _encoded(self, runs: list[list[int]], pieces: list[str]) -> Iterator[tuple[list[int], np.ndarray | None, np.ndarray | None]]:
        """Runs of pieces with the ids of each side, in their order; a run whose bytes one side does not give back comes piece by piece, and such a piece without ids."""
        for k in range(0, len(runs), RUNS_AT_ONCE):
            some = runs[k : k + RUNS_AT_ONCE]
            texts = [" ".join([pieces[i] for i in run]) for run in some]
            for run, text, found, other in zip(some, texts, self._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self._b.encode(texts, num_threads=1)):
                data, mine = (" " + text).encode(), found.ids
                if b"".join([self.bytes_a[i] for i in mine]) == data and b"".join([self.bytes_b[i] for i in other]) == data:
                    yield run, np.array(mine, np.int32), np.array(other, np.int32)
                elif len(run) > 1:
                    yield from self._encoded([[i] for i in run], pieces)
                else:
                    yield run, None, None

    def align(self, pieces: list[str]) -> Aligned:
        """All pieces at once. Those that start and end without white space are encoded in runs, as both sides cut between them."""
        plain = [i for i, p in enumerate(pieces) if self.sure and p and not p[0].isspace() and not p[-1].isspace()]
        alone = sorted(set(range(len(pieces))).difference(plain))
        order, failed, a, b = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for run, mine, other in self._encoded([plain[i : i + RUN] for i in range(0, len(plain), RUN)] + [[i] for i in alone], pieces):
            if mine is None:
                failed += run
            else:
                order += run
                a.append(mine)
                b.append(other)
        a, b = (np.concatenate(x).astype(np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self._size_a[a]), np.cumsum(self._size_b[b])
        ends = np.cumsum([len(pieces[i].encode()) + 1 for i in order]).astype(np.int64)
        left, right = overlaps(ends_a, ends_b)
        root = components(len(a) + len(b), left, right + len(a))
        groups = np.flatnonzero(root[: len(a)] == np.arange(len(a)))
        piece = lambda tokens, at: np.searchsorted(ends, at[tokens], "left")
        if self._links == "all":
            size = np.bincount(root[len(a) :], minlength=len(a))[root[: len(a)]]  # of B tokens in each A token's component
            first = np.searchsorted(root[len(a) :], root[: len(a)], "left")
            left = np.repeat(np.arange(len(a)), size)
            right = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[left]
        elif self._links == "ends":
            together = ends_a[left] == ends_b[right]
            left, right = left[together], right[together]
        n = len(pieces)
        counts = np.stack([np.bincount(piece(tokens, at), minlength=n) for tokens, at in ((slice(None), ends_a), (slice(None), ends_b), (groups, ends_a), (left, ends_a))], axis=1)
        place = np.empty(n, np.int64)
        place[order + failed] = np.arange(n)
        return Aligned(place, np.arange(n) < len(order), counts, self._texts(a, b, root, piece(slice(None), ends_a)) + [""] * len(failed), a[left] << 32 | b[right])

    def _texts(self, a: np.ndarray, b: np.ndarray, root: np.ndarray, piece: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each piece. The mark after a token says whether the next one is of its side, its component, its piece."""
        if not len(a):
            return []
        side = np.append(np.zeros(len(a), np.int64), np.ones(len(b), np.int64))
        order = np.argsort(root * 2 + side, kind="stable")
        of, its = root[order], side[order]
        mark = np.where(of[1:] == of[:-1], (its[1:] != its[:-1]).astype(np.int64), np.where(piece[of[1:]] == piece[of[:-1]], 2, 3))
        ids = np.append(a, b + self._first_b)[order]
        return "".join(map(self._written.__getitem__, (ids * 4 + np.append(mark, 3)).tolist())).split("\n")[:-1]


@lru_cache(maxsize=2)
def aligner(a_spec: str, b_model: bytes, links: str, sure: bool) -> Aligner:
    return Aligner(a_spec, b_model, links, sure)


class _Slots(dict):
    def __missing__(self, piece: str) -> int:
        self[piece] = slot = len(self)
        return slot


def _read(a_spec, b_model, sure: bool, links: str, buckets: int, limit: int, keep: bool, id_type: pa.DataType):
    """Documents with the places of their pieces, a row with the links of the batch's pieces, and the pairs of ids to be counted, by bucket of B's id."""
    names = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([("batch", pa.int64()), ("id", id_type), *((x, pa.int64()) for x in names), ("groups_sha256", pa.string()), ("groups", pa.string()), ("words", pa.binary()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("a", "b", "n", "sizes"))])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a_spec.value, b_model.value, links, sure)
        for number, batch in in_batches(rows, limit):
            slots, docs = _Slots(), []
            for doc, text in batch:
                docs.append((doc, np.fromiter(map(slots.__getitem__, made.pieces(text) if text else ()), np.int32)))
            found = made.align(list(slots))
            counts, texts, out = found.counts, found.groups, []
            docs = [(doc, found.place[words]) for doc, words in docs]
            docs = [(doc, words if found.ok[words].all() else words[:0]) for doc, words in docs]
            times = np.bincount(np.concatenate([words for _, words in docs]), minlength=len(texts))
            for doc, words in docs:
                groups = ";".join([texts[w] for w in words.tolist()])
                out.append({"batch": number, "id": doc, "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "", "groups": groups if keep else None, "words": pack_places(words)} | dict(zip(names, counts[words].sum(axis=0).tolist())))
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            sizes = counts[:, 3]
            pairs, inverse = np.unique(found.links, return_inverse=True)
            n = np.bincount(inverse, np.repeat(times, sizes), len(pairs)).astype(np.int64)
            at = (scattered(pairs & 0xFFFFFFFF) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            out.append({"batch": number, "sizes": pack(sizes), "words": pack_places(place[inverse])})
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                out.append({"batch": number, "bucket": int(at[part[0]]), "a": pack(pairs[part] >> 32), "b": pack(pairs[part] & 0xFFFFFFFF), "n": pack(n[part])})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _count(bucket: int, rows: list[dict]) -> Iterator[dict]:
    """The corpus-wide counts of a batch's pairs, and the highest count of each pair's B id. All pairs of a B id are in its bucket."""
    a, b, n = (np.concatenate([unpack(r[x]) for r in rows]) for x in ("a", "b", "n"))
    pairs, inverse = np.unique(b << 32 | a, return_inverse=True)
    total = np.bincount(inverse, n, len(pairs)).astype(np.int64)
    first = np.flatnonzero(np.append(True, np.diff(pairs >> 32) != 0))
    best = np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(pairs))))
    end = 0
    for r in rows:
        start, end = end, end + len(unpack(r["n"]))
        mine = inverse[start:end]
        yield {"kind": "answer", "batch": r["batch"], "bucket": bucket, "n": pack(total[mine]), "best": pack(best[mine])}
    seen = total > 0  # a word of texts that have no tokens may be in no other text
    yield {"kind": "table", "bucket": bucket, "a": pack(pairs[seen] & 0xFFFFFFFF), "b": pack(pairs[seen] >> 32), "n": pack(total[seen]), "best": pack(best[seen])}


def _digest(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """n_best and count_sum of a batch's documents."""
    found = sorted(answers.select(["bucket", "n", "best"]).to_pylist(), key=lambda r: r["bucket"])
    n, best = (np.concatenate([unpack(r[x]) for r in found] or [np.zeros(0, np.int64)]) for x in ("n", "best"))
    is_docs = np.array(rows["sizes"].is_null())
    table = rows.filter(pa.array(~is_docs)).to_pylist()[0]
    docs = rows.filter(pa.array(is_docs))
    sizes, links = unpack(table["sizes"]), unpack_places(table["words"])
    of = np.repeat(np.arange(len(sizes)), sizes)
    each = [np.bincount(of, x[links], len(sizes)).astype(np.int64) for x in (n == best, n)]
    words = [unpack_places(w) for w in docs["words"].to_pylist()]
    n_best, count_sum = (np.array([int(each[k][w].sum()) for w in words], np.int64) for k in (0, 1))
    out = docs.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"])
    return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def align(docs: DataFrame, a_vocabulary: str, b_model: str, links: str = "ends", keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> Alignment:
    """Tokens, groups and links of every row's text by a byte-level tokenizers file (A, for a space and the text) and a sentencepiece model (B, which adds the space).

    `documents` has the row's id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose count over the corpus is the highest
    of their B id, ties included), count_sum (of these counts), groups_sha256 and groups (`a1,a2|b1;a3|b2,b3`, null without `keep_groups`).
    Links are the pairs of a group that end together (`ends`), share a byte (`overlaps`), or `all`. A null or empty text, and one of which either
    side's tokens do not give the bytes back, has no tokens: zeros and ''. Special tokens inside texts are plain text. Null and
    repeated ids pass through, each row by itself, and count each time; other columns are not read; an empty table gives no rows.
    """
    context = docs.sparkSession.sparkContext
    a_text, b_bytes = Path(a_vocabulary).read_text(), Path(b_model).read_bytes()
    a_spec, model = context.broadcast(a_text), context.broadcast(b_bytes)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    read = _read(a_spec, model, cuts_surely(a_text, b_bytes), links, buckets_for(rows, "text"), batch_bytes, keep_groups, to_arrow_type(kind))
    stored = cut(rows.mapInArrow(read, STORED.format(id=kind.simpleString())), "aligned")
    asked = stored.where("bucket IS NOT NULL").select("bucket", "batch", "a", "b", "n")
    answers = cut(answered(asked, _count, _ANSWERS, ANSWERS), "pairs")
    texts = stored.where("bucket IS NULL").select("batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "words", "sizes")
    back = answers.where("kind = 'answer'").select("batch", "bucket", "n", "best")
    ddl = f"id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    done = texts.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(_digest, ddl)
    return Alignment(done.withColumnRenamed("id", id_col), stored, answers)


def pair_counts(found: Alignment) -> DataFrame:
    """a, b, n (how often the ids are linked) and best (the highest n of the B id) of every pair of linked ids."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            yield pa.record_batch({x: unpack(r[x]) for x in ("a", "b", "n", "best")})

    return found.answers.where("kind = 'table'").select("a", "b", "n", "best").mapInArrow(rows, "a long, b long, n long, best long")
