"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are dealt to groups in which some of the 64 bits are equal. Within a group they are
sorted by Gray rank, where neighbours share long patterns. Runs of neighbours form the nodes of a
tree: a node holds the bits on which all its fingerprints agree (a mask) and their values. Two
nodes whose agreed bits differ in more places than the radius have no pair below them, and the whole
pair of groups is pruned; differences add up on the way down, where more bits are agreed.

Groups come from masks. For a radius r, the bits are cut into r + 1 runs: two fingerprints at r
or fewer differences agree in one run at least, so nothing is lost. A group that is too large is
dealt again over r + 1 runs of its free bits, which loses nothing either; distinct fingerprints
with 16 free bits are 65,536 at most, so this ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import FIRST, FURTHER, ROWS_AT_ONCE, cut, map_arrow, meeting, partitions
from tidemark.llm.components import components

BITS = 64
SEED = 42
FANOUT = 8
#: Fingerprints in one group at most; larger ones are dealt again.
GROUP_LIMIT = 1 << 16
#: Fingerprints and node pairs that a task looks at together.
BUFFER = 200_000
PAIRS = 1 << 18
SHINGLES_AT_ONCE = 1 << 16
#: One row in so many is looked at for common shingles: those that so many of its texts hold, of these the most common.
SAMPLE_STEP = 16
SAMPLE_TIMES = 3
COMMON = 1 << 17
#: Pairs that a member of a group of shingles proposes in the first round, and how this grows from round to round.
PARTNERS = 4
GROWTH = 16
#: Rows of one shingle that a task goes through together; those of a larger group are dealt to cells.
CELL = 1 << 16
#: Pairs that a task holds at once, and partners that are compared with one copy of a text.
PAIRS_AT_ONCE = 1 << 18
TOGETHER = 64


# Fingerprints


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 of the word k-shingles of a text, A-Z lower-cased, repeats included, some at a time.

    Fewer words than k give one shingle, the whole sequence; no words give none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    first, last = starts[:n], ends[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, SHINGLES_AT_ONCE):
        a, b = first[i : i + SHINGLES_AT_ONCE].tolist(), last[i : i + SHINGLES_AT_ONCE].tolist()
        yield np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b)), "<u8", len(a))


def fingerprint(text: str | None, k: int) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes. As a signed 64-bit number."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, k):
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and _code (long) of every row."""
    rows_in = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def rows(batch: pa.RecordBatch) -> dict:
        return {"_id": batch.column(0), "_code": [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]}

    return map_arrow(rows_in, rows, f"_id {rows_in.schema['_id'].dataType.simpleString()}, _code long")


# The index


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit pattern in the reflected Gray order, as a signed number."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def runs(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` runs of the given bit positions."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _levels(starts: np.ndarray, n: int, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bottom-up nodes: (agreed mask, pattern, first child, number of children), leaves first. starts: of the groups."""
    ones = np.full(n, ~np.uint64(0), np.uint64)
    levels = [(ones, codes, np.arange(n), np.zeros(n, np.int64))]
    sizes = np.diff(np.append(starts, n))
    alls, anys = codes, codes
    while sizes.max() > 1:
        place = np.arange(len(alls)) - np.repeat(starts, sizes)
        first = np.flatnonzero(place % FANOUT == 0)
        alls, anys = np.bitwise_and.reduceat(alls, first), np.bitwise_or.reduceat(anys, first)
        mask = ~(alls ^ anys)
        levels.append((mask, alls & mask, first, np.diff(np.append(first, len(place)))))
        sizes = -(-sizes // FANOUT)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return levels


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] .. first[i] + count[i] - 1: (owner, number)."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def close_pairs(starts: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (u < v) and distances of the pairs within the radius, group by group. codes: distinct, in Gray order within each group."""
    levels = _levels(starts, len(codes), codes)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    stack = [(top, roots, roots)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            continue
        _, _, first, count = levels[level]
        if len(a) * FANOUT * FANOUT > PAIRS and len(a) > 1:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        owner, left = _spread(first[a], count[a])
        again, right = _spread(first[b][owner], count[b][owner])
        left, same = left[again], (a == b)[owner][again]
        mask, pattern, *_ = levels[level - 1]
        keep = ~same | (left < right if level == 1 else left <= right)
        left, right = left[keep], right[keep]
        apart = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
        keep = apart <= radius
        left, right = left[keep], right[keep]
        if level == 1:
            yield left, right, apart[keep]
        elif len(left):
            stack.append((level - 1, left, right))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def joined(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A star for each connected set: (member, its first member, 0). At most n - 1 rows whatever the number of pairs."""
    parent = np.arange(n)
    for u, v, _ in pairs:
        while True:
            parent = _roots(parent)
            x, y = parent[u], parent[v]
            open_ = x != y
            if not open_.any():
                break
            u, v = u[open_], v[open_]
            np.minimum.at(parent, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
    parent = _roots(parent)
    u = np.flatnonzero(parent != np.arange(n))
    return u, parent[u], np.zeros(len(u), np.int64)


def _search(grouped: DataFrame, radius: int, reduce: Callable) -> DataFrame:
    """src, dst, distance out of rows _mask, _value, _rank, _code dealt and sorted by group and rank."""

    def process(mask: np.ndarray, value: np.ndarray, codes: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
        u, v, d = reduce(len(codes), close_pairs(starts, codes.view(np.uint64), radius))
        return pa.record_batch({"src": codes[u], "dst": codes[v], "distance": d.astype(np.int32)}) if len(u) else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("_mask", "_value", "_code"))]
            if len(held[0]) < BUFFER:
                continue
            mask, value, _ = held
            inner = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            if len(inner):
                whole = inner[-1] + 1
                if (out := process(*(h[:whole] for h in held))) is not None:
                    yield out
                held = [h[whole:] for h in held]
        if len(held[0]) and (out := process(*held)) is not None:
            yield out

    dealt = grouped.repartition(partitions(grouped.sparkSession), "_mask", "_value").sortWithinPartitions("_mask", "_value", "_rank")
    return dealt.select("_mask", "_value", "_code").mapInArrow(run, "src long, dst long, distance int")


def hamming_links(codes: DataFrame, radius: int, masks: list[int], reduce: Callable = joined, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """src, dst, distance between the distinct fingerprints in `codes` (_code) that share a group and lie within the radius.

    With the masks of `runs(range(64), radius + 1)` and `joined`, the links connect exactly the
    fingerprints that are connected within the radius.
    """
    spark, out = codes.sparkSession, None
    spread = codes.repartition(partitions(spark))  # each fingerprint becomes a row for every mask: many small tasks, not a few large ones
    grouped = spread.select("_code", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("_mask"))
    left = codes.count() > group_limit
    while True:
        grouped = grouped.withColumn("_value", F.col("_code").bitwiseAND(F.col("_mask")))
        large = cut(grouped.groupBy("_mask", "_value").count().where(F.col("count") > group_limit).select("_mask", "_value"), "large") if left else None
        left = large is not None and not large.isEmpty()
        here = grouped.join(large, ["_mask", "_value"], "left_anti") if left else grouped
        found = _search(here.withColumn("_rank", gray_rank(F.col("_code"))), radius, reduce)
        out = found if out is None else out.unionByName(found)
        if not left:
            return out
        free = {m: [b for b in range(BITS) if not m >> b & 1] for m in masks}
        below = [(m, m | part) for m in masks for part in runs(free[m], radius + 1)]
        masks = sorted({m for _, m in below})
        children = F.broadcast(spark.createDataFrame([(signed(a), signed(b)) for a, b in below], "_mask long, _child long"))
        grouped = grouped.join(large, ["_mask", "_value"], "left_semi").join(children, "_mask").select("_code", F.col("_child").alias("_mask")).distinct()


# The operators


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest id that can be
    reached, the row's own included. Null and empty texts have fingerprint zero and link like any
    other. A null id takes the smallest id of its component, null if there is none; repeated rows pass
    through; other columns are not read; an empty table gives no rows.
    """
    found = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    placed = code_components(found, radius, group_limit)
    return placed.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_code"), 16, "0")).alias("fingerprint"), "component_id")


def code_components(found: DataFrame, radius: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """_id, _code and component_id of every row of `found` (_id, _code): the smallest id that fingerprints within the radius lead to."""
    codes = cut(found.groupBy("_code").agg(F.min("_id").alias("_least")), "codes")
    links = hamming_links(codes.select("_code"), radius, runs(list(range(BITS)), radius + 1), joined, group_limit)
    roots = components(links)
    placed = codes.join(roots, codes["_code"] == roots["node"], "left").select("_code", "_least", F.coalesce("root", "_code").alias("_root"))
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    reached = cut(placed.join(least, "_root").select("_code", "component_id"), "components")
    return found.join(reached, "_code").select("_id", "_code", "component_id")


def shingle_set(text: str | None, k: int) -> np.ndarray:
    found = list(shingle_hashes(text, k))
    return np.unique(np.concatenate(found)) if found else np.empty(0, "<u8")


def jaccard(a: str | None, b: str | None, k: int) -> float:
    """Share of common shingles; two texts without words are alike."""
    return alike(shingle_set(a, k), shingle_set(b, k))


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """The same of two sets."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def parity(found: np.ndarray) -> bytes:
    """Whether an odd number of a set's shingles fall into each place; there are as many places as shingles, to a power of two."""
    places = 1 << min(20, max(8, (len(found) - 1).bit_length()))
    return np.packbits(np.bincount((found & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def shown(a: bytes, b: bytes) -> int:
    """How many shingles two sets differ in at least, by their parities. The longer one is folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """_id, _code (the fingerprint), _n (distinct shingles) and _parity of every row."""

    def each(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        sets = [shingle_set(t, shingle) for t in texts]
        return {"_id": batch.column(0), "_code": [fingerprint(t, shingle) for t in texts], "_n": list(map(len, sets)), "_parity": list(map(parity, sets))}

    return map_arrow(rows, each, f"_id {rows.schema['_id'].dataType.simpleString()}, _code long, _n int, _parity binary")


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of the rows, sorted, and their places from 1 on, the less common first.

    They only order the shingles, so the sample and its bounds decide how long a search takes, not what it finds.
    """

    def each(batch: pa.RecordBatch) -> dict:
        return {"_shingle": np.concatenate([shingle_set(t, shingle) for t in batch.column(0).to_pylist()] or [np.empty(0, "<u8")]).view("<i8")}

    sample = rows.where(F.pmod(F.xxhash64("_id"), F.lit(SAMPLE_STEP)) == 0).select("_text")
    counts = map_arrow(sample, each, "_shingle long").groupBy("_shingle").count().where(F.col("count") >= SAMPLE_TIMES)
    found = counts.orderBy(F.desc("count"), "_shingle").limit(COMMON).toPandas()["_shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - np.arange(len(found)))[order]


def _prefix(found: np.ndarray, common: np.ndarray, places: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, common ones last: two sets that share `similarity` have one of them in common."""
    if not len(found):
        return np.zeros(1, "<u8")  # texts without words meet each other
    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    place = np.where(common[at] == found, places[at], 0) if len(common) else np.zeros(len(found), np.int64)
    return found[np.lexsort((found, place))[: len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1]]


def _postings(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """_shingle, _at (its place in the order), _n (shingles of the text) and _id of the prefix of every row that may have company.

    Rows whose shingle no other row has are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, shingle))

    def each(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
        firsts = [_prefix(s, *shared.value, similarity) for s in sets]
        sizes = np.fromiter(map(len, firsts), np.int64, len(firsts))
        owner, at = _spread(np.zeros(len(sizes), np.int64), sizes)
        found = np.concatenate(firsts).view("<i8")
        _, state = meeting([found], np.arange(len(found)), found)
        return {"_shingle": found, "_place": at << 2 | state, "_n": np.fromiter(map(len, sets), np.int64, len(sets))[owner], "_id": batch.column(0).take(pa.array(owner))}

    kind = rows.schema["_id"].dataType.simpleString()
    posted = map_arrow(rows, each, f"_shingle long, _place long, _n int, _id {kind}")
    key = F.when(F.col("_place").bitwiseAND(3) == FURTHER, F.xxhash64("_shingle", "_id")).otherwise(F.col("_shingle"))
    met = posted.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key).mapInArrow(_company, posted.schema)
    return met.select("_shingle", F.shiftright("_place", 2).cast("int").alias("_at"), "_n", "_id")


def _company(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows sorted by the key they are dealt by those that share their _shingle with another row; holds one row between batches."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        key, state = table.column("_shingle").to_numpy(), table.column("_place").to_numpy() & 3
        known = state == FURTHER
        # Only rows that are there to meet count as company; the others have theirs already.
        shared, meet = known | (state == FIRST), np.flatnonzero(~known)
        same = key[meet][1:] == key[meet][:-1]
        shared[meet] |= np.concatenate([[len(meet) > 0 and before == key[meet[0]]], same])[: len(meet)] | np.concatenate([same, [False]])[: len(meet)]
        if len(meet):
            last = meet[-1]
            if not shared[last]:  # the next batch may bring its company
                held = table.slice(last, 1).to_batches()[0]
                before = key[meet[-2]] if len(meet) > 1 else before
            else:
                held, before = None, key[last]
        out = table.filter(pa.array(shared))
        yield from out.to_batches()


def proposals(group: np.ndarray, at: np.ndarray, n: np.ndarray, part: np.ndarray, k: int, similarity: float, most_at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each member up to k earlier members of its group and another part that may share `similarity`; and the groups with more.

    Slice by slice, of some `most_at_once` pairs and one more for each member at most. group: ascending. A group's largest part comes first, so that what
    has been joined is not gone through again; otherwise the order is that given.
    """
    _, first, inverse, count = np.unique(np.stack([group, part]), axis=1, return_index=True, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    order = np.lexsort((np.arange(len(group)), first[inverse], -count[inverse], group))
    group, at, n, inverse = group[order], at[order].astype(np.int64), n[order].astype(np.int64), inverse[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    start = np.repeat(starts, np.diff(np.append(starts, len(group))))
    given, u, v, more, held = np.zeros(len(group), np.int64), [], [], [], 0
    none = np.empty(0, np.int64)
    joined_up = lambda x: np.concatenate(x) if x else none
    rows, step = np.flatnonzero(inverse != inverse[start]), 0
    while len(rows):
        lead = start[rows] + step
        both = n[rows] + n[lead]
        need = np.ceil(similarity / (1 + similarity) * both - 1e-9)
        most = np.minimum(n[rows] - at[rows], n[lead] - at[lead])  # if this is the first shingle that they share
        may = (inverse[rows] != inverse[lead]) & (most >= need) & (np.minimum(n[rows], n[lead]) >= need)
        full = may & (given[rows] >= k)
        more.append(group[rows[full]])
        good = may & ~full
        u.append(rows[good])
        v.append(lead[good])
        given[rows[good]] += 1
        held += len(u[-1])
        if held >= most_at_once:
            yield order[joined_up(u)], order[joined_up(v)], none
            u, v, held = [], [], 0
        step += 1
        rows = rows[~full]
        rows = rows[rows - start[rows] > step]
    yield order[joined_up(u)], order[joined_up(v)], np.unique(joined_up(more))


def _by_group(batches: Iterable[pa.RecordBatch], work: Callable[[pa.Table], Iterable[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """`work` over whole groups (column 0, sorted), many at a time."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < BUFFER:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))
        if whole:
            yield from work(table.slice(0, whole))
        held = table.slice(whole).combine_chunks().to_batches()
        rows = sum(b.num_rows for b in held)
    if held:
        yield from work(pa.Table.from_batches(held))


def in_cells(parted: DataFrame, large: DataFrame, cell: int) -> DataFrame:
    """`parted` (_shingle, _id, _part, ...) with _key: rows that are to be gone through together, at most about `cell` of them.

    A group of ordinary size has its shingle as key. In a large one the rows of its largest part, which
    are joined already, need no pairs among themselves: they are cut into blocks, and each block meets
    each block of the other rows; blocks of the other rows meet each other too. If all rows are of one part nothing is left to do.
    """
    small = parted.join(large, "_shingle", "left_anti").withColumn("_key", F.col("_shingle"))
    if large.isEmpty():
        return small
    rows = parted.join(large, "_shingle", "left_semi")
    parts = rows.groupBy("_shingle", "_part").count()
    half = max(1, cell // 2)
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / half)).cast("int")
    shape = parts.groupBy("_shingle").agg(F.max_by("_part", F.struct("count", "_part")).alias("_main"), F.max("count").alias("_inside"), F.sum("count").alias("_all"))
    shape = shape.where("_all > _inside").select("_shingle", "_main", blocks(F.col("_inside")).alias("_i"), blocks(F.col("_all") - F.col("_inside")).alias("_o"))
    dealt = rows.join(shape, "_shingle").withColumn("_mine", F.xxhash64("_id"))
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    inner, outer = F.pmod("_mine", "_i").cast("int"), F.pmod("_mine", "_o").cast("int")
    inside = F.transform(numbers(F.col("_o")), lambda o: F.struct(F.lit("in").alias("what"), inner.alias("x"), o.alias("y")))
    outside = F.transform(numbers(F.col("_i")), lambda i: F.struct(F.lit("in").alias("what"), i.alias("x"), outer.alias("y")))
    others = F.transform(numbers(F.col("_o")), lambda o: F.struct(F.lit("out").alias("what"), F.least(o, outer).alias("x"), F.greatest(o, outer).alias("y")))
    cells = F.when(F.col("_part") == F.col("_main"), inside).otherwise(F.concat(outside, F.filter(others, lambda c: c["x"] != c["y"])))
    met = dealt.withColumn("_cell", F.explode(cells)).withColumn("_key", F.xxhash64("_shingle", "_cell"))
    return small.unionByName(met.select(small.columns))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """id and component_id of the rows that have a near-duplicate: texts whose word-shingle sets share `similarity` or more.

    The index gives the components of fingerprints within `radius`. Each member of such a class is decided on the
    whole texts against the class's representative, its smallest id: a class of n gives n - 1 decisions.

    Fingerprints of texts at the threshold can lie farther apart than any radius that an index can search, so what the index
    leaves is completed by exact candidates: all shingles have one order, the common ones last; sets of n
    shingles that share `similarity` have one of their first n - ceil(similarity n) + 1 in common, so the pairs within
    the groups of these shingles are all there can be. Of them only those between two components matter: in each
    round the members of a group propose a few partners of other components, these are decided and the components
    joined; groups with pairs left are gone through again with more partners, until none has any. The components
    are those over all pairs, up to equal 64-bit hashes of different shingles. A group of more than `cell` rows is
    dealt to cells, so that no task holds it whole. Rows with a null id take no part.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isNotNull())
    spark, kind = docs.sparkSession, rows.schema["_id"].dataType.simpleString()

    sketches = cut(_sketches(rows, shingle), "sketches")

    def possible(batch: pa.RecordBatch) -> dict:
        a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
        most = [p + q - 2 * int(np.ceil(similarity / (1 + similarity) * (p + q) - 1e-9)) for p, q in zip(n, m)]
        keep = pa.array([shown(*pair) <= k for k, *pair in zip(most, x, y)], pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    def decided(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) those that share enough, as src and dst: by the parities where they show that it cannot be, else by the texts."""
        sketch = lambda c: sketches.select(F.col("_id").alias(c), F.col("_n").alias(f"{c}_n"), F.col("_parity").alias(f"{c}_parity"))
        sketched = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "a_n", "b_n", "a_parity", "b_parity")
        pairs = cut(map_arrow(sketched, possible, f"a {kind}, b {kind}"), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
        texts = cut(rows.join(ids, "_id", "left_semi"), "texts")
        # the partners of a text come to it, some to each of its copies, and not the text to every pair
        copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_copies"))
        dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_copies").cast("int").alias("_copy"))
        heads = dealt.select("a", "_copy").distinct().select("a", "_copy", F.lit(True).alias("_head"), F.col("a").alias("_id"))
        sides = heads.unionByName(dealt.select("a", "_copy", F.lit(False).alias("_head"), F.col("b").alias("_id"))).join(texts, "_id")
        met = sides.select("a", "_copy", "_head", "_id", "_text").repartition(partitions(spark), "a", "_copy").sortWithinPartitions("a", "_copy", F.desc("_head"))
        return cut(met.mapInArrow(compared, f"src {kind}, dst {kind}"), "links")

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Out of a head's texts and its partners', sorted: head and partner where they share enough. Held is the set of the head."""
        key, heads = None, []
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            keep = []
            for a, copy, head, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                found = shingle_set(text, shingle)
                if (a, copy) != key:
                    key, heads = (a, copy), []
                if head:
                    heads.append(found)
                keep.append(not head and any(alike(x, found) >= similarity for x in heads))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch({"src": batch.column(0).filter(keep), "dst": batch.column(3).filter(keep)})

    classes = code_components(sketches.select("_id", "_code"), radius).where(F.col("_id") != F.col("component_id"))
    tried = cut(classes.select(F.col("component_id").alias("a"), F.col("_id").alias("b")).distinct(), "pairs")
    links = decided(tried)
    roots = components(links)

    groups = cut(_postings(rows, shingle, similarity), "groups")
    large = cut(groups.groupBy("_shingle").count().where(F.col("count") > cell).select("_shingle"), "large")

    def proposed(limit: int) -> Callable:
        def work(table: pa.Table) -> Iterable[pa.RecordBatch]:
            table = table.combine_chunks()
            ids, part = table.column("_id").chunk(0), table.column("_part").chunk(0).dictionary_encode().indices.to_numpy()
            key, at, n = (table.column(c).to_numpy() for c in ("_key", "_at", "_n"))
            for u, v, more in proposals(key, at, n, part, limit, similarity):
                more = table.column("_shingle").to_numpy()[np.searchsorted(key, more)]
                a, b = (pa.concat_arrays([ids.take(pa.array(x)), pa.nulls(len(more), ids.type)]) for x in (u, v))
                yield pa.record_batch({"a": a, "b": b, "_open": pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(more, pa.int64())])})

        return lambda batches: _by_group(batches, work)

    here, limit = groups, PARTNERS
    while True:
        parted = here.join(roots, here["_id"] == roots["node"], "left").select(here["*"], F.coalesce("root", "_id").alias("_part"))
        dealt = in_cells(parted, large, cell).repartition(partitions(spark), "_key").sortWithinPartitions("_key", "_at", "_n", "_id")
        met = cut(dealt.mapInArrow(proposed(limit), f"a {kind}, b {kind}, _open long"), "proposals")
        pairs = met.where("a IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried, links = tried.unionByName(pairs), links.unionByName(decided(pairs))
        roots = components(links)
        left = met.where("_open IS NOT NULL").select(F.col("_open").alias("_shingle")).distinct()
        if left.isEmpty():
            return roots.select(F.col("node").alias(id_col), F.col("root").alias("component_id"))
        here, limit = groups.join(left, "_shingle", "left_semi"), limit * GROWTH


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near-duplicates, that of the smallest id. All columns stay as they are."""
    gone = near_duplicates(docs, shingle, similarity, radius, id_col, text_col).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
