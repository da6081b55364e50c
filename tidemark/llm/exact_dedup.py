"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name: the blocks
are grouped by their content, so that a name never stands for two contents, and the contents are sorted (by
hash, and by content where one hash has several); a name is the place in this order, so reruns agree. Names of
adjacent blocks are then paired, and the pairs sorted and named again, level by level, until one name
is left; number of blocks and last name identify the text without collisions.

A block, or a pair of names, that occurs once needs no name: its text equals no other, its own row is its identity, and it
takes no further part. Only repeated contents are carried on, so each level is a fraction of the one before.

The content of the blocks is shuffled once, after partial aggregation, so that a block which a third
of all texts share leaves each map task as one row. Names travel back to the occurrences by a 64-bit
hash of the block; a hash that the grouping by content has shown to stand for two contents is
resolved by content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_or_empty

BLOCK_BYTES = 8192
ROW = ["_id", "_hash"]
#: The lower bits of monotonically_increasing_id: the place within a partition.
PLACE_BITS = 33


def _digest(text: str | Column) -> Column:
    """What tells the rows of one id apart when names travel back to them."""
    return F.unhex(F.sha2(text, 256))


def _sorted_names(contents: DataFrame, *order: str) -> DataFrame:
    """`contents` with _name: the place of each row, from 0 on, in the order of these columns, which tell all rows apart.

    The rows are range-partitioned and sorted; a place in a partition is raised by the rows of the partitions before it, of
    which there is one row each.
    """
    placed = cut(contents.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "names").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    name = F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.join(F.broadcast(parts), "_part").select(*contents.columns, name.alias("_name"))


def _blocks(docs: DataFrame, block_bytes: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """A row for each block: _id, _hash (of the text), _n (blocks of the text), _pos, _block, _h (of the block)."""
    data = F.encode("_text", "UTF-8")
    n = F.greatest(F.lit(1), F.ceil(F.length("_data") / F.lit(block_bytes)).cast("int"))
    return (
        docs.where(F.col("_id").isNotNull())
        .select("_id", _digest("_text").alias("_hash"), data.alias("_data"))
        .select(*ROW, n.alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("_data", i * block_bytes + 1, F.lit(block_bytes)))).alias("_pos", "_block"))
        .withColumn("_h", hashed(F.col("_block")))
    )


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """Occurrences of the repeated blocks: _id, _hash, _n, _pos, _name."""
    contents = blocks.groupBy("_h", "_block").agg(F.count("*").alias("_times"))
    by_hash = _sorted_names(contents.groupBy("_h").agg(F.count("*").alias("_contents"), F.max("_times").alias("_times")).where("_times > 1"), "_h")
    occurrences = blocks.select(*ROW, "_n", "_pos", "_h")
    named = occurrences.join(by_hash.where("_contents = 1").select("_h", "_name"), "_h").drop("_h")
    clashes = by_hash.where("_contents > 1").select("_h")
    if clashes.isEmpty():
        return named
    apart = blocks.join(clashes, "_h", "left_semi")
    names = _sorted_names(apart.groupBy("_block").agg(F.count("*").alias("_times")).where("_times > 1").select("_block"), "_block").withColumn("_name", -1 - F.col("_name"))
    return named.unionByName(apart.join(names, "_block").select(*ROW, "_n", "_pos", "_name"))


def _whole(named: DataFrame, left: Column) -> DataFrame:
    """Of the texts, those all of whose `left` parts have a name. A group is the parts of one text, its repeated rows included."""
    return named.withColumn("_named", F.size(F.collect_set("_pos").over(Window.partitionBy(*ROW)))).where(F.col("_named") == left).drop("_named")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """_id, _hash, _n, _name of every row whose text occurs again: rows with equal (_n, _name) have equal texts.

    `docs` has _id and _text. Rows not returned have a text of their own.
    """
    level = cut(_whole(_name_blocks(_blocks(docs, block_bytes, hashed)), F.col("_n")).withColumn("_parts", F.col("_n")), "level")
    done = []
    while True:
        done.append(level.where("_parts = 1").select(*ROW, "_n", "_name"))
        rest = level.where("_parts > 1")
        if rest.isEmpty():
            break
        half = F.floor(F.col("_pos") / 2).cast("int").alias("_pos")
        side = lambda k: F.max(F.when(F.col("_pos") % 2 == k, F.col("_name")))
        pairs = rest.groupBy(*ROW, "_n", ((F.col("_parts") + 1) / 2).cast("int").alias("_parts"), half).agg(side(0).alias("_left"), side(1).alias("_right"), F.bool_or(F.col("_pos") % 2 == 1).alias("_both"))
        names = _sorted_names(pairs.groupBy("_left", "_right", "_both").agg(F.count("*").alias("_times")).where("_times > 1"), "_left", "_right", "_both")
        matched = pairs.alias("p").join(names.alias("n"), (F.col("p._left") == F.col("n._left")) & F.col("p._right").eqNullSafe(F.col("n._right")) & (F.col("p._both") == F.col("n._both")))
        level = cut(_whole(matched.select(*(f"p.{c}" for c in (*ROW, "_n", "_parts", "_pos")), "n._name"), F.col("_parts")), "level")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty. A row with a null
    id is never a copy: it keeps itself, with a null keep_id. Rows that repeat both id and text are
    one document: they share its verdict and count once. Other columns, whatever their names, are
    not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(F.col(text_col)).alias("_text"))
    found = cut(identities(rows, block_bytes, hashed).distinct(), "identities")
    groups = cut(found.groupBy("_n", "_name").agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1"), "groups")
    copies = found.join(groups, ["_n", "_name"]).select(*ROW, "_keep", "_size")
    every = rows.select("_id", _digest("_text").alias("_hash"), F.sha2("_text", 256).alias("text_sha256"))
    return every.join(copies, ROW, "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("_keep", "_id").eqNullSafe(F.col("_id")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the rows whose text a row with a larger id repeats. All columns stay as they are.

    Rows that share an id are told apart by their texts; equal ones stay or go together.
    """
    gone = verdicts(docs, id_col, text_col, block_bytes).where(~F.col("kept")).select(F.col(id_col).alias("_gone"), "text_sha256").distinct()
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (F.sha2(text_or_empty(docs[text_col]), 256) == gone["text_sha256"]), "left_anti")
