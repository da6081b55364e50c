from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup, verdicts

SCHEMA = "doc_id long, text string, _id string, kept int"


def brute(rows):
    groups = defaultdict(set)
    for doc, text, *_ in rows:
        groups[text or ""].add(doc)
    return {doc: (max(groups[text or ""]), len(groups[text or ""]), doc == max(groups[text or ""])) for doc, text, *_ in rows}


ROWS = [
    (1, "abc", "x", 1), (2, "abc", "x", 2), (3, "abd", None, 3), (4, None, "x", 4), (5, "", "x", 5),
    (6, "a" * 1000 + "é" * 50, "x", 6), (7, "a" * 1000 + "é" * 50, "x", 7), (8, "a" * 1000, "x", 8),
    (9, "ab" * 40, "x", 9), (10, "ba" * 40, "x", 10), (11, "ab" * 40 + "c", "x", 11), (12, "ab" * 40, "x", 12),
    (13, "abababab" + "cdcdcdcd", "x", 0), (14, "cdcdcdcd" + "abababab", "x", 0), (15, "abababab", "x", 0), (16, "a" * 8, "x", 0), (17, "a" * 16, "x", 0),
]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda b: F.length(b).cast("long")])
def test_matches_brute_force_also_when_block_hashes_clash(spark, hashed):
    got = verdicts(spark.createDataFrame(ROWS, SCHEMA), block_bytes=8, hashed=hashed).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == brute(ROWS)
    assert len(got) == len(ROWS)


def test_dedup_keeps_the_largest_id_and_every_column(spark):
    got = exact_dedup(spark.createDataFrame(ROWS, SCHEMA), block_bytes=8)
    assert got.columns == ["doc_id", "text", "_id", "kept"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, v in brute(ROWS).items() if v[2])


def test_empty_null_ids_and_repeated_rows(spark):
    assert verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a", "", 0), (None, "a", "", 0), (1, "a", "", 0), (1, "a", "", 0), (2, "a", "", 0)]
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in verdicts(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(0, None, 1, True), (0, None, 1, True), (1, 2, 2, False), (1, 2, 2, False), (2, 2, 2, True)]
