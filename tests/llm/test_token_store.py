import io
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "a  b   c\n d \n\n  e\t f", " lead", "trail ", "<|endoftext|> x", "it's  déjà-vu  京　x \x1c y", "\n x\r\n  y", "x" * 5000, None, "word " * 3000]


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_encoder_gives_the_library_ids(text):
    assert np.frombuffer(ts.Encoder(LIBRARY.to_str()).encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


ENCODER = ts.Encoder(LIBRARY.to_str())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t ab'sé1.京"), max_size=30))
def test_any_spacing(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (ts.from_planes(ts.to_planes(ids, kind), n, kind) == ids).all()


def test_a_damaged_chunk_is_noticed():
    out = io.BytesIO()
    writer = ts.ShardWriter(out, block_ids=4)
    writer.add(1, ts.packed([1, 2, 3, 4, 5]))
    writer.close()
    data = out.getvalue()
    assert [d for d, _, _ in ts.ShardReader(pa.BufferReader(data))] == [1]
    with pytest.raises(Exception):  # noqa: B017
        list(ts.ShardReader(pa.BufferReader(data[:20] + b"\xff\xff" + data[22:])))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_give_back_every_document(spark, planes):
    rows = [(i * 3, t, "x") for i, t in enumerate(TEXTS)] + [(None, "none", ""), (3, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = f"file://{tempfile.mkdtemp()}"
    manifest = ts.write_tokens(docs, path, PATH, planes=planes, block_ids=64, shards=4)
    got = ts.read_tokens(manifest, path).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    want = sorted(((-1 if d is None else d, t or "") for d, t, _ in rows))
    start = 0
    assert len(got) == len(want)
    for r, (d, t) in zip(got, want):
        ids = [*LIBRARY.encode(t, add_special_tokens=False).ids, 0]
        data = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, bytes(r.ids), r.crc) == (None if d < 0 else d, start, data, zlib.crc32(data))
        start += len(ids)


def test_empty_table(spark):
    path = f"file://{tempfile.mkdtemp()}"
    assert ts.read_tokens(ts.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH), path).count() == 0
