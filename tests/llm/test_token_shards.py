"""Token files against the tokenizer itself, and the encoding of offsets against plain arrays."""

import io
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keepsake.llm import queries, token_shards
from keepsake.llm.token_shards import STEP, EliasFano, Shard

PATH = public_tokenizers.path(token_shards.TOKENIZER)
SCHEMA = "doc_id long, text string, n long, ids string, shard string"


def encoded(values):
    data, width, high = EliasFano.encode(np.array(values, np.uint64))
    return data, EliasFano(lambda at, size: data[at:at + size], len(values), width, high)


@pytest.mark.parametrize("n,largest", [(1, 0), (1, 2**63), (2, 1), (255, 255), (256, 10**6), (257, 2**40), (5000, 5000), (5000, 3), (3000, 2**64 - 1), (70000, 10**9)])
def test_select_gives_every_value(n, largest):
    rng = random.Random(n)
    values = sorted(rng.randint(0, largest) for _ in range(n - 1)) + [largest]
    data, found = encoded(values)
    assert found.size == len(data)
    assert [int(x) for i in range(-(-n // STEP)) for x in found.block(i)] == values
    for i in {0, n - 1, n // 2, min(n - 1, STEP), *(rng.randrange(n) for _ in range(20))}:
        assert found.select(i) == values[i]
    with pytest.raises(IndexError):
        found.select(n)
    if n >= 5000:
        # Two bits for each value beside its low bits, and the samples.
        assert 8 * len(data) <= n * (2.3 + max(math.log2((largest + 1) / n), 0)) + 64


def test_only_needed_bytes_are_read():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    data, width, high = EliasFano.encode(values)
    read = []
    found = EliasFano(lambda at, size: read.append(size) or data[at:at + size], len(values), width, high)
    assert found.select(77_777) == values[77_777]
    assert sum(read) < 1000 < len(data)


def slow(inputs):
    tokenizer = Tokenizer.from_file(PATH)
    start = 0
    for doc, text in sorted(inputs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_the_table(spark, sf_dir):
    inputs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op11_token_shards(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(slow(inputs))


@pytest.mark.parametrize("shard_bytes", [1000, 1 << 22])
def test_odd_documents(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_shards, "_IDS_AT_ONCE", 700)
    monkeypatch.setattr(token_shards, "_BLOCK_SHARDS", 2)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Straße", "naïve", "x9", "漢字", "word!", "<|endoftext|>", "a b"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    inputs = [*((rng.randint(-2**62, 2**62), t) for t in texts), (5, None), (6, ""), (7, " \n\t "), (8, "long word " * 3000), (-1, "ends here<|endoftext|>")]
    inputs += [(2**63 - 1, "largest"), (-2**63, "least")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in inputs], SCHEMA)
    got = token_shards.round_trip(df, PATH, shard_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(slow(inputs))


def test_rows_that_share_an_id(spark):
    """Null ids first; equal rows all stay and spread over files; places have no gaps."""
    inputs = [(None, "b b b"), (None, "a"), (None, None), (3, "same text here"), (3, "other"), (1, "first")] + [(2, "copy of copies")] * 400
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in inputs], SCHEMA)
    folder = token_shards.fresh_path(spark, "test-shards")
    manifest = token_shards.write(df, PATH, folder, 1000).collect()
    got = sorted(token_shards.read(spark, folder).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, *(lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())))(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in inputs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in inputs if d is not None)
    ends = 0
    for r in got:
        assert r.start == ends
        ends += r.n_tokens
    assert len(manifest) > 4 and max(r.n_docs for r in manifest) < len(inputs) / 2
    assert token_shards.round_trip(df.limit(0), PATH).collect() == []


def test_single_documents_by_position_and_id(spark, tmp_path):
    texts = [(i * 3, f"document number {i} " * (i % 7)) for i in range(600)] + [(None, "no id")]
    token_shards.write(spark.createDataFrame(texts, "doc_id long, text string"), PATH, str(tmp_path / "out"))
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".kids"]
    assert len(files) == 1
    tokenizer = Tokenizer.from_file(PATH)
    with pa.fs.LocalFileSystem().open_input_file(str(files[0])) as file:
        shard = Shard(file)
        assert (shard.n_docs, shard.n_null, shard.width, shard.doc_id(0)) == (601, 1, 2, None)
        for i in (0, 1, 255, 256, 599):
            position, = shard.find(3 * i)
            assert position == i + 1 and shard.doc_id(position) == 3 * i
            assert shard.document(position).tolist() == [*tokenizer.encode(texts[i][1], add_special_tokens=False).ids, 2]
        assert shard.find(4) == []
        # Both offsets and ids of documents in less than three bytes together.
        assert shard.index_bytes < 3 * shard.n_docs
    whole = files[0].read_bytes()
    with pytest.raises(ValueError):
        Shard(pa.PythonFile(io.BytesIO(whole[:-1]), "r"))
    broken = bytearray(whole)
    broken[8 + 2 * shard.n_ids + 5] ^= 1
    (tmp_path / "broken").write_bytes(broken)
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "broken")) as file, pytest.raises(ValueError):
        Shard(file).check()


def test_files_no_manifest_names_do_not_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    folder = str(tmp_path / "out")
    token_shards.write(df, PATH, folder)
    (tmp_path / "out" / "ids-00000000-lost.kids").write_bytes(b"half a file")
    assert token_shards.read(spark, folder).count() == 2
    assert token_shards.read(spark, folder).agg(F.max("start")).first()[0] == 2
