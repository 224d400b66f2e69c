"""Token ids as binary files whose document boundaries are Elias-Fano encoded.

A file holds the ids of many documents in a row, two or four bytes each, then an index of three parts per
sequence (low bits, unary high bits, select samples) for the documents' ends and for their ids, then a
footer. A document's offsets come out of select on the high bits, so no table of 64-bit numbers is kept:
n ends below u take about 2 + log2(u / n) bits each. ``Shard`` reads single documents or runs of them by
position without reading the rest of the file.

    magic | ids | ends: low, high, samples | doc ids: low, high, samples | footer | magic
"""

from __future__ import annotations

import array
import json
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.common import byte_texts
from keepsake.llm.packing import END_ID, TOKENIZER, WordIds
from keepsake.session import fresh_path
from keepsake.sources.storage import open_path, qualified

__all__ = ["EliasFano", "Shard", "TOKENIZER", "read", "write"]

MAGIC = b"KEEPIDS1"
#: One select sample for so many values: what has to be scanned to find one of them.
STEP = 256
#: Bytes of text whose ids go to one file, give or take chance; a larger number suits larger corpora.
SHARD_BYTES = 1 << 24
#: Files whose offsets are summed up in one group.
_BLOCK_SHARDS = 1 << 10
_IDS_AT_ONCE = 1 << 20
_KNOWN_WORDS = 500_000
#: id width, documents, documents without id, ids, least doc id, then (low width, bits of high) of ends and of doc ids, and a checksum of the index
_FOOTER = "<QQQQqQQQQI"
_FOOTER_SIZE = struct.calcsize(_FOOTER)
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def _pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of ``width`` bits each, one after the other, lowest bit first."""
    if not width:
        return b""
    out = []
    for at in range(0, len(values), 1 << 15):
        some = np.ascontiguousarray(values[at:at + (1 << 15)], "<u8")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def _unpack(data: bytes, skip: int, width: int, count: int) -> np.ndarray:
    """``count`` numbers of ``width`` bits after ``skip`` bits of ``data``."""
    if not width or not count:
        return np.zeros(count, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip:skip + width * count].reshape(count, width)
    whole = np.zeros((count, 64), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel()


def _bytes(bits: int) -> int:
    return (bits + 7) // 8


class EliasFano:
    """``n`` unsigned numbers that never fall, in about 2 + log2(largest / n) bits each, with select.

    ``read(offset, size)`` gives bytes of the encoded part; only those that a call needs are read.
    """

    def __init__(self, read, n: int, low_width: int, high_bits: int, at: int = 0) -> None:
        self.n, self.low_width, self.high_bits = n, low_width, high_bits
        self._read, self._low = read, at
        self._high = at + _bytes(n * low_width)
        self._samples = self._high + _bytes(high_bits)
        self.sample_width = max(high_bits, 1).bit_length()
        self.size = self._samples + _bytes(-(-n // STEP) * self.sample_width) - at

    @staticmethod
    def encode(values: np.ndarray) -> tuple[bytes, int, int]:
        """(bytes, width of the low bits, number of high bits)."""
        n = len(values)
        if not n:
            return b"", 0, 0
        values = np.asarray(values, np.uint64)
        width = max(((int(values[-1]) + 1) // n).bit_length() - 1, 0)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high_bits = int(ones[-1]) + 1
        high = np.zeros(high_bits, np.uint8)
        high[ones] = 1
        samples = _pack(ones[::STEP].astype(np.uint64), high_bits.bit_length())
        return _pack(values & np.uint64((1 << width) - 1), width) + np.packbits(high, bitorder="little").tobytes() + samples, width, high_bits

    def _sample(self, i: int) -> int:
        """Where in the high bits the first value of block ``i`` stands; their end after the last block."""
        if i * STEP >= self.n:
            return self.high_bits
        first = i * self.sample_width
        data = self._read(self._samples + first // 8, _bytes(first % 8 + self.sample_width))
        return int(_unpack(data, first % 8, self.sample_width, 1)[0])

    def block(self, i: int) -> np.ndarray:
        """Values ``i * STEP`` up to the next block, by select from the block's sample."""
        count = min(STEP, self.n - i * STEP)
        start, stop = self._sample(i), self._sample(i + 1)
        bits = np.unpackbits(np.frombuffer(self._read(self._high + start // 8, _bytes(start % 8 + stop - start)), np.uint8), bitorder="little")
        ones = np.flatnonzero(bits[start % 8:][:stop - start])[:count] + start
        high = (ones - np.arange(i * STEP, i * STEP + count)).astype(np.uint64)
        first = i * STEP * self.low_width
        low = _unpack(self._read(self._low + first // 8, _bytes(first % 8 + self.low_width * count)), first % 8, self.low_width, count)
        return high << np.uint64(self.low_width) | low

    def select(self, i: int) -> int:
        """The ``i``-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // STEP)[i % STEP])


class Shard:
    """One file of token ids: documents by position, read where they stand."""

    def __init__(self, file) -> None:
        self._file = file
        end = file.size()
        tail = file.read_at(_FOOTER_SIZE + len(MAGIC), end - _FOOTER_SIZE - len(MAGIC))
        if tail[_FOOTER_SIZE:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a file of token ids")
        (self.width, self.n_docs, self.n_null, self.n_ids, self._least, ends_low, ends_high, docs_low, docs_high, crc) = struct.unpack(_FOOTER, tail[:_FOOTER_SIZE])
        start = len(MAGIC) + self.width * self.n_ids
        self.ends = EliasFano(self._at, self.n_docs, ends_low, ends_high, start)
        self.docs = EliasFano(self._at, self.n_docs - self.n_null, docs_low, docs_high, start + self.ends.size)
        self.index_bytes = self.ends.size + self.docs.size
        if start + self.index_bytes + len(tail) != end:
            raise ValueError("the file of token ids is cut short")
        self._crc, self._index_start = crc, start

    def _at(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def check(self) -> None:
        """Raises if the index is not what was written."""
        if zlib.crc32(self._at(self._index_start, self.index_bytes)) != self._crc:
            raise ValueError("the index of the file of token ids is damaged")

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` begins and ends among the file's ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, start: int, stop: int) -> np.ndarray:
        data = self._at(len(MAGIC) + self.width * start, self.width * (stop - start))
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.span(i))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.docs.select(i - self.n_null) + self._least

    def find(self, doc_id: int) -> list[int]:
        """Positions of the documents of an id, by halving."""
        low, high = self.n_null, self.n_docs
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.doc_id(middle) < doc_id else (low, middle)
        found = []
        while low < self.n_docs and self.doc_id(low) == doc_id:
            found.append(low)
            low += 1
        return found

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start, number of ids, checksum of the ids) of every document in order, a block at a time."""
        start, held = 0, np.zeros(0, np.uint64)
        taken = 0
        for block in range(-(-self.n_docs // STEP)):
            ends = self.ends.block(block).astype(np.int64).tolist()
            for i, end in enumerate(ends, block * STEP):
                if i >= self.n_null and taken == len(held):
                    held, taken = self.docs.block((i - self.n_null) // STEP), 0
                if i < self.n_null:
                    doc = None
                else:
                    doc, taken = int(held[taken]) + self._least, taken + 1
                crc = 0
                for at in range(start, end, _IDS_AT_ONCE):
                    crc = zlib.crc32(self._run(at, min(at + _IDS_AT_ONCE, end)), crc)
                yield doc, start, end - start, crc
                start = end

    def _run(self, start: int, stop: int) -> memoryview:
        """Ids as little-endian 32-bit numbers; short documents share one read of the file."""
        first, data = getattr(self, "_held", (0, np.zeros(0, "<u4")))
        if not first <= start <= stop <= first + len(data):
            first, data = start, self.ids(start, min(max(stop, start + _IDS_AT_ONCE), self.n_ids))
            self._held = first, data
        return memoryview(data[start - first:stop - first]).cast("B")


class _Writer:
    """One file, written from front to back; only lengths and doc ids are held."""

    def __init__(self, stream, width: int) -> None:
        self.stream, self.width, self.n_ids, self.n_null = stream, width, 0, 0
        self.lengths, self.docs = array.array("q"), array.array("q")
        stream.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """Documents come in ascending order of their id, those without one first."""
        self.stream.write((ids if self.width == 4 else ids.astype(f"<u{self.width}")).tobytes())
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        if doc is None:
            self.n_null += 1
        else:
            self.docs.append(doc)

    def close(self) -> int:
        lengths, docs = np.array(self.lengths, np.int64), np.array(self.docs, np.int64)
        least = int(docs[0]) if len(docs) else 0
        ends, ends_low, ends_high = EliasFano.encode(np.cumsum(lengths))
        found, docs_low, docs_high = EliasFano.encode(docs.view(np.uint64) - np.array([least]).view(np.uint64))
        index = ends + found
        self.stream.write(index)
        self.stream.write(struct.pack(_FOOTER, self.width, len(lengths), self.n_null, self.n_ids, least, ends_low, ends_high, docs_low, docs_high, zlib.crc32(index)) + MAGIC)
        self.stream.close()
        return len(lengths)


class _Ids(WordIds):
    """Words of plain ASCII letters go to the merges as they are, marks after them are looked up by themselves."""

    _MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.number = self.ids.tolist()

    @classmethod
    def of(cls, path: str) -> _Ids:
        """The encoder of this worker process: words met in one task are known in the next."""
        kept = sys.modules.setdefault("_keepsake_encoders", types.ModuleType("_keepsake_encoders")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def __missing__(self, word: bytes) -> bytes:
        bare = word.rstrip(self._MARKS)
        if not (bare.isalpha() and bare.islower()):
            return super().__missing__(word)
        if len(bare) < len(word):
            return self[bare] + self[word[len(bare):]]
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        number = self.number
        self[word] = found = array.array("I", [number[i] for i in self.merge(word + b"\xff")]).tobytes()
        return found


def _written(folder: str, before: str, tokenizer: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, writer, path = TaskContext.get().partitionId(), None, None, None
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                # Each attempt has a file of its own; the manifest names the one that counts.
                path = f"{folder}/ids-{shard:08d}-{uuid.uuid4().hex[:12]}.kids"
                system, inner = open_path(path, before)
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                encoder, writer = _Ids.of(tokenizer), _Writer(system.open_output_stream(inner), width)
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                writer.add(doc, np.frombuffer(encoder.encode(text or b"") + last, "<u4"))
        if writer is not None:
            n_docs = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())],
                                             names=["shard", "path", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, shard_bytes: int = SHARD_BYTES, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, end it with ``end_id`` and write the ids in ascending order of doc_id below ``folder``.

    Returns the manifest (shard, path, n_docs, n_ids), one row per file, kept as Parquet in
    ``folder/manifest``; only files that it names count, so an attempt that was lost leaves no trace in
    the result. Texts are dealt out by ranges of doc_id once; the task that has them in order encodes them
    and writes ids, in as few bytes as the vocabulary allows, document by document. It holds lengths and doc
    ids only.

    Null ids come first. A null text is empty: its document is the end id alone. Rows that share an id are
    ordered by a hash of their text; repeated rows all stay, and however many rows share an id, they spread
    over files. An empty table writes no file. Other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        known = json.load(file)
    largest = max([end_id, *known["model"]["vocab"].values(), *(t["id"] for t in known.get("added_tokens", []))])
    width = 2 if largest < 1 << 16 else 4
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    # Equal rows hold equal ids, so any order among them is the same; the row number deals them out.
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *order).sortWithinPartitions(*order)
    before = qualified(spark, [folder])[folder.rstrip("/")]
    written = dealt.select("doc_id", "text").mapInArrow(_written(folder.rstrip("/"), before, tokenizer, width, end_id), MANIFEST)
    written.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _placed(manifest: DataFrame) -> DataFrame:
    """The manifest with base, the ids in all files before; sums of blocks of files come first."""
    block = F.shiftright("shard", _BLOCK_SHARDS.bit_length() - 1).alias("block")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for a thousand files.
    blocks = manifest.groupBy(block).agg(F.sum("n_ids").alias("ids")).select("block", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", block).withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(blocks, "block").select(
        "shard", "path", (F.col("earlier") + F.col("inside")).alias("base"))


def _read(before: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = open_path(path, before)
                with system.open_input_file(inner) as file:
                    shard = Shard(file)
                    shard.check()
                    out: list[tuple] = []
                    for doc, start, n, crc in shard.documents():
                        out.append((doc, base + start, n, crc))
                        if len(out) == 1 << 14:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files below ``folder``: doc_id, start (ids of all documents before it),
    n_tokens (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit numbers).

    Everything comes out of the files: offsets by select, ids by offset. A file whose index is not whole raises.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = qualified(spark, [folder])[folder.rstrip("/")]
    placed = _placed(manifest)
    spread = placed.repartitionByRange(max(manifest.count(), 1), "shard").select("path", "base")
    return spread.mapInArrow(_read(before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``write`` into a fresh folder of the workspace, and ``read`` of what lies there."""
    folder = fresh_path(docs.sparkSession, "token-shards")
    write(docs, tokenizer, folder, shard_bytes)
    return read(docs.sparkSession, folder)
