"""Packing documents into fixed-length sequences: first-fit decreasing on a tournament tree of bins."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import byte_texts
from keepsake.session import settle

CAPACITY = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Pieces that one group holds on average; groups are packed independently.
GROUP_PIECES = 8192
_KNOWN_WORDS = 300_000
_ROW_TOKENS = 1 << 20


class WordIds(dict):
    """Ids of a text as little-endian 32-bit numbers, put together from the ids of its words.

    The tokenizer drops white space and never joins across it, so words are encoded once and kept, up
    to ``_KNOWN_WORDS``. Plain Latin words go to the merges of the same file through tiktoken, which
    gives the same ids sooner; all other words go to the tokenizer itself.
    """

    _PLAIN = re.compile("[a-zß-öø-ɏ]+")
    _SPLIT = re.compile(rb"([^!-/:-@\[-`{-~]*[a-z])([!-&(-/:-@\[-`{-~]+)")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        shown = _byte_letters()
        end = model["end_of_word_suffix"]

        def raw(symbol: str) -> bytes:
            body = symbol.removesuffix(end)
            return bytes(shown[c] for c in body) + b"\xff" * (body != symbol)

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        numbers = {raw(s): i for s, i in model["vocab"].items()}
        self.ids = np.array([numbers.get(b, 0) for b in ranks], "<u4")
        self.merge = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        if self._PLAIN.fullmatch(low := word.decode().lower()):
            found = self.ids[self.merge(low.encode() + b"\xff")].tobytes()
        elif parts := self._SPLIT.fullmatch(word):
            # A letter and a following mark never share a piece.
            found = self[parts[1]] + self[parts[2]]
        else:
            found = np.array(self.whole.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        # Special tokens are matched with their case, so such texts keep it.
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                            ("doc_tokens", pa.int64()), *([("ids", pa.binary())] if keep_ids else [])])
        out: list[tuple] = []
        held = 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                ids = encoder.encode(text or b"") + np.array([END_ID], "<u4").tobytes()
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total) + ((piece,) if keep_ids else ()))
                held += total
                if held >= _ROW_TOKENS:
                    yield block()
                    out.clear()
                    held = 0
        yield block()

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bin, offset): pieces from longest to shortest, each in the first bin with room.

    The bins are leaves of a tournament tree that knows the most room below each node, so the first fit
    is one walk down. Pieces as long as a bin take their own without a walk.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    full = int((sizes >= capacity).sum())
    leaves = 1 << max(int(len(sizes) - full - 1), 0).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    for at in range(full, len(sizes)):
        size, node = int(sizes[at]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[at], offsets[at] = full + node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return order, bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 42, doc_id: str = "doc_id",
         text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids, with id 2 at its end, are cut every ``capacity``; the pieces are dealt at random
    into groups of about ``group_pieces``, and each group is packed by first-fit decreasing. A group is
    one task's work whatever the documents are, so no source, id or length can make it larger.

    A null text is empty: one piece holding id 2. Repeated rows and null ids are packed like any other.
    ``ids`` (with ``keep_ids``) are little-endian 32-bit numbers; ``sequences`` puts them together.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")
    pieces = settle(rows.mapInArrow(_pieces(tokenizer, capacity, keep_ids), columns), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    dealt = settle(pieces.select("*", F.monotonically_increasing_id().alias("piece")), "dealt")
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece")
        order, bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group = group.iloc[order]
        return group.assign(sequence_id=group["pack"] * (1 << 32) + bins, offset=offsets).drop(columns=["piece", "pack"])

    return dealt.groupBy("pack").applyInPandas(fit, columns + ", sequence_id long, offset long")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the padded ids of each sequence; one as long as a power of two stays so."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(group.sort_values("offset")["ids"])
        n = len(ids) // 4
        pad = 0 if n & (n - 1) == 0 else capacity - n
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "length": [n], "ids": [ids + np.full(pad, pad_id, "<u4").tobytes()]})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(join, "sequence_id long, length long, ids binary")
