"""Suffix-array dedup of repeated passages by prefix-free parsing.

A rolling hash over 24 bytes sets triggers: the least hash within each 100-byte string. The trigger of a
string depends on its bytes alone, and no 100 bytes are without one, so equal strings have equal triggers
at equal places. All strings with one trigger form a phrase, which overlaps its neighbours as the phrases
of a prefix-free parse do: every 100-byte string lies whole in exactly one phrase.

The parse is the list of phrase occurrences in corpus order, the dictionary the different phrases. A
phrase that occurred before is repeated whole. A string can also repeat between different phrases, but
only between phrases with the same trigger bytes; the suffixes of those phrases are put in order (a suffix
array by prefix doubling), and of each run of suffixes with equal first 100 bytes the parse says which is
the earliest. Phrases whose trigger occurs once, the bulk of ordinary text, need no suffixes at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keepsake.llm.common import byte_texts, key_of
from keepsake.session import settle

LENGTH = 100
GRAM = 24
#: Different phrases with one trigger that one task puts in order; beyond, their strings are dealt out singly.
PHRASES_AT_ONCE = 16_384
#: The mark of a text that is removed whole; other marks are the first start, shifted, and the number of starts.
WHOLE = -1
#: String starts parsed at a time, and texts a parsing task remembers so as not to parse copies.
_STARTS_AT_ONCE = 1 << 20
_TEXTS_KEPT = 200_000
_PLACE = np.uint64((1 << 24) - 1)
#: Odd 64-bit multipliers of the rolling hash.
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _grams(text: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes at each position."""
    one = text.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * _MULTIPLIERS[0] + one[1:]
    four = two[:-2] * _MULTIPLIERS[1] + two[2:]
    eight = four[:-4] * _MULTIPLIERS[2] + four[4:]
    both = eight[:-8] * _MULTIPLIERS[3] + eight[8:]
    gram = both[:-8] * _MULTIPLIERS[4] + eight[16:]
    gram ^= gram >> np.uint64(29)
    gram *= _MULTIPLIERS[0]
    return gram ^ gram >> np.uint64(32)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return keys if size == width else np.minimum(keys[:len(keys) - (width - size)], keys[width - size:])


def phrases(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trigger hash, first start, last start) of the phrases of a text, in parts."""
    for begin in range(0, len(text) - LENGTH + 1, _STARTS_AT_ONCE):
        part = np.frombuffer(text, np.uint8, min(len(text) - begin, _STARTS_AT_ONCE + LENGTH - 1), begin)
        grams = _grams(part)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        trigger = _sliding_least(keys, LENGTH - GRAM + 1) & _PLACE
        change = np.flatnonzero(np.diff(trigger)) + 1
        first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(trigger) - 1]])
        yield grams[trigger[first].astype(np.int64)].view(np.int64), first + begin, last + begin


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns.values())), names=list(columns))


def _gathered(parts: Iterator[dict[str, np.ndarray]], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small parts put together, so that a batch is sent for many documents."""
    held: list[dict[str, np.ndarray]] = []
    count = 0

    def out() -> pa.RecordBatch:
        return _batch(**{name: np.concatenate([p[name] for p in held]) for name in held[0]})

    for part in parts:
        held.append(part)
        count += len(part["doc"])
        if count >= rows:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed rows, those marked ``sure`` that repeat a phrase of their own batch.

    They are repeats wherever the phrase's first occurrence lies, so they are dealt by their place, and a
    phrase that a third of all documents share sends one row a batch to its trigger's task.
    """
    for rows in _gathered(_parsed(batches), 200_000):
        gram, phrase, doc, tie, spot = (c.to_numpy() for c in rows.columns)
        order = np.lexsort((spot, tie, doc, phrase, gram))
        again = _repeats(*(c[order] for c in (gram, phrase, doc, tie, spot)))[1]
        sure = np.zeros(len(gram), bool)
        sure[order] = again
        yield _batch(gram=np.where(sure, doc + (spot >> 20), gram), phrase=np.where(sure, 0, phrase), doc=doc, tie=tie, spot=spot, sure=sure)


def _repeats(gram: np.ndarray, phrase: np.ndarray, doc: np.ndarray, tie: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: which are the first of their phrase, and which occur elsewhere than that first."""
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    return new, ~new & ~((doc == doc[start]) & (tie == tie[start]) & (spot == spot[start]))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """(gram, phrase, doc, tie, spot) per phrase; spot is the first start, shifted, and the number of starts."""
    known: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
            if text is None or len(text) < LENGTH:
                continue
            # Of equal texts only the first document's phrases matter: the others are repeated whole.
            name = xxhash.xxh3_128_digest(text)
            if (doc, tie) >= known.get(name, (doc + 1, 0)):
                continue
            if len(known) >= _TEXTS_KEPT:
                known.clear()
            known[name] = (doc, tie)
            for gram, first, last in phrases(text):
                ends = (last + LENGTH).tolist()
                phrase = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), ends)), np.uint64, len(first)).view(np.int64)
                yield {"gram": gram, "phrase": phrase, "doc": np.full(len(gram), doc), "tie": np.full(len(gram), tie, np.int32),
                       "spot": first << 8 | (last - first + 1)}


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, phrase, doc, tie, spot): repeated phrases, without their trigger, and the first
    occurrence of each phrase whose trigger has other phrases too (``kin``). Holds two rows between batches."""
    first: list[np.ndarray] | None = None
    waiting: list[np.ndarray] | None = None
    for batch in batches:
        sure = batch.column(5).to_numpy(zero_copy_only=False)
        if sure.any():
            doc, tie, spot = (batch.column(i).to_numpy()[sure] for i in (2, 3, 4))
            yield _batch(gram=np.zeros(len(doc), np.int64), doc=doc, tie=tie, spot=spot, kin=np.zeros(len(doc), bool))
        columns = [c.to_numpy()[~sure] for c in batch.columns[:5]]
        if not len(columns[0]):
            continue
        carried = int(first is not None)
        if carried:
            columns = [np.concatenate([f, c]) for f, c in zip(first, columns)]
        gram, phrase, doc, tie, spot = columns
        new, again = _repeats(gram, phrase, doc, tie, spot)
        heads = np.flatnonzero(new)
        same = gram[heads[1:]] == gram[heads[:-1]]
        kin = np.zeros(len(heads), bool)
        kin[1:] |= same
        kin[:-1] |= same
        if carried and waiting is None:
            kin[0] = False  # already given out
        given = heads[kin]
        rows = np.concatenate([np.flatnonzero(again), given])
        kind = np.repeat([False, True], [int(again.sum()), len(given)])
        yield _batch(gram=np.where(kind, gram[rows], 0), doc=doc[rows], tie=tie[rows], spot=spot[rows], kin=kind)
        last = heads[-1]
        was_given = bool(kin[-1]) or (carried and waiting is None and len(heads) == 1)
        # A head counts as given out once another phrase of its trigger has been seen.
        first = [c[last:last + 1] for c in columns]
        waiting = None if was_given else first


def _suffix_classes(text: np.ndarray) -> np.ndarray:
    """Rank of the 64 bytes at each position among all positions, by prefix doubling from 8 bytes."""
    padded = np.concatenate([text, np.zeros(64, np.uint8)]).astype(np.uint64)
    packed = np.zeros(len(text) + 56, np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | padded[k:k + len(packed)]
    rank = np.unique(packed, return_inverse=True)[1]
    size = 8
    while size < 64:
        pair = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pair, return_inverse=True)[1]
        size *= 2
    return rank


def _later(doc: np.ndarray, tie: np.ndarray, first: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, number of starts) of runs of strings that also start earlier among these phrases."""
    lengths = np.array([len(s) for s in spans])
    starts = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(spans)), starts)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = inside + (np.cumsum(lengths) - lengths)[row]
    rank = _suffix_classes(np.frombuffer(b"".join(spans), np.uint8))
    pair = rank[place] * (int(rank.max()) + 1) + rank[place + LENGTH - 64]
    begin = first[row] + inside
    order = np.lexsort((begin, tie[row], doc[row], pair))
    later = np.zeros(len(row), bool)
    later[order[1:]] = pair[order[1:]] == pair[order[:-1]]
    at = np.flatnonzero(later)
    if not len(at):
        return at, at, at
    breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0)) + 1
    heads, tails = at[np.concatenate([[0], breaks])], at[np.concatenate([breaks - 1, [len(at) - 1]])]
    return row[heads], begin[heads], tails - heads + 1


def _ordered(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (gram, doc, tie, first), taken up in whole trigger groups."""
        held: list[pa.RecordBatch] = []
        count = 0

        def marks(rows: pa.Table) -> pa.RecordBatch:
            gram, doc, tie, first = (rows.column(i).to_numpy() for i in range(4))
            same = np.zeros(len(gram), bool)
            same[1:] = (gram[1:] == gram[:-1]) & (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (first[1:] == first[:-1])
            keep = np.flatnonzero(~same)
            spans = rows.column(4).take(pa.array(keep)).to_pylist()
            doc, tie, first = doc[keep], tie[keep], first[keep]
            row, begin, starts = _later(doc, tie, first, spans)
            return _batch(doc=doc[row], tie=tie[row], spot=begin << 8 | starts)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= limit:
                rows = pa.Table.from_batches(held).combine_chunks()
                gram = rows.column(0).to_numpy()
                cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
                if cut:
                    yield marks(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), len(rows) - cut
        if count:
            yield marks(pa.Table.from_batches(held).combine_chunks())

    return run


def _listed(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[int, int, bytes, list[dict]]]:
    """Texts with the phrases listed for them, a bounded number at a time."""
    for batch in batches:
        for doc, tie, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2)), batch.column(3).to_pylist()):
            for low in range(0, len(listed), at_once):
                yield doc, tie, text, listed[low:low + at_once]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed phrases."""

    def parts() -> Iterator[dict[str, np.ndarray]]:
        for doc, tie, text, listed in _listed(batches, 4096):
            first = [p["spot"] >> 8 for p in listed]
            spans = [text[p["spot"] >> 8:(p["spot"] >> 8) + (p["spot"] & 255) - 1 + LENGTH] for p in listed]
            yield {"gram": np.array([p["gram"] for p in listed], np.int64), "doc": np.full(len(first), doc), "tie": np.full(len(first), tie, np.int32),
                   "first": np.array(first, np.int64), "span": np.array(spans, object)}

    return _gathered(parts(), 10_000)


def _cut_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each 100-byte string of the listed phrases."""

    def parts() -> Iterator[dict[str, np.ndarray]]:
        for doc, tie, text, listed in _listed(batches, 512):
            begin = [s for p in listed for s in range(p["spot"] >> 8, (p["spot"] >> 8) + (p["spot"] & 255))]
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s:s + LENGTH]) for s in begin), "<i8").reshape(-1, 2)
            yield {"one": names[:, 0], "two": names[:, 1], "doc": np.full(len(begin), doc), "tie": np.full(len(begin), tie, np.int32),
                   "begin": np.array(begin, np.int64)}

    return _gathered(parts())


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for low in range(0, len(batch), 256):
            part = batch.slice(low, 256)
            spans, kept, sizes = [], [], []
            for text, marks, copy in zip(byte_texts(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                text = text or b""
                edge = np.zeros(len(text) + 1, np.int64)
                at = np.array(marks or [], np.int64)
                if copy and len(text) >= LENGTH or (at == WHOLE).any():
                    edge[0], edge[-1] = 1, -1
                elif len(at):
                    np.add.at(edge, at >> 8, 1)
                    np.add.at(edge, (at >> 8) + (at & 255) + LENGTH - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if len(turn) else text)
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases_at_once: int = PHRASES_AT_ONCE) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed, as byte start and end), kept (binary).

    Each byte goes that lies in a 100-byte string which also starts earlier in the corpus: in a document
    with a smaller doc_id, or earlier in the same one. Matches do not cross documents.

    Null texts are empty. Documents that share a doc_id are ordered by a hash of their text, null ids come
    first in the order of their text's hash; a repeated row is a copy of its first. Texts below 100 bytes stay.
    Columns not named are not read.
    """
    key, tie = key_of(F.col(doc_id), F.col(text)), F.shiftrightunsigned(F.xxhash64(F.col(text)), 33).cast("int")
    every_row = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), key.alias("doc"), tie.alias("tie"), F.col(text).alias("text"))
    names = settle(every_row.select("doc", "tie", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"), F.octet_length("text").alias("size")), "names")
    # Only rows that share an id need the hash that orders them.
    shared = settle(names.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("shared")), "shared")

    def tied(some: DataFrame) -> DataFrame:
        return some.join(shared, "doc", "left").withColumn("tie", F.when(F.col("shared"), F.col("tie")).otherwise(F.lit(0))).drop("shared")

    rows, names = tied(every_row), tied(names)
    earliest = names.groupBy("one", "two").agg(F.min(F.struct("doc", "tie")).alias("least"))
    copies = names.join(earliest, ["one", "two"]).where((F.col("size") >= LENGTH) & (F.struct("doc", "tie") != F.col("least")))
    copies = copies.select("doc", "tie", F.lit(WHOLE).cast("bigint").alias("spot")).distinct()

    parsed = rows.select("doc", "tie", "text").mapInArrow(_parse, "gram long, phrase long, doc long, tie int, spot long, sure boolean")
    parsed = parsed.repartition("gram").sortWithinPartitions("gram", "phrase", "doc", "tie", "spot")
    found = settle(parsed.mapInArrow(_sorted_out, "gram long, doc long, tie int, spot long, kin boolean"), "found")
    whole = found.where("NOT kin").select("doc", "tie", "spot")

    kin = found.where("kin")
    hot = settle(kin.groupBy("gram").count().where(F.col("count") > phrases_at_once), "hot")
    rare, marks = kin.join(hot, "gram", "left_anti"), [copies, whole]

    def texts_of(some: DataFrame) -> DataFrame:
        listed = some.groupBy("doc", "tie").agg(F.collect_list(F.struct("gram", "spot")).alias("listed"))
        return rows.select("doc", "tie", "text").join(listed, ["doc", "tie"])

    spans = texts_of(rare).mapInArrow(_cut_out, "gram long, doc long, tie int, first long, span binary")
    spans = spans.repartition("gram").sortWithinPartitions("gram", "doc", "tie", "first")
    marks.append(spans.mapInArrow(_ordered(phrases_at_once), "doc long, tie int, spot long"))
    if not hot.isEmpty():
        strings = settle(texts_of(kin.join(hot.select("gram"), "gram")).mapInArrow(_cut_single, "one long, two long, doc long, tie int, begin long"), "strings")
        least = strings.groupBy("one", "two").agg(F.min(F.struct("doc", "tie", "begin")).alias("least"))
        later = strings.join(least, ["one", "two"]).where(F.struct("doc", "tie", "begin") != F.col("least"))
        marks.append(later.select("doc", "tie", F.shiftleft("begin", 8).bitwiseOR(F.lit(1)).alias("spot")))
    every = marks[0]
    for more in marks[1:]:
        every = every.union(more)
    every = settle(every.groupBy("doc", "tie").agg(F.collect_list("spot").alias("marks")), "marks")
    again = F.lit(False)
    if not shared.isEmpty():
        again = F.row_number().over(W.partitionBy("doc", "tie").orderBy("doc_id")) > 1
    whole_rows = rows.withColumn("again", again).join(every, ["doc", "tie"], "left")
    return whole_rows.select("doc_id", "text", "marks", "again").mapInArrow(
        _remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
