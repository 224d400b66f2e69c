"""SimHash near-duplicates by pivot distance tables.

Every fingerprint has a precomputed row of Hamming distances to fixed reference fingerprints. By the
triangle inequality two fingerprints within ``max_bits`` differ by at most ``max_bits`` in every
coordinate; pairs that fail this are discarded unseen, survivors are verified. So that no all-pairs
comparison is needed, pairs meet only where enough of the 64 bits agree: of m segments at most
``max_bits`` can hold a difference, so one of the choices of m - max_bits segments agrees whole. m grows
with the number of fingerprints, which keeps meeting places small; every m finds every link.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import byte_texts, components, key_of
from keepsake.session import settle

SHINGLE = 4
SEED = 42
MAX_BITS = 4
PIVOTS = 16
#: A meeting place with more fingerprints is compared block by block in several tasks.
BLOCK = 8192
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = [len(w) for w in words]
    ends = list(itertools.accumulate(lengths, lambda a, b: a + 1 + b))
    last = max(len(words) - size, 0)
    spans = zip((e - n for e, n in zip(ends, lengths)), ends[min(size, len(words)) - 1:])
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans)
    ones = np.zeros(64, np.int64)
    while len(some := np.fromiter(itertools.islice(hashes, _HASHES_AT_ONCE), np.uint64)):
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last + 1, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in byte_texts(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. Null texts are empty texts."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, fp long")


def _choices(n: int, max_bits: int) -> list[int]:
    """Masks of the bit choices of which one agrees for any link among ``n`` fingerprints."""
    m = max_bits + 1
    while n > 64 * 2 ** (64 * (m - max_bits) / m) and m < 2 * max_bits:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    segments = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(segments, m - max_bits)]


def _signed(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def _references(count: int) -> list[int]:
    rng = random.Random(SEED)
    return [rng.getrandbits(64) for _ in range(count)]


class _Forest:
    """Union-find over the rows of one chunk; keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.parent[a] != self.parent[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((x, y))
        if new.any():
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up


def _linked(place: np.ndarray, side: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links among rows of the same place, sorted by (place, first coordinate)."""
    forest, rows, step = _Forest(len(fp)), np.arange(len(fp)), 0
    while len(rows):
        step += 1
        rows = rows[rows + step < len(fp)]
        met = (place[rows] == place[rows + step]) & (table[rows + step, 0] - table[rows, 0] <= max_bits)
        rows = rows[met]
        near = rows[(side[rows] == 0) | (side[rows] != side[rows + step])]
        for k in range(1, table.shape[1]):
            near = near[np.abs(table[near, k] - table[near + step, k]) <= max_bits]
        # Of a negative number bitwise_count takes the absolute value, so bits are counted unsigned.
        near = near[np.bitwise_count((fp[near] ^ fp[near + step]).view(np.uint64)) <= max_bits]
        if len(near):
            forest.join(near, near + step)
    return forest.links


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def done(parts: list[np.ndarray], whole: bool):
            """Links of the finished places; the last place may go on in the next batch."""
            rows = np.concatenate(parts)
            cut = len(rows) if whole else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            now, rest = rows[:cut], rows[cut:]
            links = _linked(now[:, 0], now[:, 1], now[:, 2], now[:, 3:], max_bits) if cut else []
            a, b = (now[[x[i] for x in links], 2] if links else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]), rest

        for batch in batches:
            fixed = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]]
            table = np.array(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(batch), -1)
            held.append(np.column_stack([*fixed, table]).astype(np.int64))
            count += len(batch)
            if count > 4 * BLOCK:
                out, rest = done(held, False)
                held, count = [rest], len(rest)
                yield out
        if held and sum(map(len, held)):
            yield done(held, True)[0]

    return run


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span every group of fingerprints joined by steps of at most ``max_bits``.

    ``prints`` has distinct fp as long. The distance table is written once. Meeting places larger
    than ``block`` are dealt out as pairs of blocks, so one place is many tasks and stays exact.
    """
    coordinates = [F.bit_count(F.col("fp").bitwiseXOR(_signed(r))).cast("byte") for r in _references(pivots)]
    known = settle(prints.select("fp", F.array(*coordinates).alias("table")), "pivots")
    masks = _choices(known.count(), max_bits)
    places = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(_signed(m))) for i, m in enumerate(masks)])
    met = known.select(F.explode(places).alias("place"), "fp", "table")
    sizes = settle(met.groupBy("place").count().where(F.col("count") > 1), "places")
    met = met.join(sizes, "place")
    parts = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    met = met.select("place", "fp", "table", parts.alias("parts"), own.alias("own"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("place", "fp", "table", "own", F.explode(other).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    met = met.select(F.xxhash64("place", F.least("own", "other"), F.greatest("own", "other")).alias("place"), side.cast("long").alias("side"),
                     "fp", "table")
    near = met.repartition("place").sortWithinPartitions("place", F.col("table")[0])
    return near.mapInArrow(_links(max_bits), "a long, b long")


def _grouped(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints`` (id, fp) with component_id, the smallest id that links of at most ``max_bits`` bits reach."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    reached = components(near_links(nodes.select("fp"), max_bits))
    label = F.coalesce("component", "fp").alias("label")
    nodes = settle(nodes.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", label), "labels")
    best = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(nodes.join(best, "label").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``max_bits`` bits reach, itself included.
    Equal fingerprints are one node, so copies cost one row each. Null and blank texts have fingerprint
    zero and link like any other; repeated rows stay repeated; a null doc_id stays null and never is a
    component_id, which is null only where no member has an id. Other columns are not read.
    """
    found = _grouped(settle(fingerprints(docs, doc_id, text), "prints"), max_bits)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` with one document of each group: the smallest id, repeated rows once.

    All columns stay. Documents that share an id, or have none, are told apart by their text.
    """
    keyed = docs.withColumns({"__llm_key": key_of(F.col(doc_id), F.col(text)), "__llm_tie": F.xxhash64(F.col(text))})
    rows = keyed.select(F.struct("__llm_key", "__llm_tie").alias("id"), F.col(text).alias("text"))
    prints = settle(rows.mapInArrow(_fingerprints, "id struct<__llm_key: long, __llm_tie: long>, fp long"), "prints")
    gone = _grouped(prints, MAX_BITS).where("id <> component_id").select("id.*").distinct()
    names = ["__llm_key", "__llm_tie"]
    return keyed.join(gone, names, "left_anti").dropDuplicates(names).drop(*names)
