"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Every word has a sparse random index vector; a word's vector is the sum of the index vectors of the
words beside it, over the whole corpus. Words share ``BUCKETS`` hashed places, so the table of vectors has
the same size whatever the corpus holds. A document is pooled into the mean and spread of its words'
vectors and how alike neighbours are; a small network, written in numpy, scores it, and one temperature
makes its probabilities fit rows it was not trained on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import byte_texts, training_rows
from keepsake.session import settle

BUCKETS, DIM = 1 << 14, 32
#: Places of an index vector that are not zero, and how far the words beside a word reach.
NONZERO, REACH = 4, 2
#: Most training rows of each label.
MAX_PER_LABEL = 10_000
HIDDEN, EPOCHS, RATE, BATCH = 32, 60, 0.003, 64
_BLOCK = 256
_TOKENS_AT_ONCE = 100_000
_KNOWN_WORDS = 300_000
#: Bucket of what stands between documents.
_GAP = BUCKETS
_SEED = 42


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word) % BUCKETS
        return found


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    out = np.zeros((BUCKETS + 1, DIM), np.float32)
    places = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], places] = rng.choice([-1, 1], (BUCKETS, NONZERO))
    return out


def _chunks(texts: list[bytes | None], buckets: _Buckets) -> Iterator[np.ndarray]:
    """Buckets of the words of many texts, gaps around each text, about ``_TOKENS_AT_ONCE`` at a time.

    A chunk's first and last ``REACH`` words only stand beside the others: the next chunk begins before them.
    """
    held = [_GAP] * REACH
    for text in texts:
        held += map(buckets.__getitem__, (text or b"").split())
        held += [_GAP] * REACH
        while len(held) >= _TOKENS_AT_ONCE + 2 * REACH:
            yield np.array(held[:_TOKENS_AT_ONCE + 2 * REACH], np.int64)
            del held[:_TOKENS_AT_ONCE]
    yield np.array(held, np.int64)


def _sum_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, sums): this task's word vectors, blocks of them as 64-bit floats that hold whole numbers."""
    index, buckets = _index_vectors(), _Buckets()
    total = np.zeros((BUCKETS + 1, DIM), np.float64)
    for batch in batches:
        for ids in _chunks(byte_texts(batch.column(0)), buckets):
            own, n = ids[REACH:-REACH], len(ids) - 2 * REACH
            if n <= 0:
                continue
            beside = np.zeros((n, DIM), np.float32)
            for step in [*range(-REACH, 0), *range(1, REACH + 1)]:
                beside += index[ids[REACH + step:REACH + step + n]]
            order = np.argsort(own, kind="stable")
            heads = np.flatnonzero(np.diff(own[order], prepend=-1))
            total[own[order][heads]] += np.add.reduceat(beside[order], heads)
    total = total[:BUCKETS]
    for block in range(BUCKETS // _BLOCK):
        part = total[block * _BLOCK:(block + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], names=["block", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block, one block's table in memory per block of the partition."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(sums, np.float64)
            held[block] = held[block] + part if block in held else part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all buckets, from every text of ``docs``. The table's size is fixed by BUCKETS and DIM."""
    sums = docs.select(text).mapInArrow(_sum_neighbours, "block long, sums binary")
    sums = sums.repartition("block").mapInArrow(_add_up, "block long, sums binary")
    out = np.zeros((BUCKETS + 1, DIM))
    for r in sums.collect():
        out[r["block"] * _BLOCK:(r["block"] + 1) * _BLOCK] = np.frombuffer(r["sums"], np.float64).reshape(_BLOCK, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size == 0, 1, size)).astype(np.float32)


FEATURES = 2 * DIM + 4


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of one text from its words' buckets: mean and spread of the vectors, log length, length of
    the mean, mean cosine of neighbours, share of different buckets. Without words all are 0."""
    out = np.zeros(FEATURES)
    if not len(ids):
        return out
    total, squares, alike = np.zeros(DIM), np.zeros(DIM), 0.0
    for low in range(0, len(ids), _TOKENS_AT_ONCE):
        rows = vectors[ids[low:low + _TOKENS_AT_ONCE + 1]]
        own = rows[:_TOKENS_AT_ONCE]
        total += own.sum(0, dtype=np.float64)
        squares += np.einsum("ij,ij->j", own, own, dtype=np.float64)
        alike += float(np.einsum("ij,ij->", rows[:-1], rows[1:], dtype=np.float64))
    n = len(ids)
    mean = total / n
    out[:DIM], out[DIM:2 * DIM] = mean, np.sqrt(np.maximum(squares / n - mean**2, 0))
    out[2 * DIM:] = np.log1p(n), np.linalg.norm(mean), alike / max(n - 1, 1), len(np.unique(ids)) / n
    return out


@dataclass(frozen=True)
class Network:
    """Two layers over standardised features; ``temperature`` divides the last layer's output."""

    middle: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(np.clip((x - self.middle) / self.spread, -8, 8) @ a + b, 0) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Adam on four fifths of the rows, temperature on the last."""
    rng = np.random.default_rng(_SEED)
    order = rng.permutation(len(x))
    test, fit = order[:len(x) // 5], order[len(x) // 5:]
    middle, spread = x[fit].mean(0), x[fit].std(0) + 1e-6
    layers = [rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN),
              np.zeros(1)]
    moved, squared, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    inputs, share = np.clip((x - middle) / spread, -8, 8), weight / weight.mean()
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            step += 1
            hidden = np.maximum(inputs[rows] @ layers[0] + layers[1], 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -30, 30)))
            error = share[rows] * (p - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (hidden > 0)
            slopes = [inputs[rows].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
            for i, slope in enumerate(slopes):
                moved[i] = 0.9 * moved[i] + 0.1 * slope
                squared[i] = 0.999 * squared[i] + 0.001 * slope**2
                layers[i] = layers[i] - RATE * (moved[i] / (1 - 0.9**step)) / (np.sqrt(squared[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(middle, spread, tuple(layers))
    if not len(test):
        return net
    logits = net.logits(x[test])

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -30, 30))), 1e-9, 1 - 1e-9)
        return float(-(share[test] * (y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p))).mean())

    return Network(middle, spread, net.layers, min(np.geomspace(0.25, 8, 60), key=loss))


def _pool(vectors: np.ndarray, net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            texts = byte_texts(batch.column(1))
            x = np.array([pooled(np.fromiter(map(buckets.__getitem__, (t or b"").split()), np.int64), vectors) for t in texts]).reshape(len(batch), FEATURES)
            if net is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "features"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(x))], names=["doc_id", "score"])

    return run


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_PER_LABEL,
          threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, predicted.

    Word vectors come from all texts; the network from at most about ``most`` labelled rows of each label
    outside the held-out fifth, weighted so that both labels keep their shares. Null, empty and blank
    texts have no words and get the score of all features 0; repeated rows score alike; null ids are never
    training rows. Without rows of both labels every score is the share of label 1, or 1 without any.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = training_rows(labels, label, most)
    vectors = word_vectors(rows)
    chosen = rows.join(F.broadcast(known), "doc_id")
    found = settle(chosen.select("doc_id", "text").distinct().mapInArrow(_pool(vectors, None), "doc_id long, features array<double>"), "features")
    found = found.join(F.broadcast(known), "doc_id").orderBy("doc_id", "y").collect()
    y = np.array([r["y"] for r in found], float)
    if len(set(y.tolist())) < 2:
        level = float(y.mean()) if len(y) else 1.0
        return rows.select("doc_id", F.lit(level).alias("score"), F.lit(int(level >= threshold)).alias("predicted"))
    net = train(np.array([r["features"] for r in found], float), y, np.array([r["weight"] for r in found], float))
    scored = rows.mapInArrow(_pool(vectors, net), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
