"""Toxicity by compression distance: how much shorter does a window get beside toxic text?

Two zstandard dictionaries are trained on the labelled texts themselves, each different sample once: one on
windows of ordinary texts, one on the runs of toxic texts around words that mark them. Most of a toxic text
is ordinary prose, which both dictionaries would share; a word marks toxic text where it has far more
contexts in toxic texts than its rate in ordinary ones explains. Each window of a few words is compressed
beside the ordinary dictionary and beside both; the bytes saved by the toxic one are the window's gain.
A logistic model, fitted on labelled texts that trained no dictionary, turns the gains of a text into a
probability, so that 0.5 is a calibrated threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import byte_texts, logistic, training_rows, words
from keepsake.session import settle

#: Most training rows of each label.
MAX_PER_LABEL = 6_000
WINDOW_WORDS = 8
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 2_048
#: Most samples that train a dictionary, chosen by a hash of their text.
MAX_SAMPLES = 60_000
#: Lengths of the segments and of the strings counted in them that a dictionary is put together from.
SEGMENT, COUNTED = 16, 6
#: Evidence is counted for words and for their beginnings of this many characters.
STEM = 5
#: A marking word is this many standard deviations and this log odds over the contexts expected at its rate in ordinary text.
LEAST_Z, LEAST_ODDS, LEAST_CONTEXTS = 6.0, 1.5, 4
_STEPS = (1, 2, 3, 4, 6)


def _dictionary(samples: DataFrame, size: int) -> bytes:
    """A dictionary trained on the texts in column ``sample``, each different one once."""
    chosen = samples.select("sample").distinct().orderBy(F.xxhash64("sample"), "sample").limit(MAX_SAMPLES)
    texts = [r["sample"].encode() for r in chosen.collect()]
    try:
        return zstandard.train_dictionary(size, texts, k=SEGMENT, d=COUNTED).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return b"".join(texts)[:size]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=17, chain_log=17, search_log=4, target_length=32, min_match=6,
        write_content_size=0, write_checksum=0, write_dict_id=0)
    beside = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    beside.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=beside, compression_params=settings)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    middle: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def gains(self):
        """A function from a text to the gains of its windows."""
        both, plain = _compressor(self.toxic + self.ordinary), _compressor(self.ordinary)

        def run(text: bytes) -> np.ndarray:
            found = text.lower().split()
            windows = (b" " + b" ".join(found[i:i + WINDOW_WORDS]) + b" " for i in range(0, len(found), WINDOW_WORDS))
            return np.fromiter((len(plain.compress(w)) - len(both.compress(w)) for w in windows), np.float64)

        return run

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        x = (features - np.array(self.middle)) / np.array(self.spread)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _features(gains: np.ndarray) -> list[float]:
    """What the windows of a text gain; a text without words has one window that gains nothing."""
    d = gains if len(gains) else np.zeros(1)
    top = np.sort(d)[-3:]
    return [*(float(np.log1p((d >= s).sum())) for s in _STEPS), float(top[-1]), float(top.mean()), float(np.maximum(d - 1, 0).mean()), float((d >= 2).mean()),
            float((d >= 4).mean()), float(np.log(len(d))), float(d.mean())]


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for batch in batches:
            found = [gains(t or b"") for t in byte_texts(batch.column(1))]
            features = np.array([_features(g) for g in found]).reshape(len(batch), len(_STEPS) + 7)
            worst = [int(g.argmax()) if len(g) else 0 for g in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(features.tolist(), pa.list_(pa.float64())), pa.array(model.score(features)), pa.array(worst, pa.int64()),
                 pa.array([float(g.max()) if len(g) else 0.0 for g in found])], names=["doc_id", "features", "score", "worst_window", "worst_gain"])

    return run


_MEASURED = "doc_id long, features array<double>, score double, worst_window long, worst_gain double"


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _joined(run: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(run, " "), F.lit(" "))


def _marks(t: Column, o: Column, all_t: int, all_o: int) -> Column:
    """Whether a word with t contexts in toxic and o in ordinary texts marks toxic ones.

    The contexts expected come from the word's rate in ordinary texts, one context more granted, so that neither
    more ordinary texts nor another share of toxic ones in the sample raises the evidence a word needs.
    """
    expected = (o + 1) * (all_t / (all_o + 1))
    odds = F.log((t + 0.5) / float(all_t)) - F.log((o + 0.5) / float(all_o))
    return ((t - expected) / F.sqrt(expected + 1) > LEAST_Z) & (odds > LEAST_ODDS) & (t >= LEAST_CONTEXTS)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_PER_LABEL) -> Model:
    """Dictionaries and calibration from at most about ``most`` training texts of each label.

    Three quarters of them train the dictionaries, the last quarter calibrates. Without rows of both labels
    in both parts, or without words in both, the model gives every text the score 0.
    """
    known = training_rows(labels, label, most)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    rows = settle(rows.withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0), "training_texts")
    counts = {(r["calibrate"], r["y"]): r["count"] for r in rows.groupBy("calibrate", "y").count().collect()}
    if len(counts) < 4:
        return Model(b"", b"")
    chosen = rows.where("NOT calibrate").select("y", words(F.translate("text", _UPPER, _UPPER.lower())).alias("w"))
    inside = F.transform("w", lambda x, i: F.struct(x.alias("word"), _joined(F.slice("w", F.greatest(i, F.lit(1)), F.least(i, F.lit(1)) + 2)).alias("sample")))
    runs = chosen.select("y", F.explode(inside).alias("c")).select("y", "c.word", "c.sample").distinct()
    stems = F.array_distinct(F.array("word", F.substring("word", 1, STEM)))
    seen = settle(runs.select("y", F.explode(stems).alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")), "words")
    all_t, all_o = seen.agg(F.sum("t"), F.sum("o")).first()
    if not all_t or not all_o:
        return Model(b"", b"")
    marking = seen.where(_marks(F.col("t"), F.col("o"), all_t, all_o)).select("word")
    toxic = runs.where("y = 1").select("sample", F.explode(stems).alias("word")).join(marking, "word", "left_semi")
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(WINDOW_WORDS))
    ordinary = chosen.where("y = 0 AND size(w) > 0").select(F.explode(F.transform(starts, lambda i: _joined(F.slice("w", i, WINDOW_WORDS)))).alias("sample"))
    model = Model(_dictionary(toxic, TOXIC_BYTES), _dictionary(ordinary, ORDINARY_BYTES))
    held = rows.where("calibrate")
    found = held.select("doc_id", "text").mapInArrow(_measure(model), _MEASURED).select("doc_id", "features").join(
        held.select("doc_id", "y", "weight"), "doc_id").orderBy("doc_id").collect()
    x, y, weight = (np.array([r[c] for r in found], float) for c in ("features", "y", "weight"))
    middle, spread = x.mean(0), x.std(0) + 1e-9
    return Model(model.toxic, model.ordinary, tuple(middle), tuple(spread), tuple(logistic((x - middle) / spread, y, weight)))


def judge(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score, predicted, worst_window (number of the window that gains most), worst_gain.

    Whole texts are compressed, window by window. Null, empty and blank texts have no window and get the
    score of gaining nothing; repeated rows score alike; a null doc_id stays null. Columns not named are not read.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_measure(model), _MEASURED).select(
        "doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_window", "worst_gain")


def keep_civil(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``, with all their columns."""

    def civil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for batch in batches:
            texts = byte_texts(batch.column(batch.schema.get_field_index(text)))
            features = np.array([_features(gains(t or b"")) for t in texts]).reshape(len(batch), len(_STEPS) + 7)
            yield batch.filter(pa.array(model.score(features) < threshold))

    return docs.mapInArrow(civil, docs.schema)
