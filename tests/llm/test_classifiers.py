"""The quality network and the toxicity model: held-out accuracy, and defined results for odd input."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from keepsake.llm import compression_toxicity, indexed_quality, queries
from keepsake.llm.common import logistic

SCHEMA = "doc_id long, text string, score string, predicted string, features string, y string"
LABELS = "doc_id long, quality int, toxic int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def rank_accuracy(scores, labels):
    good, bad = ([s for s, y in zip(scores, labels) if y == want] for want in (1, 0))
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def planted(n=1500, seed=1):
    """Ordinary words; toxic texts hold a few words of their own, poor texts repeat one word."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(700)]
    rude = ["zorgwump", "blixnarg", "krudvoth", "pfaxquin"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        toxic, poor = rng.random() < 0.2, rng.random() < 0.2
        if poor:
            text = [rng.choice(words)] * len(text)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text[rng.randrange(len(text))] = rng.choice(rude)
        docs.append((i, " ".join(text), "s", "p", "f", "y"))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = planted()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), labels


def test_toxic_texts_are_found(corpus):
    docs, labels, truth = corpus
    got = {r.doc_id: r for r in compression_toxicity.judge(docs, compression_toxicity.fit(docs, labels)).collect()}
    test = [(got[i], y) for i, _, y in truth if held(i)]
    assert rank_accuracy([r.score for r, _ in test], [y for _, y in test]) > 0.97
    assert sum(r.predicted for r, y in test if not y) <= 0.02 * len(test)
    assert sum(r.predicted for r, y in test if y) >= 0.85 * sum(y for _, y in test)


def test_gains_and_features_by_the_definition(corpus):
    """Bytes that a window saves beside both dictionaries, compressed one by one, and the features and score from them."""
    docs, labels, _ = corpus
    model = compression_toxicity.fit(docs, labels)
    rows = docs.where("doc_id < 60").select("doc_id", "text")
    got = {r.doc_id: r for r in rows.mapInArrow(compression_toxicity._measure(model), compression_toxicity._MEASURED).collect()}

    def length(window, beside):
        settings = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=17, chain_log=17, search_log=4, target_length=32, min_match=6,
            write_content_size=0, write_checksum=0, write_dict_id=0)
        raw = zstandard.ZstdCompressionDict(beside, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=settings).compress(window))

    for r in rows.collect():
        found, gains = r.text.split(), []
        while found:
            window, found = (" " + " ".join(found[:8]) + " ").encode(), found[8:]
            gains.append(length(window, model.ordinary) - length(window, model.toxic + model.ordinary))
        top = sorted(gains)[-3:]
        want = [math.log(1 + len([g for g in gains if g >= least])) for least in (1, 2, 3, 4, 6)]
        want += [top[-1], sum(top) / len(top), sum(max(g - 1, 0) for g in gains) / len(gains), len([g for g in gains if g >= 2]) / len(gains),
                 len([g for g in gains if g >= 4]) / len(gains), math.log(len(gains)), sum(gains) / len(gains)]
        assert got[r.doc_id].features == pytest.approx(want)
        total = model.weights[-1] + sum(w * (f - m) / s for w, f, m, s in zip(model.weights, want, model.middle, model.spread))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-total)))
        assert got[r.doc_id].worst_gain == max(gains) and got[r.doc_id].worst_window == gains.index(max(gains))


def test_dictionaries_hold_the_labelled_texts(corpus):
    """Trained on the texts: what they hold is text of the training rows, and the toxic one the words that mark it."""
    docs, labels, truth = corpus
    model = compression_toxicity.fit(docs, labels)
    toxic = {i for i, _, y in truth if y and not held(i)}
    texts = [f" {r.text} " for r in docs.collect() if r.doc_id in toxic]
    pieces = {t.encode()[i:i + 6] for t in texts for i in range(len(t.encode()) - 5)}
    content = model.toxic[-1500:]
    # Segments of 16 bytes lie side by side: at most 5 of 16 places cross from one to the next.
    assert sum(content[i:i + 6] in pieces for i in range(len(content) - 5)) > 0.6 * (len(content) - 5)
    assert all(r in model.toxic for r in (b"zorgwump", b"blixnarg", b"krudvoth", b"pfaxquin"))
    assert not any(r in model.ordinary for r in (b"zorgwump", b"blixnarg", b"krudvoth", b"pfaxquin"))


def test_copies_train_once(spark, corpus, monkeypatch):
    """Repeated training texts change no dictionary."""
    docs, labels, _ = corpus
    copies = docs.where("doc_id % 7 = 1").withColumn("doc_id", F.expr("doc_id + 1000000"))
    named = labels.where("doc_id % 7 = 1").withColumn("doc_id", F.expr("doc_id + 1000000"))
    parts = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    same = named.join(labels.selectExpr("doc_id + 1000000 AS doc_id").where(~F.expr("pmod(xxhash64(doc_id - 1000000, 3), 4) = 0")), "doc_id").where(~parts)
    monkeypatch.setattr(compression_toxicity, "training_rows", lambda rows, *_: rows.select("doc_id", F.col("toxic").alias("y"), F.lit(1.0).alias("weight")))
    one, two = compression_toxicity.fit(docs, labels), compression_toxicity.fit(docs.union(copies), labels.union(same))
    assert (one.toxic, one.ordinary) == (two.toxic, two.ordinary)


@pytest.mark.parametrize("more", [1, 20])
def test_evidence_does_not_follow_the_mix(spark, more):
    """A word without ordinary contexts needs about as many toxic ones whether ordinary text is as much or twenty times more."""
    t = spark.range(1, 60).withColumn("o", F.lit(0))
    least = t.where(compression_toxicity._marks(F.col("id"), F.col("o"), 100_000, 100_000 * more)).agg(F.min("id")).first()[0]
    assert 6 <= least <= 10


def test_quality_is_learned(corpus):
    docs, labels, truth = corpus
    got = {r.doc_id: r.score for r in indexed_quality.judge(docs, labels).collect()}
    test = [(got[i], y) for i, y, _ in truth if held(i)]
    assert rank_accuracy([s for s, _ in test], [y for _, y in test]) > 0.98
    # Calibrated: the mean score is near the share of label 1.
    assert abs(np.mean([s for s, _ in test]) - np.mean([y for _, y in test])) < 0.06


ODD = [(None, None), (None, "text"), (1, None), (1, ""), (1, " \n\t "), (2, "word"), (2, "word"), (3, "a " * 300_000), (4, "漢字 ñ é 𝒳"), (5, "x" * 200_000)]


@pytest.mark.parametrize("labels", ["both", "one", "none"])
def test_odd_documents(spark, corpus, labels):
    docs = spark.createDataFrame([(*r, "s", "p", "f", "y") for r in ODD], SCHEMA)
    known = corpus[1] if labels == "both" else corpus[1].where("toxic = 0 AND quality = 1") if labels == "one" else corpus[1].limit(0)
    model = compression_toxicity.fit(corpus[0], known)
    toxic = compression_toxicity.judge(docs, model).collect()
    quality = indexed_quality.judge(docs.unionByName(corpus[0]), known).where("doc_id IS NULL OR doc_id < 6").collect()
    assert len(toxic) == len(ODD)
    for rows in (toxic, quality):
        assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    blank = {r.score for r, (_, t) in zip(sorted(toxic, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0))) if not (t or "").strip()}
    assert len(blank) == 1
    if labels != "both":
        assert not any(r.predicted for r in toxic) and {r.score for r in quality} == {1.0}
    kept = compression_toxicity.keep_civil(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 - r.predicted for r in toxic)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert compression_toxicity.judge(none, compression_toxicity.fit(none, labels)).collect() == []
    assert indexed_quality.judge(none, labels).collect() == []


def test_held_out_labels_are_not_read(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "IF(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality",
                                "IF(crc32(cast(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert compression_toxicity.fit(docs, labels) == compression_toxicity.fit(docs, flipped)
    one, two = (sorted((r.doc_id, round(r.score, 9)) for r in indexed_quality.judge(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_word_vectors_do_not_depend_on_partitions(spark, corpus, monkeypatch):
    docs = corpus[0].where("doc_id < 200")
    one = indexed_quality.word_vectors(docs.coalesce(1))
    monkeypatch.setattr(indexed_quality, "_TOKENS_AT_ONCE", 37)
    assert np.array_equal(one, indexed_quality.word_vectors(docs.repartition(5)))


def test_word_vectors_are_sums_of_neighbours(spark):
    vectors = indexed_quality.word_vectors(spark.createDataFrame([("p q r s", ), ("q",)], "text string"))
    index = indexed_quality._index_vectors()
    place = {w: zlib.crc32(w.encode()) % indexed_quality.BUCKETS for w in "pqrs"}
    for word, beside in (("p", "qr"), ("q", "prs"), ("r", "pqs"), ("s", "qr")):
        want = sum(index[place[b]] for b in beside)
        assert np.allclose(vectors[place[word]], want / np.linalg.norm(want), atol=1e-6)


def test_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, cut in (("op2_indexed_quality", 0.3), ("op8_compression_toxicity", 0.5)):
        rows = queries.QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) and r.held_out == held(r.doc_id) for r in rows)


def test_logistic_regression_fits():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.allclose(logistic(x, y, np.ones(4000)), [2, -1, 0.5], atol=0.2)
