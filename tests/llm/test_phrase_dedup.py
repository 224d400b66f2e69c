"""Passage dedup against a set of every 100-byte string seen so far."""

import hashlib
import random
from collections import Counter

import pytest
import xxhash

from keepsake.llm import phrase_dedup, queries

SCHEMA = "doc_id long, text string, spans string, doc string, tie string, kept string"


def slow(ordered):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) per document in corpus order."""
    seen, out = set(), []
    for doc, text in ordered:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            string = data[s:s + 100]
            if string in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(string)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def digest(df):
    out = []
    for r in df.collect():
        out.append((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return Counter(out)


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ab cdéßfgh\n") for _ in range(k))
    passages = [text(k) for k in (60, 80, 99, 100, 101, 130, 300, 900)]
    docs = []
    for i in range(n):
        docs.append((i, "".join(text(rng.randint(0, 120)) + rng.choice([*passages, ""]) for _ in range(rng.randint(0, 6)))))
    docs += [(n, "x" * 700), (n + 1, "ab" * 400), (n + 2, "x" * 150), (n + 3, docs[7][1]), (n + 4, docs[8][1][:-3] + "zz"), (n + 5, ""), (n + 6, None),
             (n + 7, "line of text\n" * 80), (n + 8, "y" * 99), (n + 9, "y" * 100), (n + 10, "y" * 101)]
    return docs


@pytest.mark.parametrize("at_once,starts", [(16_384, 1 << 20), (3, 50)])
def test_random_documents(spark, monkeypatch, at_once, starts):
    monkeypatch.setattr(phrase_dedup, "_STARTS_AT_ONCE", starts)
    docs = corpus()
    shuffled = random.Random(9).sample(docs, len(docs))
    df = spark.createDataFrame([(*d, "s", "d", "t", "k") for d in shuffled], SCHEMA).repartition(3)
    got = digest(phrase_dedup.remove_repeats(df, phrases_at_once=at_once))
    want = Counter(slow(docs))
    assert got == want, [x for x in got - want][:3] + [x for x in want - got][:3]


def test_repeated_rows_shared_and_null_ids(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    rows = [(1, long), (1, long), (2, long[:250]), (2, long[100:]), (None, long[50:300]), (None, None), (None, "short"), (3, "q" + long)]
    got = digest(phrase_dedup.remove_repeats(spark.createDataFrame([(*r, "s", "d", "t", "k") for r in rows], SCHEMA)))

    def place(row):
        bits = xxhash.xxh64_intdigest((row[1] or "").encode(), 42) if row[1] is not None else 42
        return (row[0] is not None, row[0] or 0, bits >> 33 & 0x7FFFFFFF)

    assert got == Counter(slow(sorted(rows, key=place)))
    assert digest(phrase_dedup.remove_repeats(spark.createDataFrame([], SCHEMA))) == Counter()


def test_the_table(spark, sf_dir):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    rows = queries.op6_phrase_dedup(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == slow(docs)
