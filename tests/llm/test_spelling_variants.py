"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from keepsake.llm import queries, spelling_variants

SCHEMA = "doc_id long, text string, word string, n long, form string"


def slow_words(inputs, least=5):
    counts = Counter()
    for doc, text in inputs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_apart(a, b):
    """By the definition: what one insertion, deletion or replacement makes of the shorter word."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def slow(inputs, least=5):
    words = slow_words(inputs, least)
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def planted(seed=4):
    """Words, misspellings of them, misspellings of those, and words made of few letters."""
    rng = random.Random(seed)
    letters = "abcdeéßÿà÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 14))) for _ in range(60)]
    words += ["".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(80)]
    counts = Counter({w: rng.choice([5, 6, 30, 200]) for w in words})

    def slip(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + rng.choice(letters) * (kind < 2) + w[i + (kind > 0):]

    for w in list(counts):
        for near in {slip(w) for _ in range(3)}:
            counts[near] += max(counts[w] // rng.choice([1, 5, 6, 40]), 5)
            counts[slip(near)] += 5
    every = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(every)
    return [(i if i % 7 else None, " ".join(every[i:i + 40]) + "\n9x9") for i in range(0, len(every), 40)]


@pytest.mark.parametrize("parts", [3, 5, 6, 8])
def test_planted_words(spark, monkeypatch, parts):
    monkeypatch.setattr(spelling_variants, "PARTS", parts)
    monkeypatch.setattr(spelling_variants, "WORDS_AT_ONCE", 100)
    inputs = planted()
    want = slow(inputs)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] not in (None, r[2]) for r in want)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in inputs], SCHEMA)
    assert result(spelling_variants.group_variants(df)) == want


def test_the_table(spark, sf_dir):
    inputs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op12_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert result(got) == slow(inputs)


def test_letters_of_one_word_lose_one(spark):
    """About one run in 199 of different documents loses a code point, and the same place in all its repeats."""
    inputs = [(i, "wonderful wonderful") for i in range(3000)]
    want = slow_words(inputs, 1)
    df = spark.createDataFrame(inputs, "doc_id long, text string")
    assert {r.word: r.n for r in spelling_variants.vocabulary(df, least_count=1).collect()} == want
    assert len(want) > 3 and 10 <= sum(n for w, n in want.items() if w != "wonderful") <= 60


def test_odd_documents(spark):
    inputs = [(1, None), (2, ""), (3, " \n "), (None, "abcdefg " * 9), (4, "abcdef " * 50000), (4, "abcdef " * 50000), (5, "a" * 40000 + " "), (6, "ÀÉÎÕÜß àéîõüß " * 5),
              (7, "tied1 abcdeh abcdei " * 5), (8, ("x" * 4000 + " ") * 5 + ("x" * 4001 + " ") * 25), (9, "漢字abcdefé漢字 " * 6)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in inputs], SCHEMA)
    assert result(spelling_variants.group_variants(df)) == slow(inputs)
    assert spelling_variants.group_variants(df.limit(0)).collect() == []
    assert spelling_variants.group_variants(df.where("doc_id < 3")).collect() == []


def test_any_two_near_words_share_a_signature():
    part = {(c, j): i % spelling_variants.PARTS for i, (c, j) in enumerate((c, j) for c in "abcdefgh" for j in range(4))}
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(200):
        word = "".join(rng.choice("abcdefghzé") for _ in range(rng.randint(6, 20)))
        i, kind = rng.randrange(len(word)), rng.randrange(3)
        other = word[:i] + rng.choice("abcdefghzé") * (kind < 2) + word[i + (kind > 0):]
        out, = spelling_variants._signatures(part)(iter([pa.RecordBatch.from_arrays([pa.array([word, other])], names=["word"])]))
        found = {}
        for s, b, w in zip(*(c.to_pylist() for c in out.columns)):
            found.setdefault(w, set()).add((s, b))
        assert {s for s, _ in found[word]} & {s for s, _ in found[other]}
        bits = [next(iter(found[w]))[1] % 2**64 for w in (word, other)]
        assert (bits[0] ^ bits[1]).bit_count() <= 2
