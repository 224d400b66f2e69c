"""SimHash near-duplicates against every pair of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from keepsake.llm import queries, simhash_pivots

SCHEMA = "doc_id long, text string, fp string, node string, label string, component_id string"


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, bits=4):
    values = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return [best.get(root(i)) for i in range(len(ids))]


def compare(rows, inputs):
    prints = [slow_print(t) for _, t in inputs]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(inputs, prints, slow_components([d for d, _ in inputs], prints))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=key) == sorted(want, key=key)


def test_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    compare(queries.op9_simhash_pivots(spark, sf_dir).collect(), [(d.doc_id, d.text) for d in docs])


def odd_documents():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = [(i, " ".join(base[:rng.randint(200, 400)])) for i in range(40)]
    for i in range(40, 90):
        changed = list(base)
        changed[rng.randrange(400)] = "new"
        rows.append((i, " ".join(changed)))
    rows += [(200, None), (201, ""), (None, None), (None, " \t"), (None, "one"), (202, "ONE"), (203, "é É"), rows[0], rows[0], (204, "a b c"), (205, "a b c d"),
             (206, "x " * 70000), (207, " ".join(rng.choice(vocabulary) for _ in range(70000)))]
    return rows


@pytest.mark.parametrize("block", [simhash_pivots.BLOCK, 7])
def test_odd_documents(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_pivots.near_links, "__defaults__", (4, simhash_pivots.PIVOTS, block))
    inputs = odd_documents()
    rows = simhash_pivots.near_duplicates(spark.createDataFrame([(*r, "f", "n", "l", "c") for r in inputs], SCHEMA)).collect()
    compare(rows, inputs)


def test_empty(spark):
    assert simhash_pivots.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_every_choice_of_bits_finds_every_link(spark, monkeypatch, m):
    rng = random.Random(m)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for v in values for _ in range(2)]
    n = {5: 10, 6: 10**6, 7: 10**9, 8: 10**11}[m]
    masks = simhash_pivots._choices(n, 4)
    monkeypatch.setattr(simhash_pivots, "_choices", lambda *_: masks)
    assert len(masks) == {5: 5, 6: 15, 7: 35, 8: 70}[m]
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash_pivots.near_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    index = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = sorted((root(index[r.a]), root(index[r.b])))
        parent[b] = a
    want = slow_components(list(range(len(values))), values)
    assert [root(i) for i in range(len(values))] == want


def test_one_of_each_group_stays(spark):
    inputs = odd_documents()
    docs = spark.createDataFrame([(*r, "f", "n", "l", "c") for r in inputs], SCHEMA)
    kept = simhash_pivots.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    prints = [slow_print(r.text) for r in rows]
    assert len(set(slow_components(list(range(len(rows))), prints))) == len(rows)
    all_prints = [slow_print(t) for _, t in inputs]
    assert len(rows) == len(set(slow_components(list(range(len(inputs))), all_prints)))


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(8)
    one, two, three = (" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(200)) for _ in range(3))
    # Id 2 is a copy of 1 in one row and a text of its own in two others.
    inputs = [(1, one), (2, one), (2, two), (2, three), (3, three), (3, three)]
    kept = simhash_pivots.keep_one(spark.createDataFrame(inputs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (2, two), (2, three)])
