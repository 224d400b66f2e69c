"""K-d shards, Pareto mixing and packing against their definitions."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keepsake.llm import kd_shards, packing, pareto_mix, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path(packing.TOKENIZER)


def odd_documents():
    """Nulls in every column, blank and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["alpha", "Béta", "gamma,", "ñu", "x1", "don't"]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), "en", f"s{i % 3}", 5, 1, "p", "k") for i in range(60)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None, None, None), (None, "a b", None, None, None, None, None, None),
             (100, "", "en", "s0", 0, 1, "p", "k"), (101, " \n\t ", "en", "s0", 0, 1, "p", "k"), (102, text(30000), "en", "s1", 5, 1, "p", "k"),
             (103, rows[5][1], "fr", "s2", 5, 1, "p", "k"), (104, None, "fr", "s2", 5, 1, "p", "k"), (105, "<|endoftext|> a <|ENDOFTEXT|>", "fr", "s2", 5, 1, "p", "k")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def check_shards(rows, inputs, shards):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in inputs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots, total, homes, group = defaultdict(list), Counter(), {}, Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
        assert homes.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        group[(r.size, r.text_crc32)] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total, max(group.values(), default=0)


def test_shards_of_odd_documents(odd, empty):
    total, largest = check_shards(kd_shards.shard(odd, shards=5).collect(), [(r[0], r[1]) for r in odd_documents()], 5)
    assert max(total.values()) <= largest + sum(total.values()) / 5
    assert kd_shards.shard(empty, shards=5).collect() == []
    by_bytes = kd_shards.shard(odd, target_bytes=100_000).collect()
    assert len({r.shard for r in by_bytes}) >= 2


def test_shards_cut_texts_at_any_character(spark):
    for names in (["https://a.org/1", "https://a.org/2", "https://b.net/1", "https://b.net/2"], ["日本", "日本語", "本日", "漢字"]):
        rows = [(None, f"{i:06d}", "l", names[i % 4], 1, 0, "p", "k") for i in range(400)]
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        shard_of = {r.text_crc32: r.shard for r in kd_shards.shard(docs, shards=4, metadata=("source",)).collect()}
        by_name = [{shard_of[zlib.crc32(text.encode())] for _, text, _, source, *_ in rows if source == name} for name in names]
        assert by_name == [{0}, {1}, {2}, {3}]


def test_text_ranks_follow_the_order_of_all_texts(spark):
    texts = [f"https://host/{i * 7919 % 1000:04d}" for i in range(1000)] + [None, "", "é", "z"]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(texts * 2)], "t string, i int").repartition(7)
    order = sorted({t.encode() for t in texts if t is not None})
    for row, text in ((r, texts[r.i % len(texts)]) for r in kd_shards._text_ranks(rows, "t").collect()):
        assert row.t == (0 if text is None else order.index(text.encode()) + 1)


def test_shards_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op3_kd_shards(spark, sf_dir).collect()
    total, largest = check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 24)
    even = sum(total.values()) / 24
    assert len(total) == 24 and max(abs(t - even) for t in total.values()) <= 2 * largest


def water_level(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, budget = set(), sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check_mix(rows, inputs):
    sizes = Counter()
    for _, t, s in inputs:
        sizes[s] += len(WORD.findall(t or ""))
    target, taken, longest = water_level(sizes), Counter(), 0
    by_id = {d: s for d, _, s in inputs}
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len(WORD.findall(t or ""))) for d, t, _ in inputs)
    for r in rows:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        longest = max(longest, r.size)
    return target, taken, longest


def test_mix_of_odd_documents(odd, empty):
    inputs = [(r[0], r[1], r[3]) for r in odd_documents()]
    rows = pareto_mix.mix(odd).collect()
    target, taken, longest = check_mix(rows, inputs)
    assert all(abs(target[s] - taken[s]) <= longest for s in target)
    assert Counter(rows) == Counter(pareto_mix.mix(odd).collect())
    assert pareto_mix.mix(empty).collect() == []


def test_mix_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    target, taken, longest = check_mix(queries.op4_pareto_mix(spark, sf_dir).collect(), [(d.doc_id, d.text, d.source) for d in docs])
    assert all(abs(target[s] - taken[s]) <= longest / 2 + 1 for s in target)


def test_targets_of_random_sources(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {(None if i == 0 and rng.random() < 0.5 else f"s{i}"): rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randint(1, 9))}
        rows = pareto_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in rows} == water_level(sizes)


def test_targets_of_many_sources(spark):
    """Names in several ranges, sizes over many magnitudes, so that stops follow one another."""
    rng = random.Random(4)
    sizes = {f"host-{rng.randrange(10**6)}.é": int(10 ** rng.uniform(0, 9)) for _ in range(600)} | {None: 17, "": 0}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(9)
    got = {r.source: r.target for r in pareto_mix.targets(table).collect()}
    assert got == pytest.approx(water_level(sizes))


def test_long_documents_are_likelier(spark):
    """Of documents of 4 and of 4,000 words, the chances are as 3 to 12 by their binary digits, within a target of words."""
    rows = [(i, "w " * (4 if i < 2000 else 4000), "a") for i in range(4000)] + [(4000, "w " * 10**6, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    mixed = pareto_mix.mix(docs, weights=(1, 1), share=0.5, most=3).where("doc_id < 4000").collect()
    short, long = (sum(r.copies for r in mixed if (r.size > 4) == wanted) for wanted in (False, True))
    rest = mixed[0].target / mixed[0].source_size
    assert 0 < rest < 1 and abs(long / 2000 - rest) < 0.02 and 0.7 * long / 4 < short < 1.3 * long / 4


def test_inclusion_follows_the_rank_weight(spark):
    rows = [(i, "w " * 5, "a", 3.0 if i % 2 else 1.0) for i in range(4000)] + [(i, "w " * 5, "b", 1.0) for i in range(4000, 4400)]
    mixed = pareto_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, like double"), weights=(1, 1), share=0.5, rank_weight="like")
    got = Counter(r.doc_id % 2 for r in mixed.where("doc_id < 4000 and taken > 0").collect())
    assert 2.4 < got[1] / got[0] < 3.6


def check_packing(rows, inputs, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for d, text in inputs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for r in pieces[d]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        assert sum(r.length for r in pieces[d]) == len(ids) and sorted(r.start for r in pieces[d])[0] == 0
    used = sum(r.length for r in rows)
    return used / (capacity * max(len(bins), 1))


def test_packing_of_odd_documents(odd, empty):
    inputs = {r[0]: r[1] for r in odd_documents() if r[0] not in (None, 3)}
    rows = packing.pack(odd, PATH, keep_ids=True)
    held = rows.collect()
    only = packing.pack(odd.where("doc_id IS NOT NULL AND doc_id <> 3"), PATH).collect()
    check_packing(only, list(inputs.items()), packing.CAPACITY)
    assert sum(1 for r in held if r.doc_id == 3) == 3 and sum(1 for r in held if r.doc_id is None) == 2
    built = packing.sequences(rows).collect()
    assert sum(r.length for r in built) == sum(r.length for r in held)
    assert all(len(r.ids) // 4 == packing.CAPACITY or r.length & (r.length - 1) == 0 for r in built)
    assert packing.pack(empty, PATH).collect() == []


def test_packing_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    share = check_packing(queries.op5_pack_sequences(spark, sf_dir).collect(), [(d.doc_id, d.text) for d in docs], packing.CAPACITY)
    assert share > 0.97


def test_groups_are_packed_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, PATH, group_pieces=50).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 2
    check_packing(rows, [(d.doc_id, d.text) for d in docs.collect()], packing.CAPACITY)


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 300):
        lengths = rng.integers(1, 40, n)
        order, bins, offsets = packing.first_fit_decreasing(lengths, 40)
        room = []
        for at, size in enumerate(lengths[order].tolist()):
            fit = next((b for b, r in enumerate(room) if r >= size), None)
            if fit is None:
                fit = len(room)
                room.append(40)
            assert bins[at] == fit and offsets[at] == 40 - room[fit]
            room[fit] -= size


def test_word_ids_equal_the_tokenizer():
    tokenizer, fast = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzßàéñöüABCÉÜİΣςσœ’'.,!?-_0123456789#%&*|<> ́​漢字\x01"
    for _ in range(3000):
        text = "".join(rng.choice(letters + " \n\t") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(fast.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    vocabulary = [w for w in json.load(open(PATH, encoding="utf-8"))["model"]["vocab"] if w.endswith("</w>") and w[:-4].isascii()]
    text = " ".join(w[:-4] for w in vocabulary)
    assert np.frombuffer(fast.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
