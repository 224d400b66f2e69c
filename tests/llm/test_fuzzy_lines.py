"""Line dedup against every pair of lines."""

import random
import re
from collections import Counter

import pytest

from keepsake.llm import fuzzy_lines, queries

SCHEMA = "doc_id long, text string, line string, id string, doc string, pos string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def sets_of(line):
    """The definition: the characters at every position of the whole normalised line, a shorter line as one."""
    bare = re.sub(r"[ \t-\r]+", " ", line.strip(" \t\n\x0b\f\r").lower())
    return frozenset(bare[i:i + fuzzy_lines.SHINGLE] for i in range(max(len(bare) - fuzzy_lines.SHINGLE, 0) + 1))


def all_pairs(lines, threshold=0.8):
    """Root of each different line, and the linked pairs."""
    lines = sorted(set(lines))
    sets = [sets_of(x) for x in lines]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    parent, links = list(range(len(lines))), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n):
                links.append((lines[i], lines[j]))
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {x: root(i) for i, x in enumerate(lines)}, links


def check(rows, inputs):
    """Lines stay in order; of each group the first line stays, nothing unlinked goes, few links are missed."""
    groups, links = all_pairs([x for _, t in inputs for x in (t or "").split("\n") if WORD.search(x)])
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(inputs)
    seen, missed, kept_texts = {}, 0, []
    for doc, text in sorted(inputs):
        r = by_id[doc]
        old, new = (text or "").split("\n"), (r.text or "").split("\n") if r.text or r.n_lines != r.n_removed else []
        at, gone = 0, 0
        for x in old:
            kept = at < len(new) and new[at] == x
            first = groups.get(x) not in seen if WORD.search(x) else True
            if first:
                assert kept or not x, (doc, x)
            if WORD.search(x):
                seen.setdefault(groups[x], x)
                if kept and not first:
                    missed += 1
                gone += not kept
            at += kept
        assert at == len(new) or not any(map(WORD.search, new[at:])), doc
        assert r.n_removed == gone and r.n_lines == sum(1 for x in old if WORD.search(x))
    return missed, sum(r.n_removed for r in rows)


def documents(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(bases)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", "  ", "\t"]))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("block,characters", [(1024, 1 << 20), (3, 300)])
def test_planted_lines(spark, monkeypatch, block, characters):
    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
    monkeypatch.setattr(fuzzy_lines, "_CHARACTERS_AT_ONCE", characters)
    inputs = documents()
    rows = fuzzy_lines.drop_repeats(spark.createDataFrame([(*r, "l", "i", "d", "p") for r in inputs], SCHEMA)).collect()
    missed, gone = check(rows, inputs)
    assert gone > 100 and missed <= 0.01 * gone


def test_odd_documents(spark):
    long = "\n".join(f"line number {i} of many" for i in range(3000)) + "\n" + "word " * 60000
    inputs = [(1, "same line here\nsame line here\n\n \nother"), (2, None), (3, ""), (4, "\n\n"), (None, "same line here"), (None, None), (5, long), (6, long),
              (7, "a"), (7, "a"), (8, "Same  LINE\there")]
    df = fuzzy_lines.drop_repeats(spark.createDataFrame([(*r, "l", "i", "d", "p") for r in inputs], SCHEMA))
    assert df.columns == ["doc_id", "text", "line", "id", "doc", "pos", "n_lines", "n_removed"]
    rows = df.collect()
    assert len(rows) == len(inputs) and all((r.line, r.id, r.doc, r.pos) == ("l", "i", "d", "p") for r in rows)
    texts = Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows if r.doc_id not in (5, 6))
    # The null id orders first and keeps the line that all others share.
    assert texts == Counter([(None, "same line here", 1, 0), (1, "\n \nother", 3, 2), (2, None, 0, 0), (3, "", 0, 0), (4, "\n\n", 0, 0), (None, None, 0, 0),
                             (7, "a", 1, 0), (7, "", 1, 1), (8, "", 1, 1)])
    assert {r.doc_id: r.n_removed for r in rows}[6] == 3001
    assert fuzzy_lines.drop_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_table(spark, sf_dir):
    inputs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    missed, gone = check(queries.op7_fuzzy_lines(spark, sf_dir).collect(), inputs)
    assert gone and missed <= max(1, 0.005 * gone)


def every_shingle(line):
    """All runs of characters of the normalised line."""
    bare = re.sub(r"[ \t-\r]+", " ", line.strip(" \t\n\x0b\f\r").lower())
    return {bare[i:i + fuzzy_lines.SHINGLE] for i in range(max(len(bare) - fuzzy_lines.SHINGLE, 0) + 1)}


def test_every_character_counts(spark):
    """Long words, addresses and lines without blanks, against all pairs of sets of shingles at every position."""
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x4E00, 0x4F00)] + ["𠀀", "é"]
    lines = ["https://alpha.example.org/reports/2021", "https://beta.example.net/about", "transaction-000017", "transaction-000942", "", "a", "A", "b"]
    for _ in range(25):
        start = "".join(rng.choice(signs) for _ in range(8))
        lines += [start + "".join(rng.choice(signs) for _ in range(30)) for _ in range(2)]
        near = "".join(rng.choice(signs) for _ in range(120))
        lines += [near, near[:-1] + "終", near + "了"]
        word = "".join(rng.choice("abcdefgh") for _ in range(200))
        lines += [word, word[:8] + "".join(rng.choice("abcdefgh") for _ in range(192)), word.upper() + "x"]
    sets = {x: every_shingle(x) for x in lines if WORD.search(x)}
    group = {x: x for x in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for x in sets:
        for y in sets:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                group[root(x)] = root(y)
    rows = fuzzy_lines.drop_repeats(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")).collect()
    kept, seen = {r.doc_id for r in rows if not r.n_removed}, set()
    for i, x in enumerate(lines):
        first = x not in sets or root(x) not in seen
        assert (i in kept) == first, (i, x)
        seen.add(root(x) if x in sets else None)


def test_threshold_reaches_the_links(spark):
    for threshold in (0.3, 0.5, 0.8, 0.9, 1.0):
        bands, rows = fuzzy_lines.banding(threshold)
        assert (1 - threshold**rows) ** bands <= 0.002
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    near = word + "!" * 3
    similar = len(every_shingle(word) & every_shingle(near)) / len(every_shingle(word) | every_shingle(near))
    assert 0.8 < similar < 0.95
    docs = spark.createDataFrame([(1, word), (2, near)], "doc_id long, text string")
    assert [sum(r.n_removed for r in fuzzy_lines.drop_repeats(docs, threshold=t).collect()) for t in (0.8, 0.95)] == [1, 0]


def test_buckets_do_not_depend_on_pieces(monkeypatch):
    lines = [b"a", "ΟΔΟΣ".encode(), "İstanbul Σ".encode(), b"\xff cut \xc3", b"one two  three\t four " * 40, "終".encode() * 30]
    lines = [fuzzy_lines._normal(x) for x in lines * 5]
    assert lines[4] == b" ".join([b"one two three four"] * 40)
    whole = fuzzy_lines._signed(lines, 12, 4)
    monkeypatch.setattr(fuzzy_lines, "_CHARACTERS_IN_CACHE", 1)
    assert (fuzzy_lines._signed(lines, 12, 4) == whole).all()
    monkeypatch.setattr(fuzzy_lines, "_CHARACTERS_AT_ONCE", 50)
    assert (fuzzy_lines._signed(lines, 12, 4) == whole).all() and len(set(whole[:, 0])) == 6


def test_buckets_are_shuffled_once(spark):
    rows = [(1, [7, 8]), (1, [7, 8]), (2, [7, 9]), (3, [10, 11]), (4, None), (5, [10, 8])]
    members = fuzzy_lines._members(spark.createDataFrame(rows, "id long, buckets array<long>"))
    assert sorted((r.bucket, r.id) for r in members.collect()) == [(7, 1), (7, 2), (8, 1), (8, 5), (10, 3), (10, 5)]
    plan = members._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_only_dataframe_operations(spark, monkeypatch):
    inputs = documents(40, seed=8)
    docs = spark.createDataFrame([(*r, "l", "i", "d", "p") for r in inputs], SCHEMA)

    def refused(*_):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refused)
    missed, gone = check(fuzzy_lines.drop_repeats(docs).collect(), inputs)
    assert gone > 10 and missed <= 0.01 * gone


def test_comparison_is_exact(spark):
    """Sketches rule out no link, and the links are those of the sets of characters."""
    rng = random.Random(4)
    lines = ["a", "ab", "ä" * 7, "ä" * 300, "𠀀" * 9, "﻿bom and more of it"]
    for _ in range(8):
        words = ["".join(rng.choice("abcdé終𠀀") for _ in range(6)) for _ in range(rng.choice([4, 30, 300]))]
        lines += [" ".join(words[:n] + ["x"] * rng.randint(0, 3)) for n in (len(words), len(words) * 9 // 10, len(words) * 8 // 10, len(words) // 2)]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    sets = [sets_of(x) for x in lines]
    linked = {(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    pairs = spark.createDataFrame([(a, b) for a in range(len(lines)) for b in range(a)], "a long, b long")
    assert {tuple(r) for r in fuzzy_lines.similar(pairs, texts, 0.8).collect()} == linked and len(linked) > 10
    sketch = fuzzy_lines.sketches(texts)
    possible = {(r[0], r[1]) for r in sketch.alias("x").crossJoin(sketch.alias("y")).where(fuzzy_lines.may_link("x", "y", 0.8)).selectExpr("x.id", "y.id").collect()}
    assert linked <= possible and len(possible) < len(lines) ** 2 / 2
