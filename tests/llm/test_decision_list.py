"""Text statistics against loops, and the learned list on planted and real labels."""

import random
import re
import zlib
from collections import Counter

import pytest

from keepsake.llm import decision_list, queries

SCHEMA = "doc_id long, text string, n_words string, rule string, w string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def odd_texts():
    rng = random.Random(6)
    out = [None, "", " \n\t\x0b\f\r", "a", "a a", "a a a", "a a a a", "a b c a b c", "x y z x y z x", "#*$%&|<> é 漢字 𝒳", "l\nl\n\nl\n \n ", "    a b",
           "one two three " * 30000]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "cc", "é", " ", " ", "\n", "\t", "#", "|"]) for _ in range(rng.randint(0, 120))))
    return out


def test_statistics_of_odd_texts(spark):
    texts = odd_texts()
    rows = [(i, t, "n", "r", "w", "k") for i, t in enumerate(texts)] + [(None, "x " * 60, "n", "r", "w", "k")] * 2
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = decision_list.judge(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        want = slow(texts[r.doc_id] if r.doc_id is not None else "x " * 60)
        assert counts(r) == want, (r.doc_id, counts(r), want)
        assert r.base_failed == failed(want) and r.kept == (not r.base_failed)
    assert decision_list.judge(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_rules_find_what_is_planted(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(60, 200))]
        bad = rng.random() < 0.25
        if bad:
            words = [w.upper() for w in words] if i % 2 else [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "n", "r", "w", "k"))
        labels.append((i, None if i % 50 == 0 else int(not bad)))
    got = decision_list.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    truth = {i: y for i, y in labels if y is not None}
    assert sum(r.kept == bool(truth[r.doc_id]) for r in got if r.doc_id in truth) >= 0.99 * len(truth)
    assert {r.rule for r in got} >= {0, 1, 2}


def test_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_decision_list(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(counts(r) == slow(texts[r.doc_id]) and r.base_failed == failed(counts(r)) for r in rows)


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op10_decision_list(spark, sf_dir).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels and not r.base_failed]
    clean, junk = [r for r in held if labels[r.doc_id]], [r for r in held if not labels[r.doc_id]]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean) and sum(r.kept for r in junk) <= 0.05 * len(junk)


@pytest.mark.parametrize("rule", [(), ((decision_list.Condition("n_words", True, 3.0),),)])
def test_a_list_is_one_expression(spark, rule):
    found = spark.createDataFrame([(1.0,), (5.0,)], "n_words double").select(decision_list.DecisionList(rule).kept().alias("k")).collect()
    assert [r.k for r in found] == [True, not rule]
