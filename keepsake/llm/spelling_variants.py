"""Spelling variants by PartEnum signatures.

A word's letter multiset is a binary vector: its j-th letter c is the dimension (c, j). One inserted or
deleted letter changes one dimension, a replaced letter two, so near words lie within Hamming distance
``DISTANCE``. The dimensions are dealt to ``PARTS`` parts; at most two parts differ, so the two vectors agree
on one of the choices of ``PARTS - DISTANCE`` parts. Every choice gives each word one signature; words are
joined on equal signatures and verified inside the join, so links come out of it and no candidates.
"""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import byte_texts
from keepsake.session import settle

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form has so many times the occurrences of the word it stands for.
RATIO = 5
#: One run in so many loses a letter.
SLIP = 199
DISTANCE = 2
#: More parts: more signatures of a word, fewer words to a signature. Every number finds every link.
PARTS = 6
#: From here on the same letter's further occurrences are weighed alike when parts are filled.
_OCCURRENCES = 8
#: Words that one task counts before it hands them on.
WORDS_AT_ONCE = 1 << 19
RUN = re.compile("[a-zÀ-ÿ]+")


def slipped(run: str, prefix_crc: int) -> str:
    """The run, without one of its code points if its checksum after the document's prefix says so."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
            if not text:
                continue
            prefix = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            # bytes.lower changes A-Z only.
            for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                if len(run) >= LEAST_LETTERS and len(word := slipped(run, prefix)) >= LEAST_LETTERS:
                    counts[word] += n
            if len(counts) >= WORDS_AT_ONCE:
                yield block()
                counts.clear()
    yield block()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least six letters that occur often enough, counted over whole texts."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def dimensions(word: str) -> list[tuple[str, int]]:
    """The ones of a word's vector: each letter with the number of equal letters before it."""
    seen: Counter = Counter()
    found = []
    for c in word:
        found.append((c, seen[c]))
        seen[c] += 1
    return found


def _parts(words: DataFrame) -> dict[tuple[str, int], int]:
    """The part of each dimension, filled so that all parts tell words apart about equally well.

    Read from counts of dimensions, of which there are at most letters x ``_OCCURRENCES``.
    """
    letters = F.explode(F.split("word", "(?<=.)(?=.)")).alias("c")
    per_word = words.select("word", letters).groupBy("word", "c").count()
    filled = per_word.select("c", F.explode(F.sequence(F.lit(0), F.least("count", F.lit(_OCCURRENCES)).cast("int") - 1)).alias("j"))
    known = filled.groupBy("c", "j").count().collect()
    total, load, part = max((r["count"] for r in known), default=1) + 1, [0.0] * PARTS, {}
    for r in sorted(known, key=lambda r: (-r["count"], r["c"], r["j"])):
        share = r["count"] / total
        lightest = min(range(PARTS), key=load.__getitem__)
        part[r["c"], r["j"]] = lightest
        load[lightest] += share * (1 - share)
    return part


def _signatures(part: dict[tuple[str, int], int]):
    choices = list(itertools.combinations(range(PARTS), PARTS - DISTANCE))
    chosen = np.zeros((PARTS, len(choices)), np.uint64)
    for i, choice in enumerate(choices):
        chosen[list(choice), i] = 1
    salts = np.array([random.Random(i).getrandbits(64) for i in range(len(choices))], np.uint64)

    def place(dimension: tuple[str, int]) -> tuple[int, int]:
        """A dimension's part and its random 64-bit number; a part's number is the sum of its dimensions'."""
        c, j = dimension
        return part.get(dimension, (ord(c) + j) % PARTS), random.Random(ord(c) << 32 | j).getrandbits(64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], tuple[int, int]] = {}
        for whole in batches:
            for at in range(0, len(whole), 1 << 14):
                batch = whole.slice(at, 1 << 14)
                words = batch.column(0).to_pylist()
                rows, places, numbers = [], [], []
                for i, word in enumerate(words):
                    for d in dimensions(word):
                        if d not in known:
                            known[d] = place(d)
                        p, number = known[d]
                        rows.append(i)
                        places.append(p)
                        numbers.append(number)
                rows_, numbers_ = np.array(rows, np.int64), np.array(numbers, np.uint64)
                sums, bits = np.zeros((len(words), PARTS), np.uint64), np.zeros(len(words), np.uint64)
                np.add.at(sums, (rows_, np.array(places, np.int64)), numbers_)
                # Each dimension flips one of 64 bits, so the bits of near words differ in two places at most.
                np.bitwise_xor.at(bits, rows_, np.uint64(1) << (numbers_ >> np.uint64(58)))
                keys = (sums @ chosen + salts).view(np.int64)
                every = np.repeat(np.arange(len(words)), len(choices))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(bits.view(np.int64)[every]), batch.column(0).take(pa.array(every))],
                                                 names=["signature", "bits", "word"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, b), a before b: all pairs of different words that one inserted, deleted or replaced code point turns into each other.

    ``words`` has word. Equal signatures bring pairs together; what differs in more than two dimensions goes by
    64 bits of its vector, the rest by the edit distance itself, all within the join's condition.
    """
    signed = settle(words.select("word").mapInArrow(_signatures(_parts(words)), "signature long, bits long, word string"), "signatures")
    one = signed.select("signature", "bits", F.col("word").alias("a"))
    two = signed.select("signature", F.col("bits").alias("other"), F.col("word").alias("b"))
    close = F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= DISTANCE
    same = one.join(two, (one["signature"] == two["signature"]) & (F.col("a") < F.col("b")) & close & (F.levenshtein("a", "b", 1) == 1))
    return same.select("a", "b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends. Each round doubles the steps taken.

    A form has five times its word's occurrences, so there are few steps and no circles.
    """
    roots = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the first in code-point order) if that is at least
    ``RATIO`` times the word's n, else null; root is the last of the forms, the word itself without one.

    Null and empty texts have no words; a null doc_id counts as the text '' in the checksum that decides which
    runs lose a letter; repeated rows count again. An empty table gives no rows. Other columns are not read.
    """
    words = settle(vocabulary(docs, doc_id, text, least_count), "words")
    pairs = settle(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(known, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    common = -F.col("best.less") >= RATIO * F.col("n")
    found = settle(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(common, F.col("best.near")).alias("form"),
                                F.when(common, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
