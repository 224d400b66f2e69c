"""Fuzzy line dedup by MinHash.

A line's set holds its character shingles: the ``SHINGLE`` characters at every position of the whole
line, in lower case with one blank for each gap; a shorter line is its only shingle. A signature holds the least
hash of the shingles in each of ``bands`` x ``per band`` bins; an empty bin is a value like any other, so sets agree
in a bin at least as often as their similarity says. Lines meet where a band of their signatures agrees and has a
shingle, and are linked where the exact Jaccard similarity of their sets reaches the threshold. Components of links
keep their earliest line.

All of it is DataFrame functions. Each different line is shuffled once, its shingles are hashed in generated code and
the minima taken where the line lies. Only lines that share a bucket with another line travel with their text again,
once for each pair to compare. A bucket's lines are compared with its first line, then those that this left in different
components with each other, large buckets as pairs of blocks. ``WORDS`` long numbers a line, a bit for each shingle
(``sketches``), rule out pairs: bits that only one of two lines has come from shingles that only one of them has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keepsake.llm.common import SPACE_CHARS, SPACES, components, key_of
from keepsake.session import settle

SHINGLE = 8
THRESHOLD = 0.8
#: Share of links just at the threshold that may share no bucket, and most minima in a band.
MISSED = 0.002
ROWS = 4
#: A bucket of more lines is compared as pairs of blocks of this size.
BLOCK = 1024
#: Numbers of 64 bits in a line's sketch.
WORDS = 32
#: Places whose shingles are hashed in one row.
PLACES = 32


def _has_word(line: str) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def normal(line: Column) -> Column:
    """The line in lower case with one blank for each gap."""
    low = F.lower(F.btrim(line, F.lit(SPACE_CHARS)))
    gaps = reduce(or_, [F.contains(low, F.lit(x)) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")])
    return F.when(gaps, F.regexp_replace(low, SPACES, " ")).otherwise(low)


def different_lines(docs: DataFrame, text: str) -> DataFrame:
    """(id, line) of all lines with a word, each once."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).where(_has_word("line"))
    return lines.select(F.xxhash64("line").alias("id"), "line").dropDuplicates(["id"])


def _coded(line: Column) -> Column:
    """The normal line with four bytes a character, so that no piece is found by counting from the start."""
    return F.encode(line, "UTF-32")


def _last(coded: Column) -> Column:
    """Where the last shingle begins."""
    return F.greatest((F.length(coded) / 4).cast("int") - SHINGLE, F.lit(0))


def _hash(coded: str, at: Column) -> Column:
    return F.xxhash64(F.substring(coded, at * 4 + 1, F.lit(4 * SHINGLE)))


def shingle_hashes(lines: DataFrame) -> DataFrame:
    """(id, h) of the shingles at every position of each normal line of (id, line)."""
    coded = lines.select("id", _coded(F.col("line")).alias("coded"))
    placed = coded.select("id", "coded", F.explode(F.sequence(F.lit(0), _last(F.col("coded")))).alias("at"))
    return placed.select("id", _hash("coded", F.col("at")).alias("h"))


def buckets_of(lines: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(id, buckets): one row for each band of a normal line of (id, line) that has a shingle."""
    bins = F.shiftright(F.shiftrightunsigned("h", 40) * (bands * per_band), 24).cast("int").alias("bin")
    binned = shingle_hashes(lines).select("id", "h", bins)
    dealt = binned.select("id", "h", F.expr(f"int(bin div {per_band})").alias("band"), (F.col("bin") % per_band).alias("row"))
    least = [F.min(F.when(F.col("row") == r, F.col("h"))).alias(f"least{r}") for r in range(per_band)]
    found = dealt.groupBy("id", "band").agg(*least)
    return found.select("id", F.array(F.xxhash64("band", *[f"least{r}" for r in range(per_band)])).alias("buckets"))


def sketches(lines: DataFrame) -> DataFrame:
    """(id, size, w0 ...): how many shingles a normal line of (id, line) has, repeats counted, and a bit for each."""
    bit = shingle_hashes(lines).select("id", F.expr(f"int(shiftrightunsigned(h, 40) % {WORDS})").alias("word"), F.expr("shiftleft(1L, int(h & 63))").alias("bit"))
    bits = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"w{w}") for w in range(WORDS)]
    return bit.groupBy("id").agg(F.count("*").alias("size"), *bits)


def may_link(a: str, b: str, threshold: float) -> Column:
    """Whether two sketches allow a similarity of ``threshold``; never false where the sets have it."""
    apart = reduce(add, [F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}"))) for w in range(WORDS)])
    # Two sets have at most (1 - t) of their union apart, and the union at most 1 / (1 + t) of both sizes.
    return apart * (1 + threshold) <= (1 - threshold) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6


def similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of line ids whose sets have the similarity; ``texts`` has id and the normal line."""
    one, two = (texts.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
    met = pairs.join(one, "a").join(two, "b")
    side = [F.struct(F.lit(x == "a").alias("is_a"), F.col(f"line_{x}").alias("line")) for x in "ab"]
    sides = met.select("a", "b", F.inline(F.array(*side))).select("a", "b", "is_a", _coded(F.col("line")).alias("coded"))
    sides = sides.select("a", "b", "is_a", "coded", _last(F.col("coded")).alias("last"))
    placed = sides.select("a", "b", "is_a", "coded", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(PLACES))).alias("at"))
    # The pair's rows lie together since the join; a place beyond the last repeats its shingle.
    hashes = placed.select("a", "b", "is_a", F.array(*[_hash("coded", F.least(F.col("at") + k, F.col("last"))) for k in range(PLACES)]).alias("hashes"))
    sets = hashes.groupBy("a", "b").agg(*[F.flatten(F.collect_list(F.when(F.col("is_a") == F.lit(x), F.col("hashes")))).alias(f"set_{x}") for x in (True, False)])
    shared = sets.select("a", "b", F.size(F.array_intersect("set_True", "set_False")).alias("shared"), F.size(F.array_union("set_True", "set_False")).alias("all"))
    return shared.where(F.col("shared") >= F.lit(threshold) * F.col("all")).select("a", "b")


def banding(threshold: float) -> tuple[int, int]:
    """(bands, minima in each) with which at most ``MISSED`` of the links at the threshold share no bucket."""
    per_band = ROWS if threshold >= 1 else max(1, min(ROWS, math.floor(math.log(0.4) / math.log(threshold))))
    return (1 if threshold >= 1 else math.ceil(math.log(MISSED) / math.log(1 - threshold**per_band))), per_band


def _texts(docs: DataFrame, text: str, ids: DataFrame) -> DataFrame:
    """(id, line) of some lines, each once."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line")).select(F.xxhash64("line").alias("id"), "line")
    return lines.join(ids, "id").groupBy("id").agg(F.first("line").alias("line"))


def _members(lines: DataFrame) -> DataFrame:
    """(bucket, id) of the different lines of each bucket that holds more than one; the buckets are shuffled once."""
    keyed = lines.where("buckets IS NOT NULL").select("id", F.explode("buckets").alias("bucket"))
    of = W.partitionBy("bucket")
    shared = keyed.withColumns({"low": F.min("id").over(of), "high": F.max("id").over(of)}).where("low <> high")
    return shared.select("bucket", "id").distinct()


def _across(members: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of lines of a bucket in different components that may be linked; neither is the bucket's first.

    ``members`` has bucket, id, component, first and n.
    """
    mixed = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    rest = members.where("id <> first AND n > 2").join(mixed, "bucket")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.select("bucket", "id", "component", parts.alias("parts"), F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("own"))
    # A block meets itself only where it has no other to meet.
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("own")))
    rest = rest.select("bucket", "id", "component", "own", F.explode(other).alias("other"))
    rest = rest.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("place"), "id", "component")
    rest = settle(rest.join(sketch, "id"), "rest")
    met = rest.alias("x").join(rest.alias("y"), (F.col("x.place") == F.col("y.place")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y", threshold))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def line_groups(docs: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the different lines that are linked."""
    lines = different_lines(docs, text).select("id", normal(F.col("line")).alias("line"))
    members = settle(_members(buckets_of(lines, *banding(threshold))), "members")
    # Buckets that bring the same lines together are one; lines are told by 128 bits.
    sums = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.bit_xor("id").alias("x"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"))
    sets = settle(sums.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket"), F.min("first").alias("first")).select("bucket", "n", "first"), "sets")
    members = settle(members.join(sets, "bucket"), "members")
    texts = _texts(docs, text, members.select("id").distinct())
    texts = settle(texts.select("id", normal(F.col("line")).alias("line")), "texts")
    sketch = settle(sketches(texts), "sketches")
    pairs = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), F.col("b") == F.col("y.id")).where(may_link("x", "y", threshold)).select("a", "b")
    links = settle(similar(pairs, texts, threshold), "near")
    groups = settle(components(links), "groups")
    named = members.join(groups, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    across = _across(named.select("bucket", "id", "component", "first", "n"), sketch, threshold)
    return components(links.union(settle(similar(across, texts, threshold), "near")))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one line of each group kept, and n_lines and n_removed (lines with a word) beside.

    Of the lines that are equal or linked (directly or in steps) the first stays: that of the smallest
    doc_id, then the first in the text. Lines without a word always stay, as does the order of lines.

    Null texts stay null; an emptied text is "". Null ids order before others by their text's hash; rows
    that share an id are told apart by their text; of rows equal in both the first keeps its lines. All
    other columns are passed on; columns named n_lines or n_removed are replaced.
    """
    rows = docs.select(key_of(F.col(doc_id), F.col(text)).alias("doc"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).alias("text"))
    lines = rows.select("doc", "tie", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(_has_word("line"))
    places = settle(lines.select("doc", "tie", "pos", F.xxhash64("line").alias("id")), "lines")
    groups = settle(line_groups(docs, text, threshold), "groups")
    named = places.join(groups, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id")).select("doc", "tie", "pos", "label")
    named = settle(named, "named")
    first = named.groupBy("label").agg(F.min(F.struct("doc", "tie", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = named.join(first, "label").where(F.struct("doc", "tie", "pos") != F.col("first"))
    gone = gone.groupBy("doc", "tie").agg(F.collect_set("pos").alias("__llm_gone"))
    keyed = docs.withColumns({"__llm_doc": key_of(F.col(doc_id), F.col(text)), "__llm_tie": F.xxhash64(F.col(text))})
    again = F.lit(False)
    if not places.groupBy("doc", "tie", "pos").count().where("count > 1").isEmpty():
        again = F.row_number().over(W.partitionBy("__llm_doc", "__llm_tie").orderBy(F.lit(0))) > 1
    keyed = keyed.withColumn("__llm_again", again)
    joined = keyed.join(gone.withColumnsRenamed({"doc": "__llm_doc", "tie": "__llm_tie"}), ["__llm_doc", "__llm_tie"], "left")
    joined = joined.withColumn("__llm_lines", F.split(text, "\n"))
    has_word = lambda x: F.rlike(x, F.lit("[^ \\t-\\r]"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__llm_lines") - 1), "__llm_gone")
    blank = F.filter("__llm_lines", lambda x: ~has_word(x))
    kept = F.when(F.col("__llm_again"), blank).when(F.col("__llm_gone").isNotNull(), F.transform(stay, lambda i: F.get("__llm_lines", i)))
    total = F.coalesce(F.when(F.col(text).isNotNull(), F.size(F.filter("__llm_lines", has_word))), F.lit(0))
    removed = F.when(F.col("__llm_again"), total).when(F.col("__llm_gone").isNotNull(), F.size("__llm_gone")).otherwise(0)
    out = joined.select("*", total.cast("bigint").alias("__llm_total"), removed.cast("bigint").alias("__llm_removed"),
                        F.coalesce(F.array_join(kept, "\n"), F.col(text)).alias("__llm_text"))
    names = [F.col("__llm_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*names, F.col("__llm_total").alias("n_lines"), F.col("__llm_removed").alias("n_removed"))


# The same signatures for a list of lines, without Spark. The operator does not call them.

#: Characters whose shingles are hashed at once.
_CHARACTERS_AT_ONCE = 1 << 20
#: Characters that are hashed in one pass: arrays of 8 bytes for each stay in a processor's cache.
_CHARACTERS_IN_CACHE = 1 << 16
_BLANKS = bytes.maketrans(b"\t\n\x0b\f\r", b"     ")
_NONE = np.uint64(2**64 - 1)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _normal(line: bytes) -> bytes:
    """The line with one blank for each gap."""
    bare = line.translate(_BLANKS).strip(b" ")
    return b" ".join(bare.split()) if b"  " in bare else bare


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all shingles of all normal lines in lower case, how many each line has)."""
    # Blank places after each line, so that a short line is a shingle too and no shingle reaches the next line.
    gap = b"\n" * SHINGLE
    codes = np.frombuffer((gap.join(lines) + gap).decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    blank = codes == 10
    ends = np.flatnonzero(blank)[::SHINGLE]
    starts = np.concatenate([[0], ends[:-1] + SHINGLE])
    counts = np.maximum(ends - starts - SHINGLE, 0) + 1
    flat = codes.astype(np.uint64)
    flat += np.uint64(1)
    flat[blank] = 1
    places = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    sums = np.zeros(len(flat) - SHINGLE + 1, np.uint64)
    term = np.empty_like(sums)
    for j in range(SHINGLE):
        sums += np.multiply(flat[j:j + len(sums)], _FACTORS[j % len(_FACTORS)], out=term)
    return _mixed(sums[places]), counts


def _pieces(lines: list[bytes], characters: int) -> Iterator[tuple[int, int]]:
    """Ranges of lines that hold so many bytes; a longer line is a range of its own."""
    start, held = 0, 0
    for at, line in enumerate(lines):
        held += len(line) + SHINGLE
        if held >= characters:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(lines):
        yield start, len(lines)


def _hashed(lines: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``_shingles`` of as many lines at once as fit a processor's cache, with the number of the first of them."""
    for start, end in _pieces(lines, _CHARACTERS_IN_CACHE):
        yield start, *_shingles(lines[start:end])


def _signatures(lines: list[bytes], bins: int) -> np.ndarray:
    """One column per line: the least shingle hash in each of ``bins`` equal ranges of another part of the hash."""
    n = len(lines)
    found = np.full(n * bins, _NONE)
    for start, hashes, counts in _hashed(lines):
        place = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
        place *= np.uint64(n)
        place += np.repeat(np.arange(start, start + len(counts), dtype=np.uint64), counts)
        # The other half of the hash decides within a range.
        np.minimum.at(found, place.view(np.int64), hashes << np.uint64(32) | hashes >> np.uint64(32))
    found = found.reshape(bins, n)
    for j in reversed(range(2 * bins)):
        at, after = j % bins, (j + 1) % bins
        empty = np.flatnonzero(found[at] == _NONE)
        if len(empty):
            next_one = found[after][empty]
            found[at][empty] = np.where(next_one == _NONE, _NONE, next_one + np.uint64(0x9E3779B97F4A7C15))
    return found


def _keys(signatures: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """One 64-bit bucket number per line and band."""
    out = np.empty((signatures.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(signatures.shape[1], b + 1, np.uint64)
        for r in range(per_band):
            key = _mixed(key * _FACTORS[1] + signatures[b * per_band + r])
        out[:, b] = key
    return out


def _signed(lines: list[bytes], bands: int, per_band: int) -> np.ndarray:
    """Buckets of many lines, a bounded number of characters at a time."""
    parts = [_keys(_signatures(lines[start:end], bands * per_band), bands, per_band) for start, end in _pieces(lines, _CHARACTERS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros((0, bands), np.uint64)
