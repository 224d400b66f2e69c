"""Quality rules as a learned decision list.

Sequential covering: a rule grows by the threshold condition with the best gain on two thirds of the
labelled rows, is pruned on the other third, and its rows leave before the next rule is grown. The list
becomes one ordered Spark conditional expression. Statistics of texts and all counts are DataFrame work;
the driver sees counts per feature, bin and label only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import SPACES, held_out, words
from keepsake.session import settle

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Most labelled rows that rules are learned from, thresholds tried per feature, rules and conditions learned.
MAX_LABELLED = 200_000
BINS = 48
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule must be right this often on the rows it is pruned on, counted with one more right and one more wrong.
MIN_PRECISION = 0.9
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share",
            "line_words")


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text; a null text counts as empty.

    n_repeat_words counts the words in three-word windows found at least twice: window hashes are sorted
    with their positions in the low bits, so equal windows become neighbours without leaving the row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), body.alias("body"), words(F.col(text)).alias("w"))
    left = lambda pattern: F.length(F.regexp_replace("body", pattern, "")).cast("bigint")
    lines = F.filter(F.split("body", "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    rows = rows.select("doc_id", "w", F.size("w").cast("bigint").alias("n_words"), left(SPACES).alias("word_chars"),
                       left(f"[^{SYMBOLS}]+").alias("n_symbols"), left("[^A-Z]+").alias("n_upper"), left("[^0-9]+").alias("n_digits"),
                       left("[^!?.,;:]+").alias("n_marks"), lines.alias("lines"))
    window = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(-F.col("room")).bitwiseOR(i))
    rows = rows.withColumn("room", F.expr("shiftleft(1L, length(bin(n_words)))"))
    kept = [c for c in rows.columns if c not in ("w", "lines", "room")]
    rows = rows.select(*kept, "room", F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.size("lines").cast("bigint").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                       F.sort_array(F.slice(window, F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))).alias("s"))
    name = lambda x: x.bitwiseAND(-F.col("room"))
    near = lambda x, i, step: F.coalesce(name(F.get("s", i + step)) == name(x), F.lit(False))
    twice = F.filter("s", lambda x, i: near(x, i, 1) | ((i > 0) & near(x, i, -1)))
    rows = rows.withColumn("p", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(F.col("room") - 1)))).drop("s", "room")
    covered = F.transform("p", lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get("p", i + 1) - x, F.lit(3).cast("bigint"))))
    return rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Features from the counts; every one is a finite number."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    made = {"n_words": F.col("n_words").cast("double"), "mean_word": per("word_chars", "n_words"), "symbol_share": per("n_symbols", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct", "n_words"),
            "upper_share": per("n_upper", "word_chars"), "digit_share": per("n_digits", "word_chars"), "mark_share": per("n_marks", "n_words"),
            "line_words": per("n_words", "n_lines")}
    return {f: made[f] for f in FEATURES}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in the order they are tried; what none of them meets is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule_number(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does."""
        chain = None
        for number, rule in enumerate(self.rules, 1):
            test = rule[0].column()
            for condition in rule[1:]:
                test = test & condition.column()
            chain = F.when(test, number) if chain is None else chain.when(test, number)
        return F.lit(0) if chain is None else chain.otherwise(0)

    def kept(self) -> Column:
        return self.rule_number() == 0

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "keep"])


def _counts(rows: DataFrame) -> dict[tuple[str, int], list[int]]:
    """Rows per feature and bin: [label 1, label 0]."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])).alias("c")
    found: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
    for r in rows.select("bad", cells).groupBy("c.f", "c.b", "bad").count().collect():
        found[r["f"], r["b"]][r["bad"]] += r["count"]
    return found


def _best(counts: dict[tuple[str, int], list[int]], cuts: dict[str, list[float]]) -> tuple[float, Condition, int, int] | None:
    """The condition with the largest gain in information about label 0, times the rows of label 0 it keeps."""
    good, bad = (sum(v[i] for (f, _), v in counts.items() if f == FEATURES[0]) for i in (0, 1))
    if not bad or not good:
        return None
    base = math.log2(bad / (bad + good))
    best = None
    for feature in FEATURES:
        below = [0, 0]
        for b, cut in enumerate(cuts[feature]):
            below = [x + y for x, y in zip(below, counts.get((feature, b), [0, 0]))]
            for above, (g, n) in ((False, below), (True, (good - below[0], bad - below[1]))):
                if n and (g, n) != (good, bad):
                    gain = n * (math.log2(n / (n + g)) - base)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, cut), g, n)
    return best if best and best[0] > 0 else None


def learn(measured: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A list that rejects what ``labels`` marks 0, from ``measured`` (statistics of documents).

    Only rows with a label of 0 or 1 and outside the held-out fifth are used, at most about
    ``max_labelled`` of them, chosen by a hash of the id. Without rows of both labels the list is empty.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("y")).where("y IN (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    total = known.count()
    if total > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < max_labelled)
    made = features()
    rows = measured.join(known, "doc_id").select("doc_id", (F.col("y") == 0).cast("int").alias("bad"), *[c.alias(f) for f, c in made.items()])
    rows = settle(rows, "labelled")
    if rows.isEmpty():
        return DecisionList(())
    at = [i / BINS for i in range(1, BINS)]
    ends = [0.001, 0.002, 0.005, 0.01]
    places = sorted({*at, *ends, *(1 - e for e in ends)})
    found = rows.agg(*[F.percentile_approx(f, places, 10_000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(found[f])) for f in FEATURES}
    bins = [sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f"bin_{f}") for f in FEATURES]
    rows = settle(rows.select("bad", *FEATURES, *bins, (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).alias("prune")), "binned")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MAX_RULES:
        left = rows.where(DecisionList(tuple(rules)).kept())
        grow, prune = left.where("NOT prune"), left.where("prune")
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            some = grow
            for condition in rule:
                some = some.where(condition.column())
            best = _best(_counts(some), cuts)
            if best is None:
                break
            rule.append(best[1])
            if best[2] == 0:
                break
        if not rule:
            break
        # How each shortening of the rule does on rows it was not grown on.
        tests, test = [], F.lit(True)
        for condition in rule:
            test = test & condition.column()
            tests.append(test)
        sums = prune.agg(*[F.sum(F.when(t & (F.col("bad") == b), 1).otherwise(0)) for t in tests for b in (0, 1)]).first()
        scores = [((sums[2 * i + 1] or 0), (sums[2 * i] or 0)) for i in range(len(rule))]
        worth = [(bad - good) / (bad + good) if bad + good else -1.0 for bad, good in scores]
        size = max(range(len(rule)), key=lambda i: (worth[i], scores[i][0]))
        bad, good = scores[size]
        if (bad + 1) / (bad + good + 2) < MIN_PRECISION:
            break
        rules.append(tuple(rule[:size + 1]))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, rule (0: none), kept.

    ``kept`` is false where the fixed base rule fails, else what the list learned from ``labels`` says.
    Null and blank texts have no words and fail; repeated rows are judged alike; null ids are never
    training rows; without labels nothing but the base rule rejects. Columns not named are not read.
    """
    measured = settle(statistics(docs, doc_id, text), "statistics")
    rules = learn(measured, labels, label)
    made = measured.select("*", *[c.alias(f"f_{f}") for f, c in features().items()])
    renamed = DecisionList(tuple(tuple(Condition(f"f_{c.feature}", c.above, c.cut) for c in r) for r in rules.rules))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                       renamed.rule_number().alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
