"""Each stage of the pipeline on its own input, against loops."""

from collections import Counter, defaultdict

import pytest
from test_fuzzy_lines import check as check_lines
from test_mixing_sharding_packing import PATH, WORD, check_packing, water_level
from test_simhash import slow_components, slow_print

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from keepsake.llm import compression_toxicity, packing
from keepsake.session import settle


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input of each stage and the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], sf_dir), name))
    return out


def test_all_but_the_last_return_documents(stages):
    for result in stages[1:-1]:
        assert result.dtypes == stages[0].dtypes


def test_toxic_documents_go(spark, stages, sf_dir):
    model = compression_toxicity.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = {r.doc_id: r.predicted for r in compression_toxicity.judge(stages[0], model).collect()}
    assert sorted(stages[1].collect()) == sorted(r for r in stages[0].collect() if not judged[r.doc_id])


def test_each_line_stays_once(spark, stages):
    counted = pipeline.fuzzy_lines.drop_repeats(stages[1]).collect()
    assert Counter((r.doc_id, r.text) for r in counted) == Counter((r.doc_id, r.text) for r in stages[2].collect())
    missed, gone = check_lines(counted, [(r.doc_id, r.text) for r in stages[1].collect()])
    assert gone and missed <= max(1, 0.005 * gone)
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[2].collect())
    best = slow_components([r.doc_id for r in rows], [slow_print(r.text) for r in rows])
    assert sorted(stages[3].collect()) == [r for r, b in zip(rows, best) if r.doc_id == b]


def test_sources_meet_their_targets(stages):
    sizes, taken, longest = Counter(), Counter(), 0
    for r in stages[3].collect():
        sizes[r.source] += len(WORD.findall(r.text))
        longest = max(longest, len(WORD.findall(r.text)))
    copies = Counter(stages[4].collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(stages[3].collect())
    for r, n in copies.items():
        taken[r.source] += n * len(WORD.findall(r.text))
    target = water_level(sizes)
    assert all(abs(target[s] - taken[s]) <= longest / 2 + 1 for s in sizes)


def test_everything_is_packed(stages):
    pieces = defaultdict(list)
    for r in stages[5].collect():
        pieces[r.doc_id].append(r)
    copies = Counter(r.doc_id for r in stages[4].collect())
    once = {r.doc_id: r.text for r in stages[4].collect()}
    assert set(pieces) == set(once)
    for doc, n in copies.items():
        found = Counter((r.start, r.length, r.ids_crc32) for r in pieces[doc])
        assert set(found.values()) == {n} and sum(length for _, length, _ in found) == pieces[doc][0].doc_tokens
    single = [d for d, n in copies.items() if n == 1]
    bins = {r.sequence_id for d in single for r in pieces[d]}
    assert len(bins) > 0 and check_packing([r for rows in pieces.values() for r in rows], [(d, once[d]) for d in single], packing.CAPACITY) > 0.9
    assert PATH


def test_registered():
    assert "pipeline" in entry.queries() and pipeline.ORACLE_SQL is None and len(pipeline.STAGES) == 5


def test_odd_documents_pass_all_stages(spark, sf_dir):
    rows = [(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (None, "a b c", "en", "s", 5, "x"), (None, "a b d", "en", None, 5, "x"), (2, "", "en", "s", 0, "x"),
            (3, " \n ", "en", "s", 3, "x"), (4, "word " * 40000, "en", "s", 200000, "x"), (4, "word " * 40000, "en", "s", 200000, "x"), (5, "ä\nb\nä", "de", "t", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in pipeline.STAGES:
            at = settle(stage(spark, at, sf_dir), name)
            if name != "packing":
                assert at.dtypes == docs.dtypes
        assert at.isEmpty() == empty
