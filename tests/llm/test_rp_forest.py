"""The forest against all pairs of vectors."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from keepsake.llm import queries, rp_forest

SCHEMA = "vec_id long, embedding array<float>, label int, node string, leaf string, n_links string"


def all_pairs(rows, threshold=0.9):
    """(vec_id, n_links, component_id) by every pair."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for dim in {len(rows[i][1]) for i in good}:
        same = [i for i in good if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in same], np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1))):
            links[same[a]] += 1
            links[same[b]] += 1
            p, q = root(same[a]), root(same[b])
            parent[max(p, q)] = min(p, q)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return [(d, links[i], best.get(root(i))) for i, (d, _) in enumerate(rows)]


def planted(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dim))
    rows[n // 2:n // 2 + n // 4] = rows[0] + 0.04 * rng.standard_normal((n // 4, dim))
    for i in range(n // 2 + n // 4, n):
        rows[i] = rows[i - n // 2] + 0.08 * rng.standard_normal(dim)
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(d, v, 0, "n", "l", "x") for d, v in rows], SCHEMA)


@pytest.mark.parametrize("leaf,block,levels", [(1024, 2048, 8), (32, 64, 8), (24, 10, 2)])
def test_planted_groups(spark, monkeypatch, leaf, block, levels):
    monkeypatch.setattr(rp_forest, "LEVELS", levels)
    rows = planted(800)
    got = {r.vec_id: r for r in rp_forest.near_duplicates(frame(spark, rows), leaf=leaf, block=block).collect()}
    want = all_pairs(rows)
    found, there = sum(got[d].n_links for d, _, _ in want), sum(n for _, n, _ in want)
    assert len(got) == len(rows) and 0.99 * there <= found <= there
    assert all(got[d].n_links <= n for d, n, _ in want)
    same = sum(got[d].component_id == c for d, _, c in want)
    assert same >= 0.99 * len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [2.0, 0.0]), (7, [0.0, 0.0]), (8, None), (9, [nan, 1.0]), (10, [1.0, inf]), (11, [None, 1.0]),
            (12, []), (13, [1.0, 0.0, 0.0]), (14, [2.0, 0.1, 0.0]), (None, None), (15, [0.0, -3.0]), (None, [0.0, -1.0, 0.0]), (16, [3e38, 1.0])]
    got = rp_forest.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(all_pairs(rows))
    assert rp_forest.near_duplicates(frame(spark, [])).collect() == []
    assert len(rp_forest.near_duplicates(frame(spark, [(1, None)])).collect()) == 1


def test_the_table_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(queries.ORACLES["op1_rp_forest"]).fetchall()
    got = queries.op1_rp_forest(spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)
