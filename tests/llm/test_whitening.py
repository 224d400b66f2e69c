"""Whitening against eigenvectors computed from the whole matrix in one place."""

import math
import random

import numpy as np
import pytest

from keepsake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long, v string"


def slow(rows, most=16):
    """(n, rows by id, explained, whitened by id) by the definition, from exact whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    xs = [(i, tuple(math.floor(64 * np.float64(np.float32(c))) + 1_000_000 for c in v) + (1_000_000,) * (width - len(v))) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    a = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], object).astype(float).reshape(n, width) / max(n, 1)
    _, s, vt = np.linalg.svd(a) if a.size else (0, np.zeros(0), 0)
    k = min(most, int((s > 1e-12 * s[0]).sum())) if s.size and s[0] else 0
    out = []
    for i, x in xs:
        d = [n * c - t for c, t in zip(x, sums)]
        out.append((i, sum(c * c for c in d), [float(np.array(d, float) / n @ vt[j] / (s[j] / math.sqrt(n))) for j in range(k)]))
    return n, out, [float(v * v / (s * s).sum()) for v in s[:k]]


def check(df, rows, most=16, tolerance=1e-7):
    n, want, share = slow(rows, most)
    got = df.collect()
    assert len(got) == len(want) * len(share)
    by_row = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        by_row.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    seen = {}
    for i, deviation, _ in want:
        seen[i, deviation] = seen.get((i, deviation), 0) + 1
    assert {k: len(v) for k, v in by_row.items()} == {k: m * len(share) for k, m in seen.items() if share}
    for c in range(1, len(share) + 1):
        pairs = [(sorted(v for k, v in by_row[i, d] if k == c)[0], w[c - 1]) for i, d, w in want]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < tolerance, c
    return got


def vectors(n, width, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(n, width)) * np.geomspace(1, 0.1, width) * scale).astype(np.float32))]


def test_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = queries.op13_whitening(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(got, [(r.vec_id, r.embedding) for r in table.collect()])


@pytest.mark.parametrize("width,n", [(1, 50), (3, 500), (16, 40), (40, 300), (40, 20)])
def test_shapes(spark, width, n):
    """Also more dimensions than vectors: as many components as there is variance for."""
    rows = vectors(n, width, seed=width)
    check(whitening.whiten(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)), rows)


def test_copies_count_once(spark):
    rows = vectors(120, 5) + [(1000 + i, vectors(1, 5, 9)[0][1]) for i in range(300)]
    got = check(whitening.whiten(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)), rows)
    assert got[0].n <= 121


def test_odd_rows(spark):
    """Null vectors and entries that are no numbers go; null ids and repeats stay; short vectors end in zeros."""
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 6) + [(None, [0.5] * 6), (7, [0.5] * 6), (100, None), (101, [nan] * 6), (102, [0.1, inf, 0.1, 0.1, 0.1, 0.1]), (103, [0.1, None, 0.1, 0.1, 0.1, 0.1]),
                             (104, [1.0, 2.0]), (105, []), (106, [0.25, -inf])]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = check(whitening.whiten(df), rows)
    assert {100, 101, 102, 103, 106}.isdisjoint(r.vec_id for r in got) and {None, 104, 105} <= {r.vec_id for r in got}
    for none in (df.limit(0), df.where("vec_id = 100"), df.where("vec_id = 7 AND embedding[0] = 0.5"), df.where("vec_id = 105")):
        assert whitening.whiten(none).collect() == []


def test_large_numbers_stay_exact(spark):
    """Large entries beside small ones: deviations are whole numbers, null beyond 64 bits."""
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 2.0**16)), float(np.float32(rng.uniform(-1, 1)))]) for i in range(80)]
    check(whitening.whiten(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)), rows)
    rows = [(i, [2.0**50 * i, 1.0]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).collect()
    assert [r.deviation for r in sorted(got)] == [None, None, 0, None, None]


def test_condition_beyond_the_square_root(spark):
    """Singular values 10^9 apart come out to several digits, where a covariance matrix would lose them."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(400, 3)))
    a = np.round(q * [3e11, 3e6, 3e2])
    rows = [(i, [float(c) / 64 for c in v]) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    distinct = np.unique(a, axis=0)
    _, s, _ = np.linalg.svd(distinct - distinct.mean(0))
    assert model.variances == pytest.approx(s**2 / len(distinct), rel=1e-5)
    assert s[0] / s[2] > 1e8 and model.identity_error < 1e-4 and model.passes >= 2


def test_one_pass_is_a_triangular_solve():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(50, 7))
    r = whitening.cholesky(a.T @ a, 50, shifted=False)
    assert np.allclose(np.triu(r), r) and np.allclose(whitening.solve_triangular(a, r) @ r, a)
    singular = np.zeros((4, 4))
    singular[0, 0] = 1
    assert np.isfinite(whitening.cholesky(singular, 50, shifted=False)).all()
