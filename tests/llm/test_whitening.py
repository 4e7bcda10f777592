from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import whitening
from quarry.llm.queries import op13_embedding_whitening


def test_remainders_give_back_whole_numbers():
    for bound in (1, 10**6, 10**12, 10**30):
        p = whitening.primes(2 * bound + 1)
        assert len(p) >= 2 and len(set(p)) == len(p) and all(x < 1 << whitening.BITS for x in p)
        for x in (0, 1, -1, bound, -bound, bound // 3, -bound // 7):
            assert whitening.remaindered([x % q for q in p], p) == x


def test_modular_product_is_exact(monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**62), 2**62, (357, 5))
    for p in whitening.primes(10**20):
        want = (x.astype(object).T @ x.astype(object)) % p
        assert (whitening.gram(x, p).astype(object) == want).all()


def rows_of(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "v", None) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>, x string, z string")


def brute(vectors, scale=256):
    """Exact integers of each kept vector, the fit list, its covariance in fractions rounded to doubles."""
    import math

    x = [[math.floor(scale * float(c)) for c in v] for v in vectors]
    fit = [list(t) for t in sorted({tuple(v) for v in x})]
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[float(sum((v[i] - Fraction(s[i], n)) * (v[j] - Fraction(s[j], n)) for v in fit) / n) for j in range(d)] for i in range(d)]
    return x, fit, n, s, np.array(cov)


@pytest.mark.parametrize("scale", [256, 2**30])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(150, 6)) * np.array([3, 2.5, 1.5, 1, 0.5, 0.2])).astype(np.float32).tolist()
    vectors = base + base[:40] + [base[0]] * 60
    bad = [None, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [float("-inf")] * 6, [], [1.0] * 7]
    got = whitening.whiten(rows_of(spark, vectors + bad), scale=scale).collect()
    x, fit, n, s, cov = brute(vectors, scale)
    assert len(got) == 4 * len(vectors) and {r.vec_id for r in got} == set(range(len(vectors)))
    values, q = np.linalg.eigh(cov)
    for r in got:
        k = r.component - 1
        e, c = values[::-1][k], q.T[::-1][k]
        moved = np.array([float(v - Fraction(t, n)) for v, t in zip(x[r.vec_id], s)])
        assert r.n == n and r.deviation in (sum((n * v - t) ** 2 for v, t in zip(x[r.vec_id], s)), None)
        assert abs(abs(r.whitened) - abs(moved @ c) / e**0.5) < 1e-9
        assert abs(r.explained / (e / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9
    assert (scale > 256) or all(r.deviation is not None for r in got)
    for k in range(1, 5):  # one sign for all rows
        by = {r.vec_id: r.whitened for r in got if r.component == k}
        assert all(by[i] == by[150 + i] for i in range(40))
        assert abs(np.mean([by[x.index(v)] for v in fit])) < 1e-9


def test_edges(spark):
    assert whitening.whiten(rows_of(spark, []).limit(0)).count() == 0
    assert whitening.whiten(rows_of(spark, [None, [], [float("nan")]])).count() == 0
    one = whitening.whiten(rows_of(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    flat = whitening.whiten(rows_of(spark, [[0.0, 5.0, 1.0], [1.0, 5.0, 1.0]])).collect()
    assert sorted((r.component, r.whitened is None, r.explained) for r in flat) == sorted([(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)] * 2)
    huge = whitening.whiten(rows_of(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]], "double")).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 2)
    ids = whitening.whiten(spark.createDataFrame([(None, [1.0]), (None, [2.0]), (4, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(str(r.vec_id) for r in ids) == ["4", "None", "None"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op13_embedding_whitening(spark, sf).collect()
    assert len(got) == 4 * len(vectors) and got[0].identity_error < 1e-4
    z = np.array([[r.whitened for r in sorted((r for r in got if r.component == k), key=lambda r: r.vec_id)] for k in range(1, 5)])
    assert np.abs(np.cov(z, bias=True) - np.eye(4)).max() < 1e-8
