"""Whitening against exact fractions and numpy's eigenvectors, and on odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from terrace.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, _v int, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", "b", 1, "c") for i, v in rows], SCHEMA)


def check(rows, got, components=8):
    """``rows`` are the usable ones."""
    x = [[math.floor(1024 * Fraction(float(np.float32(c)))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * kept and {r.n for r in got} <= {n}
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    for k in range(kept):
        want = centred @ vectors[:, k] / math.sqrt(values[k])
        have = {i: rs[0] for i, rs in by[k + 1].items()}
        signed = np.array([have[i].whitened for i, _ in rows])
        alone = min([abs(values[k] - e) for j, e in enumerate(values) if j != k], default=values[k]) > 1e-6 * values[0]
        if alone:
            assert min(abs(signed - want).max(), abs(signed + want).max()) < 1e-7
        assert abs(have[rows[0][0]].explained / (values[k] / np.trace(v)) - 1) < 1e-9
        for (i, _), r in zip(rows, x):
            exact = sum((n * c - s) ** 2 for c, s in zip(r, sums))
            assert have[i].deviation == (exact if exact < 2**63 else None)
    assert all(r.identity_error < 1e-9 for r in got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5) * [3, 2, 1, 0.5, 0.001]) for i in range(40)] + [(40, [0] * 5), (41, [1, 1, 1, 1, 1]), (42, [1, 1, 1, 1, 1])]
    bad = [(50, None), (51, []), (52, [1, None, 1, 1, 1]), (53, [float("nan")] + [1] * 4), (54, [float("-inf")] + [1] * 4), (55, [1] * 4)]
    check(good, whitening.whiten(frame(spark, good + bad)).collect())
    check(good, whitening.whiten(frame(spark, good), components=2).collect(), 2)


def test_dependent_and_equal_dimensions(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-4, 5, (60, 2))
    rows = [(i, [a, b, a + b, 2 * a, 7]) for i, (a, b) in enumerate(base)]
    check(rows, whitening.whiten(frame(spark, rows)).collect())
    square = [(i, [a, b]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    check(square, whitening.whiten(frame(spark, square)).collect())


def test_large_entries_are_exact(spark):
    rows = [(1, [3e9, 1]), (2, [-2e7, 5]), (3, [1e6, -3]), (4, [0, 0])]
    check(rows, whitening.whiten(frame(spark, rows)).collect())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_spread_gives_no_rows(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_factors():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (64, 64)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        m = a @ a.T
        low = whitening.cholesky(m)
        assert low.shape == (d, rank) and abs(low @ low.T - m).max() < 1e-12 * abs(m).max()
        pivots = [int(np.argmax(np.abs(c) > 0)) for c in low.T]
        assert len(pivots) == rank
        values, vectors = whitening.eigen(m)
        assert abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-9
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:rank], rtol=1e-9)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(rows, whitening.whiten(table).collect())
