"""Whitening against dense eigensolvers and exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import whitening
from lorespark.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, n int"


def plain(rows, k=16):
    """n, sums, deviations by row, leading eigenvalues and |whitened| of the contract, by numpy."""
    def usable(v):
        return v is not None and all(c is not None and math.isfinite(c) for c in v)

    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if usable(v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
    value, vectors = np.linalg.eigh(centred.T @ centred / n)
    own = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for _, x in kept])
    value, vectors = value[::-1][:k], vectors[:, ::-1][:, :k]
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, dev, value, value / np.trace(centred.T @ centred / n), np.abs(own @ vectors / np.sqrt(value)), kept


def frame(spark, rows):
    made = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    return made.withColumn("component", F.lit("clash")).withColumn("x", F.lit(None)).repartition(3)


def check(spark, rows, components):
    n, dev, value, explained, white, kept = plain(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == len(kept) * components
    assert {r.n for r in got} == {n}
    assert sorted({(r.vec_id, r.deviation) for r in got}, key=repr) == sorted(set(dev), key=repr)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    for c in range(1, components + 1):
        own = [r for r in got if r.component == c]
        assert np.allclose({r.explained for r in own}.pop(), explained[c - 1], rtol=1e-9)
        assert np.allclose(sorted(abs(r.whitened) for r in own), sorted(white[:, c - 1]), rtol=1e-6, atol=1e-8)


def test_inertia_counts_positive_eigenvalues():
    rng = np.random.default_rng(1)
    for _ in range(60):
        d = int(rng.integers(1, 14))
        a = rng.standard_normal((d, d))
        a = a + a.T
        if d > 3:
            a[np.diag_indices(d)] *= rng.integers(0, 2)
        assert whitening.positive(a) == int((np.linalg.eigvalsh(a) > 0).sum())
    assert whitening.positive(np.zeros((3, 3))) == 0 and whitening.positive(np.diag([2.0, 0.0, -1.0])) == 1


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 40, 40), np.geomspace(1e-9, 1e3, 30), np.ones(25), np.r_[np.ones(12), np.full(10, 3.0), 9.0],
    np.r_[np.zeros(20), 1e-4, 1.0, 2.0], np.r_[np.linspace(1, 1 + 1e-10, 20), 5.0], [4.0], np.zeros(5)], ids=range(8))
def test_eigenpairs_of_known_spectra(spark, spectrum):
    d = len(spectrum)
    turn, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = turn @ np.diag(spectrum) @ turn.T
    v = (v + v.T) / 2
    value, vectors = whitening.eigenpairs(spark, v, 16)
    want = [x for x in sorted(spectrum, reverse=True) if x > 1e-12 * max(spectrum)][:16]
    scale = max(1e-300, max(spectrum))
    assert len(value) == len(want) and np.allclose(value, want, rtol=0, atol=1e-12 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(value)), atol=1e-12)
    assert np.abs(v @ vectors - vectors * value).max(initial=0) <= 1e-12 * scale


def test_missed_eigenvalues_are_an_error():
    with pytest.raises(ArithmeticError):
        whitening.slice_pairs(np.diag([1.0, 2.0, 3.0, 40.0, 50.0, 60.0]), 0.5, 3.5, 4, 60.0)


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    made = rng.normal(0, 1, (300, 24)) @ np.diag(np.geomspace(0.5, 6, 24))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    rows += [(None, rows[1][1]), (None, [float(x) for x in rng.normal(0, 2, 24)]), (3, rows[3][1]), (-9, rows[5][1])]
    rows += [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] * 24)]
    check(spark, rows, 16)


def test_fewer_components_than_asked(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, [float(x) for x in rng.normal(0, 3, 5)]) for i in range(40)], 5)
    # Two distinct vectors have one component.
    got = whitening.whiten(frame(spark, [(i, [float(i % 2), 5.0, -2.0]) for i in range(9)])).collect()
    assert [(r.component, round(abs(r.whitened), 9), r.explained) for r in got] == [(1, 1.0, 1.0)] * 9


def test_rows_of_other_widths_and_large_entries(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(20)] + [(50, [1.0]), (51, []), (52, [1.0, 2.0, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == set(range(20)) and len(got) == 40
    rows = [(i, [float(i), 1e300 if i == 0 else 1.0]) for i in range(20)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} or len(got) == 20 * max(r.component for r in got)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])], [(i, [2.0, 3.0]) for i in range(5)], [(1, [])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_exact_products(monkeypatch):
    rng = np.random.default_rng(6)
    for size in (3, 2**20, 2**25, 2**41):
        x = rng.integers(-size, size + 1, (50, 4))
        assert (whitening.exact_gram(x) == x.astype(object).T @ x.astype(object)).all()
        limbs = whitening._limbs(whitening.exact_gram(x).ravel())
        total = [int(a) + (int(b) << 30) + (int(c) << 60) for a, b, c in zip(*limbs, strict=True)]
        assert total == list(whitening.exact_gram(x).ravel())


def test_query_against_a_dense_solver(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in given]
    n, dev, value, explained, white, kept = plain(rows)
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, d) for i, d in dev}
    place = {i: p for p, (i, _) in enumerate(kept)}
    assert len(got) == 16 * len(kept)
    for r in got:
        assert math.isclose(abs(r.whitened), white[place[r.vec_id], r.component - 1], rel_tol=1e-7, abs_tol=1e-8)
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-10) and r.identity_error < 1e-9
