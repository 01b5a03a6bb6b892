"""Whitening against exact integers and a double-precision eigensolver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse.llm import whitening


def run(spark, rows, most=32):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, label string, n int")
    return whitening.whitened(df.repartition(3), most).collect()


def by_vector(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def compare(spark, vectors, most=32):
    """All columns against numpy's eigensolver on the centred integers."""
    got = by_vector(run(spark, list(enumerate(vectors.tolist())), most))
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    centred = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    found = int(min(most, (values > values[0] * 1e-9).sum()))
    want = centred @ basis[:, :found] / np.sqrt(values[:found])
    for i in range(n):
        assert sorted(got[i]) == list(range(1, found + 1))
        deviation = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums))
        assert all(r["deviation"] == deviation and r["n"] == n for r in got[i].values())
    made = np.array([[got[i][k]["whitened"] for k in range(1, found + 1)] for i in range(n)])
    signs = np.sign((made * want).sum(axis=0))
    gaps = np.min(np.abs(values[:found, None] - values[None] + np.diag(np.full(len(values), np.inf))[:found]), axis=1)
    apart = gaps > 1e-6 * values[0]
    assert np.abs(made - want * signs)[:, apart].max() < 1e-6
    explained = [got[0][k]["explained"] for k in range(1, found + 1)]
    assert np.allclose(explained, values[:found] / values.sum(), rtol=1e-7)
    errors = {r["identity_error"] for g in got.values() for r in g.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert np.abs(np.cov(made.T, bias=True).reshape(found, found) - np.eye(found)).max() < 1e-9


def test_against_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    compare(spark, rng.standard_normal((200, 12)) @ np.diag(np.linspace(0.1, 3, 12)) @ rng.standard_normal((12, 12)))


def test_fewer_vectors_than_dimensions(spark):
    compare(spark, np.random.default_rng(2).standard_normal((7, 20)))


def test_constant_dimensions_and_few_components(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 6))
    vectors[:, 2] = 4.0
    compare(spark, vectors, 3)


def test_equal_variances_share_a_space(spark):
    rows = [(k, [s if j == k // 2 else 0.0 for j in range(4)]) for k, s in enumerate([1.0, -1.0] * 4)]
    got = run(spark, rows)
    made = np.array([[by_vector(got)[i][k]["whitened"] for k in range(1, 5)] for i in range(8)])
    assert np.abs(made.T @ made / 8 - np.eye(4)).max() < 1e-9
    assert {r["explained"] for r in got} == {0.25}


def test_components_of_the_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    compare(spark, np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0])]
    rows += [(None, [3.0, 0.5]), (2, [0.0, 1.0]), (9, [0.0, 0.0]), (10, [1e300, 0.0])]
    got = run(spark, rows)
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == [1, 2, 9]
    assert sum(r["vec_id"] is None for r in got) == 2 and sum(r["vec_id"] == 2 for r in got) == 4
    assert {r["n"] for r in got} == {5} and max(r["identity_error"] for r in got) < 1e-12
    assert run(spark, [(1, [1.0, 2.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert run(spark, [(1, None)]) == [] and run(spark, [(1, [])]) == []


def test_deviations_beyond_a_long_are_null(spark):
    got = run(spark, [(1, [1e9, 0.0]), (2, [-1e9, 0.5]), (3, [0.0, 0.0])])
    assert {r["deviation"] is None for r in got if r["vec_id"] != 3} == {True}
    x = [(64_000_000_000, 0), (-64_000_000_000, 32), (0, 0)]
    assert {r["deviation"] for r in got if r["vec_id"] == 3} == {sum((3 * x[2][k] - sum(v[k] for v in x)) ** 2 for k in (0, 1))}


def test_sums_are_exact_for_large_entries():
    y = np.array([[2**40 + 1, -3], [5, 2**50]], np.int64)
    assert whitening._products(y).tolist() == [[(2**40 + 1) ** 2 + 25, -3 * (2**40 + 1) + 5 * 2**50], [-3 * (2**40 + 1) + 5 * 2**50, 9 + 2**100]]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 7), st.integers(0, 2**32 - 1))
def test_polynomial_modulo_a_prime(d, seed):
    rng = np.random.default_rng(seed)
    m = rng.integers(-50, 50, (d, d)).astype(object)
    if seed % 3 == 0:
        m[rng.integers(0, 2, (d, d)) == 0] = 0
    p = 2_147_483_647
    c = whitening.polynomial_modulo(m, p).tolist()
    # Cayley and Hamilton: the polynomial of the matrix is zero; trace and determinant agree
    total, power = np.zeros((d, d), object), np.eye(d, dtype=int).astype(object)
    for x in c:
        total, power = (total + x * power) % p, power.dot(m)
    assert not total.any() and c[d] == 1 and c[d - 1] == -int(np.trace(m)) % p


@pytest.mark.parametrize("roots", [[5], [1, 1, 1, 9], [4, 4, 2, 8, 16, 1], [3, 1000003, 1000004, 7, 7], [0, 0, 2, 3]])
def test_roots_are_counted_and_narrowed(roots):
    c = [1]
    for r in roots:
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    found = [
        (whitening.narrowed(c, low, high, above) if count == 1 else (low + high) / 2, count)
        for low, high, count, above in whitening.isolated_roots(c, 99)
    ]
    flat = [float(r) for r, count in found for _ in range(count)]
    assert np.allclose(flat, sorted((r for r in roots if r), reverse=True), rtol=1e-15, atol=0)


def test_null_vectors_of_close_roots():
    rng = np.random.default_rng(5)
    m = rng.integers(-9, 9, (6, 6)).astype(object)
    m = m + m.T
    m = m @ m.T
    values = np.linalg.eigvalsh(m.astype(float))
    v = whitening.null_vectors(m, Fraction(float(values[-1])), 1)[:, 0]
    assert np.abs(m.astype(float) @ v - values[-1] * v).max() < 1e-9 and math.isclose(v @ v, 1)
