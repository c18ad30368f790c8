"""Whitening against a dense eigendecomposition, the Lanczos method by itself, and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries as q
from tallyforge.llm import whitening as w


def dense(vectors):
    """Integers, exact deviations, eigenvalues and projections, from the whole matrix."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centred = np.array(d, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum(a * a for a in row) for row in d], values[::-1], centred @ axes[:, ::-1]


def test_op11_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, projected = dense([r["embedding"] for r in table])
    at = {r["vec_id"]: k for k, r in enumerate(table)}
    rows = q.op11_whitening(spark, data).collect()
    assert len(rows) == 32 * n == 32 * len(at)
    got = np.full((n, 32), np.nan)
    for r in rows:
        k, c = at[r["vec_id"]], r["component"] - 1
        got[k, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviations[k]
        assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9) and r["identity_error"] == rows[0]["identity_error"] < 1e-9
    want = projected[:, :32] / np.sqrt(values[:32])
    assert np.abs(np.abs((got * want).mean(axis=0)) - 1).max() < 1e-9  # either sign
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-7
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-9


def matrix(values, seed=3):
    a = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (a * values) @ a.T


@pytest.mark.parametrize("values, want, block", [
    (np.arange(200, 0, -1.0) ** 3, 5, 5),
    (np.r_[np.full(4, 9.0), np.linspace(1, 0, 96)], 6, 2),  # a fourfold eigenvalue, blocks of two
    (np.r_[5.0, 4.0, np.zeros(58)], 3, 2),  # breakdown: rank two
    (np.ones(30), 4, 2), (np.zeros(10), 2, 2), (np.r_[1e8, 1.0, 1e-3, np.full(20, 1e-6)], 3, 3),
])
def test_lanczos(values, want, block):
    m = matrix(values)
    got, axes, passes = w.block_lanczos(lambda v: m @ v, len(values), want, block)
    top = np.sort(values)[::-1][:want]
    assert np.abs(got - top).max() <= 1e-12 * max(top[0], 1)
    assert np.abs(axes.T @ axes - np.eye(want)).max() < 1e-12
    assert np.linalg.norm(m @ axes - axes * got, axis=0).max() <= 1e-11 * max(top[0], 1)
    assert passes <= -(-len(values) // block)


def test_lanczos_ends_before_the_whole_space():
    values = np.r_[np.linspace(100, 50, 8), np.linspace(1, 0, 392)]
    m = matrix(values)
    assert w.block_lanczos(lambda v: m @ v, 400, 8, 8)[2] < 20


def test_new_block_replaces_what_breaks_down():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((20, 6)))[0]
    block = w.new_block(np.column_stack([basis[:, 0], np.zeros(20), np.ones(20)]), basis, rng)
    whole = np.column_stack([basis, block])
    assert block.shape == (20, 3) and np.abs(whole.T @ whole - np.eye(9)).max() < 1e-13
    assert w.new_block(np.ones((8, 5)), np.eye(8)[:, :6], rng).shape == (8, 2)


def test_edge_cases(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.5, -2.0, 3.0]), (2, [1.5, -2.0, 3.0]), (None, [0.25, 7.0, 1.0]), (3, None), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 0.0, 0.0]), (7, [0.5]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", *[F.lit("clash").alias(c) for c in ("key", "x", "n", "component", "i", "v", "at")])
    filled = [[1.0, 2.0, 0.5], [1.5, -2.0, 3.0], [1.5, -2.0, 3.0], [0.25, 7.0, 1.0], [0.5, 0.0, 0.0], [0.0, 0.0, 0.0]]
    n, deviations, values, projected = dense(filled)
    got = w.whiten(df).collect()
    assert len(got) == 3 * n and {r["component"] for r in got} == {1, 2, 3} and {r["n"] for r in got} == {n}
    want = sorted((i if i is None else int(i), d) for i, d in zip((1, 2, 2, -1, 7, 8), deviations))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == want
    first = sorted(abs(r["whitened"]) for r in got if r["component"] == 1)
    assert np.allclose(first, sorted(np.abs(projected[:, 0] / np.sqrt(values[0]))))
    assert abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12
    assert w.whiten(df.limit(0)).count() == w.whiten(df.where("vec_id = 3")).count() == 0
    assert w.whiten(df.where("vec_id = 1")).count() == w.whiten(df.where("vec_id = 2")).count() == w.whiten(df.where("vec_id = 8")).count() == 0  # no variance
    model = w.fit(df, 2)
    assert w.transform(df, model).count() == 2 * n and model.identity_error < 1e-9
    long = spark.createDataFrame([(k, [float((k * (j + 3)) % 17) for j in range(300)]) for k in range(40)], "vec_id int, embedding array<float>")
    assert w.whiten(long, 50).agg(F.countDistinct("component")).first()[0] == np.linalg.matrix_rank(np.cov(np.array([r[1] for r in long.collect()]).T, bias=True), tol=1e-8)


def test_large_integers(spark):
    """Deviations are exact up to the end of a long, and fail beyond it."""
    a = spark.createDataFrame([(1, [2.0e6, 0.0]), (2, [-2.0e6, 1.0]), (3, [1.0, 5.0])], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in w.whiten(a).collect()}
    assert got == dict(zip((1, 2, 3), dense([[2.0e6, 0.0], [-2.0e6, 1.0], [1.0, 5.0]])[1]))
    with pytest.raises(Exception):
        w.whiten(a.unionAll(spark.createDataFrame([(4, [1.0e12, 0.0])], "vec_id int, embedding array<double>"))).collect()
