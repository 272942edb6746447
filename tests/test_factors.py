"""Factorisations against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import factors


def cells_of(spark, a):
    return spark.createDataFrame([(int(i), f"t{j:03}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, term string, value double")


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(4)
    a = rng.random((60, 40)) * (rng.random((60, 40)) < 0.3) * rng.choice([-1, 1], (60, 40))
    a[:, 7] = rng.random(60)  # a term that all rows have
    return a


def test_svd_like_numpy(spark, matrix):
    cells = cells_of(spark, matrix)
    got = factors.truncated_svd(cells, 5, iterations=25)
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(got.values, s[:5], rtol=1e-4)
    terms = {r["term"]: r["x"] for r in got.terms.collect()}
    directions = np.array([terms.get(f"t{j:03}", [0.0] * 5) for j in range(40)]).T
    for own, want in zip(directions, vt):
        assert abs(own @ want) > 1 - 1e-4 and own[np.abs(own).argmax()] > 0
    rows = np.zeros((60, 5))
    for r in got.rows.collect():
        rows[r["row"]] = r["x"]
    assert np.allclose(rows, matrix @ directions.T, atol=1e-8)
    again = {r["row"]: r["x"] for r in factors.projected(cells, got.terms, 5).collect()}
    assert np.allclose([again[i] for i in sorted(again)], rows[sorted(again)], atol=1e-8)


def test_svd_of_low_rank_and_of_nothing(spark):
    a = np.outer(np.arange(1, 9), [1.0, 2.0, 0.0, 4.0]) + np.outer(np.ones(8), [0.0, 1.0, 1.0, 0.0])
    got = factors.truncated_svd(cells_of(spark, a), 6, iterations=5)
    assert np.allclose(got.values, np.linalg.svd(a)[1][:2]) and len(got.values) == 2
    none = factors.truncated_svd(cells_of(spark, a).limit(0), 3)
    assert none.values == [] and none.rows.count() == none.terms.count() == 0


def test_repeated_cells_add_up(spark):
    a = np.array([[1.0, 2.0], [3.0, 4.0]])
    half = cells_of(spark, a / 2)
    assert np.allclose(factors.truncated_svd(half.unionByName(half), 2, iterations=3).values, np.linalg.svd(a)[1])


def test_non_negative_like_numpy(spark, matrix):
    a = np.abs(matrix)
    cells = cells_of(spark, a)
    k, names = 3, [f"t{j:03}" for j in range(40)]
    rows, terms = factors.non_negative(cells, k, iterations=0)
    w = np.array([r["x"] for r in rows.orderBy("row").collect()])
    h = np.array([dict(map(tuple, terms.collect()))[t] for t in names]).T
    errors = [((a - w @ h) ** 2).sum()]
    for _ in range(4):
        w *= (a @ h.T) / (w @ (h @ h.T))
        h *= (w.T @ a) / ((w.T @ w) @ h)
        errors.append(((a - w @ h) ** 2).sum())
    rows, terms = factors.non_negative(cells, k, iterations=4)
    assert np.allclose([r["x"] for r in rows.orderBy("row").collect()], w)
    assert np.isclose(factors.squared_error(cells, rows, terms, k), errors[-1])
    assert all(x >= y for x, y in zip(errors, errors[1:]))
    top = factors.leading_terms(terms, 2).where("part = 1").orderBy("rank").collect()
    assert [r["term"] for r in top] == [names[j] for j in np.argsort(-h[1])[:2]]
    with pytest.raises(ValueError):
        factors.non_negative(cells.withColumn("value", -F.col("value")), 2)
