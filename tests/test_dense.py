"""Tiles of dense operators: what they send, and exactness where products of matrices cancel out."""

import numpy as np
import pytest
from kernelforge.functions import kernels
from kernelforge.operators import dense, solvers
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def wide(spark):
    """Points in 20 dimensions far from 0, some of them copies or nearly so."""
    x = np.random.default_rng(5).random((300, 20)) + 100
    x[200:250], x[250:] = x[:50], x[:50] + 1e-9
    return x, spark.createDataFrame([(i, p.tolist(), float(i % 5 - 2)) for i, p in enumerate(x)], "id long, x array<double>, w double").cache()


def test_nearest_sends_no_tile_to_each_other(wide):
    x, df = wide
    found = dense.nearest(df, df.where("id % 3 = 0"), 4, 50)
    assert "Generate" not in plan(found)
    got = {(r.id, r.rank): (r.other, r.d2) for r in found.collect()}
    for i in range(0, 300, 3):
        d = np.zeros(300)
        for c in x.T:
            d += (c[i] - c) ** 2
        want = [j for j in np.lexsort((np.arange(300), d)) if j != i][:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, d[j]) for j in want]


@pytest.mark.parametrize("kernel", ["laplacian", "inverse_distance", "rbf"])
def test_blocks_of_many_coordinates(wide, kernel):
    x, _ = wide
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {"laplacian": np.exp(-d), "inverse_distance": np.where(d == 0, 1.0, 1 / np.where(d == 0, 1.0, d)), "rbf": np.exp(-d * d / 2)}[kernel]
    assert np.allclose(kernels.block(kernel, x, x, 1.0), want, rtol=1e-9, atol=0)


def test_composed_operators_are_applied_once(wide):
    x, df = wide
    k = dense.operator(df, "rbf", 1.0, 0.0, 64)
    made = solvers.chained(solvers.shifted(k, 1.0), k)(df.select("id", "w"))
    assert plan(made).count("MapInArrow") == 1
    a = kernels.block("rbf", x, x, 1.0)
    w, y = np.array([i % 5 - 2 for i in range(300)]), {r.id: r.y for r in made.collect()}
    assert np.allclose([y[i] for i in range(300)], a @ (a @ w) + a @ w)


def test_operator_with_missing_and_unknown_ids(spark, wide):
    x, df = wide
    apply = dense.operator(df, "rbf", 1.0, 2.0, 64)
    y = {r.id: r.y for r in apply(spark.createDataFrame([(3, 2.0), (7, None), (999, 5.0)], "id long, w double")).collect()}
    want = 2 * kernels.block("rbf", x, x[3:4], 1.0)[:, 0]
    want[3] += 4
    assert np.allclose([y[i] for i in range(300)], want)
    none = df.limit(0)
    assert dense.operator(none, "rbf", 1.0)(none.select("id", "w")).count() == 0 and dense.nearest(none, none, 3).count() == 0
