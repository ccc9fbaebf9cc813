import numpy as np
import pytest
from kernelforge.functions import kernels
from kernelforge.operators import block_lu
from kernelforge.operators.block_lu import BlockLU


def _points(spark, n, seed=3):
    x = np.random.default_rng(seed).random((n, 2))
    return x, spark.createDataFrame([(i, p.tolist(), float(i % 5 - 2)) for i, p in enumerate(x)], "id long, x array<double>, w double")


def test_factors_against_dense(spark, monkeypatch):
    monkeypatch.setattr(block_lu, "CHUNK", 3)  # sums made of partial ones from the fifth step on
    x, p = _points(spark, 390)
    a = kernels.block("multiquadric", x, x, 0.5) + 2 * np.eye(390)
    lu = BlockLU(p, "multiquadric", 0.5, 2.0, 50, 1e-10)
    assert lu.count == 8
    b = np.array([i % 5 - 2.0 for i in range(390)])
    got = {r.id: r.w for r in lu.solve(p.select("id", "w")).collect()}
    assert np.allclose(a @ np.array([got[i] for i in range(390)]), b, atol=1e-6)
    several = p.selectExpr("id", "array(w, 1d) as w").where("id <> 7").unionByName(spark.createDataFrame([(999, [1.0, 1.0])], "id long, w array<double>"))
    want = np.stack([b, np.ones(390)], 1)
    want[7] = 0
    got = {r.id: r.w for r in lu.solve(several).collect()}
    assert len(got) == 390 and np.allclose(a @ np.array([got[i] for i in range(390)]), want, atol=1e-6)
    phase, size = lu.logdet()
    sign, true = np.linalg.slogdet(a)
    assert np.isclose(phase, sign) and abs(size - true) < 1e-6
    kinds = {r.kind: r for r in lu.statistics().collect()}
    assert set(kinds) == {"dense", "low_rank"} and kinds["dense"].tiles + kinds["low_rank"].tiles == 64
    assert kinds["dense"].numbers + kinds["low_rank"].numbers < 390 * 390


def test_complex_and_edges(spark):
    x, p = _points(spark, 130, 4)
    a = kernels.block("fourier", x, x, 1.0) + 4 * np.eye(130)
    lu = BlockLU(p, "fourier", 1.0, 4.0, 40, 1e-10, method="svd")  # full rank: cross approximation stops at 1e-6
    got = {r.id: complex(r.w, r.wi) for r in lu.solve(p.selectExpr("id", "w", "0.5d as wi")).collect()}
    assert np.allclose(a @ np.array([got[i] for i in range(130)]), [i % 5 - 2 + 0.5j for i in range(130)], atol=1e-6)
    phase, size = lu.logdet()
    sign, true = np.linalg.slogdet(a)
    assert np.isclose(phase, sign, atol=1e-6) and abs(size - true) < 1e-6
    one = BlockLU(p.limit(1), "rbf", 1.0, 3.0)
    assert [r.w for r in one.solve(p.select("id", "w")).collect()] == [r.w / 4 for r in p.limit(1).collect()]
    none = BlockLU(p.limit(0), "rbf", 1.0)
    assert none.solve(p.select("id", "w")).count() == 0 and none.logdet() == (1, 0.0)
    with pytest.raises(Exception, match="[Ss]ingular"):
        BlockLU(p.selectExpr("id", "array(0d) as x"), "polynomial", 1.0, 0.0, 40).count
