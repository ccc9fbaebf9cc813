import numpy as np
import pytest
from kernelforge.functions import kernels
from kernelforge.operators.block_lu import BlockLU


@pytest.mark.parametrize("kernel", ["multiquadric", "fourier"])
def test_points_at_one_place_are_one_point_of_the_factors(spark, kernel):
    x = np.repeat(np.random.default_rng(3).random((60, 2)), [1 + i % 4 for i in range(60)], axis=0)
    x = x[np.random.default_rng(4).permutation(len(x))]
    n = len(x)
    p = spark.createDataFrame([(i, v.tolist(), float(i % 5 - 2)) for i, v in enumerate(x)], "id long, x array<double>, w double")
    lu = BlockLU(p, kernel, 0.5, -9.0, 20, 1e-11, method="svd")
    assert lu.count == 4  # tiles of 15 places, not 8 of 18 rows
    a = kernels.block(kernel, x, x, 0.5) - 9 * np.eye(n)
    got = {r.id: complex(r.w, r.wi if kernel == "fourier" else 0) for r in lu.solve(p.select("id", "w")).collect()}
    assert len(got) == n and np.allclose(a @ np.array([got[i] for i in range(n)]), [i % 5 - 2 for i in range(n)], atol=1e-7)
    several = p.selectExpr("id", "array(w, 1d) as w").where("id <> 7")
    want = np.stack([[i % 5 - 2.0 for i in range(n)], np.ones(n)], 1)
    want[7] = 0
    got = {r.id: np.array(r.w) + (1j * np.array(r.wi) if kernel == "fourier" else 0) for r in lu.solve(several).collect()}
    assert np.allclose(a @ np.array([got[i] for i in range(n)]), want, atol=1e-7)
    phase, size = lu.logdet()
    sign, true = np.linalg.slogdet(a)
    assert np.isclose(phase, sign) and abs(size - true) < 1e-6
