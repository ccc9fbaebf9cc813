import numpy as np
import pandas as pd

from kernelforge.operators.butterfly import Butterfly
from kernelforge.options import Options


def test_ranks_do_not_follow_the_rounding_of_large_phases(spark):
    n, far = 256, 3e6
    x, k = np.arange(n) / n, far + np.arange(n) - n // 2
    rows, cols = (spark.createDataFrame(pd.DataFrame({"id": range(n), "x": [[float(v)] for v in s]})) for s in (x, k))
    b = Butterfly(rows, cols, "fourier", 1.0, Options(leaf=16, tol=1e-12))
    assert b.statistics().agg({"largest_rank": "max"}).first()[0] <= 48  # the rank of what the entries tell; a tolerance under their rounding doubles ranks at every step
    w = np.cos(np.arange(n))
    got = b.multiply(spark.createDataFrame(pd.DataFrame({"id": range(n), "w": w}))).toPandas().sort_values("id")
    want = np.exp(-2j * np.pi * np.outer(x, k)) @ w
    assert np.abs(got["y"].to_numpy() + 1j * got["yi"].to_numpy() - want).max() < 1e-6
