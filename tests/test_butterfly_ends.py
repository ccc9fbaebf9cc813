import numpy as np
import pandas as pd

from kernelforge.functions.kernels import block
from kernelforge.operators.butterfly import Butterfly
from kernelforge.options import Options


def test_rows_at_the_ends_are_as_good_as_others_when_rows_are_sampled(spark):
    n = 2048
    x, k = np.arange(n)[:, None] / n, np.arange(n)[:, None] - n / 2
    rows, cols = (spark.createDataFrame(pd.DataFrame({"id": range(n), "x": v.tolist()})) for v in (x, k))
    w = np.cos(np.arange(n))
    got = Butterfly(rows, cols, "fio", 1.0, Options(leaf=32, tol=1e-12, samples=150)).multiply(spark.createDataFrame(pd.DataFrame({"id": range(n), "w": w}))).toPandas().sort_values("id")
    off = np.abs(got["y"].to_numpy() + 1j * got["yi"].to_numpy() - block("fio", x, k, 1.0) @ w)
    assert off.max() < 1e-5, (off.max(), off.argmax())
