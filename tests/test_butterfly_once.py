import numpy as np
import pandas as pd

from kernelforge.functions.kernels import block
from kernelforge.operators import butterfly
from kernelforge.options import Options


def test_a_product_without_kept_factors_takes_few_rounds_and_stores_none(spark, monkeypatch):
    n, tables = 512, []
    monkeypatch.setattr(butterfly, "written", lambda df, old=butterfly.written: tables.append(old(df)) or tables[-1])
    x, k = np.arange(n)[:, None] / n, np.arange(n)[:, None] - n / 2
    rows, cols = (spark.createDataFrame(pd.DataFrame({"id": range(n), "x": v.tolist()})) for v in (x, k))
    w = np.cos(np.arange(n))
    b = butterfly.Butterfly(rows, cols, "fio", 1.0, Options(leaf=16, tol=1e-10), keep=False)
    got = b.multiply(spark.createDataFrame(pd.DataFrame({"id": range(n), "w": w}))).toPandas().sort_values("id")
    assert np.abs(got["y"].to_numpy() + 1j * got["yi"].to_numpy() - block("fio", x, k, 1.0) @ w).max() < 1e-6
    rounds = [t for t in tables if "t" in t.columns]
    assert b.depth == 5 and len(rounds) == 2  # six steps
    assert all(t.where("t is not null").count() == 0 for t in rounds)
    asked = spark.createDataFrame([(i, i * 7 % n) for i in range(0, n, 16)], "i long, j long")
    for r in b.extract(asked).collect():  # makes the factors then
        assert abs(complex(r.v, r.vi) - block("fio", x[[r.i]], k[[r.j]], 1.0)[0, 0]) < 1e-6
    assert b.statistics().count() == 6
