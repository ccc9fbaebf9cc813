"""A tile's side is bounded however large a leaf is asked for."""

import numpy as np
from kernelforge.functions import kernels
from kernelforge.operators import block_lu


def test_sides_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(block_lu, "SIDE", 60)
    x = np.random.default_rng(2).random((200, 1))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    a = block_lu.BlockLU(df, "laplacian", 0.1, 0.5, 10**6, 1e-11)
    assert a.count == 4 and a.places.groupBy("i").count().agg({"count": "max"}).first()[0] <= 60
    sign, size = np.linalg.slogdet(kernels.block("laplacian", x, x, 0.1) + 0.5 * np.eye(200))
    phase, got = a.logdet()
    assert round(phase.real) == sign and abs(got - size) < 1e-8
