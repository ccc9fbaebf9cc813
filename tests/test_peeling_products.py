import numpy as np

from kernelforge.functions import kernels
from kernelforge.operators import peeling
from kernelforge.plans.cluster import cluster


def test_one_product_tells_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(peeling, "TASK", 2000)  # several rounds
    monkeypatch.setattr(peeling, "CHUNK", 2)
    n, calls = 300, []
    x = np.random.default_rng(5).random((n, 2))
    a = kernels.block("polynomial", x, x, 1.0) + 2 * np.eye(n)
    df = spark.createDataFrame([(i, p.tolist(), [float(i % 5 - 2), 1.0]) for i, p in enumerate(x)], "id long, x array<double>, w array<double>").cache()

    def operator(v):
        calls.append(1)
        w = {r.id: r.w for r in v.collect()}
        return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a @ np.array([w[i] for i in range(n)]))], "id long, y array<double>")

    made = peeling.Peeled(operator, cluster(df.select("id", "x"), 40), 1e-9, 10)
    assert len(made.rounds) == 3
    assert len(calls) == 1  # not two for each level and one for the leaves
    got = {r.id: r.y for r in made.multiply(df.select("id", "w")).collect()}
    want = a @ np.stack([np.arange(n) % 5 - 2.0, np.ones(n)], 1)
    assert np.allclose([got[i] for i in range(n)], want, rtol=0, atol=1e-10 * abs(want).max())
