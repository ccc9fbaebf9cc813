import numpy as np
import pytest
from kernelforge.functions import kernels
from kernelforge.operators import lowrank, peeling, tensors
from kernelforge.operators.butterfly import Butterfly
from kernelforge.options import Options
from kernelforge.plans.cluster import cluster
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def apart():
    rnd = np.random.default_rng(1)
    x, y = rnd.random((260, 2)), rnd.random((180, 2)) + np.array([1.5, 0])
    return x, y, kernels.block("inverse_distance", x, y, 1.0)


@pytest.mark.parametrize("method", sorted(lowrank.METHODS))
def test_compressors(apart, method):
    x, y, a = apart
    u, v = lowrank.METHODS[method](lambda i, j: kernels.block("inverse_distance", x[i], y[j], 1.0), np.arange(260), np.arange(180), 1e-7)
    assert u.shape[1] < 40 and np.linalg.norm(u @ v - a) < 3e-6 * np.linalg.norm(a)
    assert abs(lowrank.norm(u, v) - np.linalg.norm(a)) < 1e-5 * np.linalg.norm(a)
    zero = lowrank.METHODS[method](lambda i, j: np.zeros((len(i), len(j))), np.arange(150), np.arange(140), 1e-7)
    assert not (zero[0] @ zero[1]).any()


def test_sums_of_factors(apart):
    x, y, a = apart
    p, q = lowrank.METHODS["svd"](lambda i, j: a, None, None, 1e-9), lowrank.METHODS["svd"](lambda i, j: a**2, None, None, 1e-9)
    for u, v in (lowrank.add(p, q, 1e-8, 2.0), lowrank.add_crossed([p, (2 * q[0], q[1])], 1e-8)):
        assert np.allclose(u @ v, a + 2 * a**2, atol=1e-6)
    u, v = lowrank.recompress(np.concatenate((p[0], p[0]), axis=1), np.concatenate((p[1], p[1])), 1e-8)
    assert u.shape[1] <= p[0].shape[1] and np.allclose(u @ v, 2 * a, atol=1e-6)
    assert np.isclose(lowrank.grown_norm(lowrank.norm(*p) ** 2, *p, *q), np.linalg.norm(a + a**2) ** 2)
    low, rows = lowrank.lq(a, 1e-9)
    assert np.allclose(low @ rows, a, atol=1e-6) and np.allclose(rows @ rows.T, np.eye(len(rows)))
    assert np.allclose(lowrank.least_squares(a[:, :3], a[:, :3] @ np.ones(3), 1e-12), 1)


def test_stored_blocks_edges(spark):
    one = spark.createDataFrame([(7, [0.5, 0.5], 2.0)], "id long, x array<double>, w double")
    c = cluster(one.select("id", "x"), 10)
    plan = spark.createDataFrame([(1, 1, 0, "dense")], "node_m long, node_n long, level int, kind string")
    stored = lowrank.compress(c, plan, "rbf", 1.0, 1e-6, "aca", 3.0)
    assert [tuple(r) for r in lowrank.multiply(c, stored, one, "rbf").collect()] == [(7, 8.0)]
    assert lowrank.compress(c, plan.limit(0), "rbf", 1.0, 1e-6).count() == 0


def _grid(spark, n):
    x, k = np.arange(n)[:, None] / n, (np.arange(n) - n / 2)[:, None]
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    cols = spark.createDataFrame([(i, p.tolist(), float(i % 5 - 2), 1.0) for i, p in enumerate(k)], "id long, x array<double>, w double, wi double")
    return x, k, rows, cols


@pytest.mark.parametrize("kernel", ["fourier", "fio"])
def test_butterfly(spark, kernel):
    x, k, rows, cols = _grid(spark, 256)
    a, w = kernels.block(kernel, x, k, 1.0), np.array([i % 5 - 2 + 1j for i in range(256)])
    b = Butterfly(rows, cols, kernel, 1.0, Options(leaf=16, tol=1e-9))
    y = {r.id: complex(r.y, r.yi) for r in b.multiply(cols).collect()}
    assert b.depth == 4 and np.allclose([y[i] for i in range(256)], a @ w, atol=1e-4) and b.error(cols) < 1e-6
    asked = rows.select(F.col("id").alias("i"), ((F.col("id") * 7) % 256).alias("j"))
    assert max(abs(complex(r.v, r.vi) - a[r.i, r.j]) for r in b.extract(asked).collect()) < 1e-5
    numbers = b.statistics().agg(F.sum("numbers")).first()[0]
    assert numbers < 256 * 256 * 2


def test_butterfly_of_one_leaf_and_unlike_sides(spark):
    x, k, rows, cols = _grid(spark, 60)
    for few in (rows.limit(5), rows):
        n = few.count()
        b = Butterfly(few, cols, "inverse_multiquadric", 1.0, Options(leaf=16 if n > 5 else 100, tol=1e-9))
        y = {r.id: r.y for r in b.multiply(cols).collect()}
        want = kernels.block("inverse_multiquadric", x, k, 1.0) @ np.array([i % 5 - 2 for i in range(60)])
        assert len(y) == n and all(abs(y[i] - want[i]) < 1e-5 for i in y)


def test_peeling(spark):
    x = np.random.default_rng(5).random((120, 2))
    a = kernels.block("multiquadric", x, x, 1.0) + np.eye(120)
    df = spark.createDataFrame([(i, p.tolist(), [float(i % 5 - 2), 1.0]) for i, p in enumerate(x)], "id long, x array<double>, w array<double>").cache()

    def operator(v):
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, row array<double>").cache()
        w = {r.id: r.w for r in v.collect()}
        y = a @ np.array([w[i] for i in range(120)])
        return rows.select("id").join(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "id long, y array<double>"), "id")

    c = cluster(df.select("id", "x"), 30)
    got = {r.id: r.y for r in peeling.Peeled(operator, c, 1e-7, 6).multiply(df.select("id", "w")).collect()}  # the rank has to grow
    want = a @ np.stack([[i % 5 - 2 for i in range(120)], np.ones(120)], 1)
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-3 * abs(want).max())
    whole = {r.id: r.y for r in peeling.Peeled(operator, cluster(df.select("id", "x"), 200)).multiply(df.select("id", "w")).collect()}
    assert np.allclose([whole[i] for i in range(120)], want)
    with pytest.raises(ArithmeticError):
        peeling.Peeled(operator, c, 1e-7, 2, rounds=1)


def test_trains():
    rnd = np.random.default_rng(0)
    a = np.fromfunction(lambda i, j: 1 / (1 + abs(i - j)), (24, 24))
    x = rnd.random(24)
    cores = tensors.matrix_train(a, (2, 3, 4), (4, 3, 2), 1e-12)
    assert np.allclose(tensors.matrix_full(cores), a) and np.allclose(tensors.apply_full(cores, x), a @ x)
    v = tensors.tensor_train(x.reshape(4, 3, 2), 1e-12)
    y = tensors.apply_train(cores, v)
    assert np.allclose(tensors.tensor_full(y).reshape(-1), a @ x)
    short = tensors.shorten(y, 1e-10)
    assert np.allclose(tensors.tensor_full(short).reshape(-1), a @ x) and all(s.shape[0] <= c.shape[0] for s, c in zip(short, y, strict=True))
    b = rnd.random((5, 7))
    assert np.allclose(tensors.quantized_full(*tensors.quantized(b, 1e-12)), b)
    q, shape = tensors.quantized_matrix(b, 1e-12)
    assert np.allclose(tensors.quantized_apply(q, shape, np.ones(7)), b.sum(1))
    assert [tensors.power_of_two(n) for n in (1, 2, 3, 8, 9)] == [1, 2, 4, 8, 16]
    t = rnd.random((2, 3, 4))
    assert all(np.allclose(tensors.fold(tensors.unfold(t, m), m, t.shape), t) for m in range(3))
