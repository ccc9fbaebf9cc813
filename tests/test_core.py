import duckdb
import numpy as np
import pytest
from kernelforge import options, queries
from kernelforge.functions import kernels
from kernelforge.operators import blocks_algebra as la
from kernelforge.operators import dense, nested, solvers
from kernelforge.options import Options
from kernelforge.plans import blocks
from kernelforge.plans.cluster import cluster, depth_of, tree
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def same(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "part", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]})").fetchall()
    return sorted(tuple(r[c] for c in cols) for r in df.collect()), sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    got, want = same(spark, name)
    assert got == want


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(42).random((400, 3))
    return x, spark.createDataFrame([(i, p.tolist(), float(i % 5 - 2)) for i, p in enumerate(x)], "id long, x array<double>, w double").cache()


def test_tree_and_plans(spark, cloud):
    x, df = cloud
    c = cluster(df, 50, "tm").cache()
    assert sorted(r.new_id for r in c.select("new_id").collect()) == list(range(1, 401)) and depth_of(400, 50) == 3
    t = tree(c).cache()
    for plan in (blocks.hodlr(t), blocks.hierarchical(t, 2.0)):  # the blocks tile the matrix
        assert blocks.report(plan, t).agg(F.sum("entries")).first()[0] == 400 * 400


@pytest.mark.parametrize(("order", "task"), [("ckd", 60), ("tm", 60), ("natural", 60), ("tm_gram", 200_000), ("tm_gram", 110)])
def test_rounds_give_the_same_tree(cloud, order, task):
    """Levels split by range sorts, and levels finished in a task."""
    df = cloud[1]
    made = {r.id: (r.node, r.new_id) for r in cluster(df, 30, order, ("rbf", 0.5), task).collect()}
    if order == "tm_gram":  # samples differ between the two ways
        assert sorted(v[1] for v in made.values()) == list(range(1, 401))
        return
    whole = cluster(df, 30, order).cache()
    assert made == {r.id: (r.node, r.new_id) for r in whole.collect()}
    a, b = ({r.node: (r.level, r.n, *np.round(r.center, 9), round(r.radius, 9)) for r in tree(whole, t).collect()} for t in (60, 10_000))
    assert a == b


@pytest.mark.parametrize(("kernel", "h", "strong"), [("rbf", 1.0, False), ("inverse_distance", 1.0, True), ("helmholtz", 3.0, False), ("hankel", 4.0, True)])
def test_nested_against_dense(cloud, kernel, h, strong):
    x, df = cloud
    k = kernels.block(kernel, x, x, h) + 2 * np.eye(400)
    w = np.array([i % 5 - 2 for i in range(400)], float)
    a = nested.Nested(df, kernel, h, 2.0, Options(leaf=40, tol=1e-8, strong=strong, order="ckd"))
    both = df.select("id", F.array("w", F.lit(1.0)).alias("w"))
    y = {r.id: r for r in a.multiply(both).collect()}
    got = np.array([y[i].y for i in range(400)]) + (1j * np.array([y[i].yi for i in range(400)]) if np.iscomplexobj(k) else 0)
    assert np.allclose(got, k @ np.stack([w, np.ones(400)], 1), atol=1e-4 * abs(k).sum(1).max())
    asked = df.select(F.col("id").alias("i"), ((F.col("id") * 7) % 400).alias("j"))
    for r in a.extract(asked).collect():
        assert abs(r.v + (1j * r.vi if np.iscomplexobj(k) else 0) - k[r.i, r.j]) < 1e-4
    if strong:
        with pytest.raises(ValueError, match="weak"):
            a.factor()
        return
    z = {r.id: r for r in a.solve(df).collect()}
    sol = np.array([z[i].w for i in range(400)]) + (1j * np.array([z[i].wi for i in range(400)]) if np.iscomplexobj(k) else 0)
    assert np.allclose(k @ sol, w, atol=1e-3)
    sign, logabs = np.linalg.slogdet(k)
    phase, got = a.logdet()
    assert abs(phase - sign) < 1e-4 and abs(got - logabs) < 1e-3


def test_nested_checks_and_iteration(spark, cloud):
    x, df = cloud
    k = kernels.block("rbf", x, x, 1.0) + np.eye(400)
    a = nested.Nested(df, "rbf", 1.0, 1.0, Options(leaf=60, tol=1e-9, tol_solve=1e-8))
    assert a.error(df) < 1e-6 and a.entry_error(10) < 1e-6 and a.solution_error() < 1e-6
    assert a.structure().agg(F.sum(F.col("rows") * F.col("cols"))).first()[0] == 160_000 and a.statistics().count() == a.depth
    rough = nested.Nested(df, "rbf", 1.0, 1.0, Options(leaf=60, tol=1e-2)).factor()
    w = np.array([i % 5 - 2 for i in range(400)], float)
    sol, history = a.solve_iterative(df, precondition=rough)
    assert history[-1] <= 1e-8 and len(history) < 20 and np.allclose(k @ _vector(sol, 400), w, atol=1e-4)
    values, _, errors = a.eigenpairs(2, near=1.5, steps=25)
    want = np.linalg.eigvalsh(k)
    want = want[np.argsort(abs(want - 1.5))[:2]]
    assert np.allclose(sorted(values), sorted(want), atol=1e-5)


def test_nested_edges(spark, cloud):
    """No points, one point, repeated points, values missing and to spare."""
    kind = "id long, x array<double>, w double"
    none = spark.createDataFrame([], kind)
    assert nested.Nested(none, "rbf", 1.0, 1.0).multiply(none).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0], 3.0)], kind)
    a = nested.Nested(one, "rbf", 1.0, 1.0)
    assert [tuple(r) for r in a.multiply(one).collect()] == [(5, 6.0)] and [tuple(r) for r in a.solve(one).collect()] == [(5, 1.5)]
    rows = [(i, [float(i % 3), 0.0], 1.0) for i in range(60)]
    same_ = spark.createDataFrame(rows, kind)
    x = np.array([r[1] for r in rows])
    k = kernels.block("laplacian", x, x, 1.0) + np.eye(60)
    a = nested.Nested(same_, "laplacian", 1.0, 1.0, Options(leaf=8, tol=1e-10))
    assert np.allclose(_vector(a.solve(same_), 60), np.linalg.solve(k, np.ones(60)))
    part = spark.createDataFrame([(0, None, 2.0), (1, None, None), (99, None, 7.0)], kind)
    assert np.allclose(_vector(a.multiply(part), 60, "y"), k[:, 0] * 2)


def test_options(spark):
    assert options.parse(["--leaf", "60", "--strong", "true", "--tol", "1e-6"]) == Options(leaf=60, strong=True, tol=1e-6)
    for wrong in (["--leaves", "3"], ["--leaf"], ["leaf", "3"]):
        with pytest.raises(ValueError):
            options.parse(wrong)
    assert {r.name: r.value for r in options.as_table(spark, Options()).collect()}["leaf"] == "200"


def test_kernel_columns_and_blocks(spark):
    rnd = np.random.default_rng(0)
    x, y = rnd.random((3, 3)) + 0.1, rnd.random((3, 3)) + 0.1
    df = spark.createDataFrame([(i, j, x[i].tolist(), y[j].tolist()) for i in range(3) for j in range(3)], "i int, j int, x array<double>, y array<double>")
    params = {"laplacian_low_rank": (0.5, 3), "wave": (2.0, 3)}
    for name in kernels.KERNELS:
        h = params.get(name, 0.7)
        got = np.array([r.v for r in df.select("i", "j", kernels.entry(name, F.col("x"), F.col("y"), h).alias("v")).orderBy("i", "j").collect()])
        assert np.allclose(got.reshape(3, 3), kernels.block(name, x, y, h))
    for name in kernels.PHASES:
        re, im = kernels.phase_entry(name, F.col("x"), F.col("y"), 16.0, 3)
        got = np.array([complex(r.re, r.im) for r in df.select("i", "j", re.alias("re"), im.alias("im")).orderBy("i", "j").collect()])
        assert np.allclose(got.reshape(3, 3), kernels.block(name, x, y, 16.0)) and kernels.is_complex(name)
    assert [kernels.bit_reversed(i, 3) for i in range(8)] == [0, 4, 2, 6, 1, 5, 3, 7]
    # Values of the functions' published tables.
    j, y0 = kernels.bessel0(np.array([0.5, 1.0, 5.0, 10.0, 13.9, 14.1, 50.0]))
    assert np.allclose(j[:4], [0.938469807240813, 0.765197686557967, -0.177596771314338, -0.245935764451348], atol=1e-9) and np.allclose(y0[:4], [-0.444518733506707, 0.088256964215677, -0.308517625249034, 0.055671167283599], atol=1e-9)
    assert np.allclose([j[6], y0[6]], [0.055812327669252, -0.098064995470077], atol=1e-11) and abs(j[4] - j[5]) < 0.05


def test_blocks_algebra():
    rnd = np.random.default_rng(0)
    low = rnd.random((60, 5)) @ rnd.random((5, 40))
    for f in (la.svd, la.rrqr):
        u, v = f(low, 1e-10)
        assert u.shape[1] == 5 and np.allclose(u @ v, low)
    u, v = la.aca(lambda i: low[i], lambda j: low[:, j], 60, 40, 1e-10)
    assert np.allclose(u @ v, low)
    u, v = la.randomized(lambda x: low @ x, lambda x: low.T @ x, 60, 40, 1e-10, guess=2)
    assert np.allclose(u @ v, low) and len(v) == 5
    cols, t = la.interpolative(low, 1e-10)
    assert np.allclose(low[:, cols] @ t, low)
    x = np.sort(rnd.random((256, 1)), axis=0)
    k = kernels.block("rbf", x, x, 0.3) + np.eye(256)
    h = la.Hodlr(lambda i, j: k[np.ix_(i, j)], np.arange(256), 32, 1e-12)
    b = rnd.random(256)
    assert np.allclose(h.multiply(b), k @ b) and np.allclose(h.solve(b), np.linalg.solve(k, b))
    assert np.allclose(h.logdet(), np.linalg.slogdet(k))
    a = np.fromfunction(lambda i, j, m, n: 1 / (1 + i + j + m + n), (6, 6, 6, 6))
    assert np.allclose(la.tensor_full(la.tensor_train(a, 1e-9)), a, atol=1e-8)
    assert np.allclose(la.tensor_full(la.quantized_train(np.arange(64.0), 1e-12)).reshape(-1), np.arange(64.0))


def test_ridge(spark, cloud):
    x, df = cloud
    train = df.withColumn("label", F.when(F.element_at("x", 1) > 0.5, 1).otherwise(-1))
    w = nested.ridge_fit(train, "rbf", 0.3, 1.0, Options(leaf=120))
    got = nested.ridge_predict(df, w, "rbf", 0.3).join(train.select("id", F.col("label").alias("want")), "id")
    assert got.where("label = want").count() > 370


def test_colors(spark):
    pairs = [(a, b) for a in range(20) for b in range(20) if abs(a - b) <= 2]
    color = dict(blocks.colors(spark.createDataFrame(pairs, "node_m long, node_n long")).collect())
    assert len(color) == 20 and all(color[a] != color[b] for a in range(20) for b in range(20) if 0 < abs(a - b) <= 4)


def test_near_neighbours(cloud):
    x, df = cloud
    c = cluster(df, 50).cache()
    got = dense.near_nearest(c, blocks.near_leaves(tree(c), 20.0), 4).collect()
    exact = {(r.id, r.other) for r in dense.nearest(df, df, 4).collect()}
    assert len(got) == 1600 and len({(r.id, r.other) for r in got} & exact) > 1500


def _operator(spark, a):
    """A small dense matrix as an operator on (id, w)."""
    rows = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "id long, j long, v double").cache()
    return lambda v: rows.join(v.select(F.col("id").alias("j"), "w"), "j").groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("y"))


def _vector(df, n, name="w"):
    found = {r.id: r[name] for r in df.collect()}
    return np.array([found[i] for i in range(n)])


@pytest.mark.parametrize("method", ["gmres", "tfqmr", "refine"])
def test_solvers(spark, method):
    rnd = np.random.default_rng(3)
    a, w = np.eye(20) * 3 + rnd.random((20, 20)) / 10, rnd.random(20)
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "id long, w double")
    given = {"restart": 3} if method == "gmres" else {"precondition": lambda v: v.select("id", (F.col("w") / 3.2).alias("y"))} if method == "refine" else {}
    x, history = solvers.solve(_operator(spark, a), b, method, tol=1e-5, most=40, **given)
    assert history[-1] <= 1e-5 and np.allclose(_vector(x, 20), np.linalg.solve(a, w), atol=1e-4)
    x, history = solvers.solve(_operator(spark, a), b.withColumn("w", F.lit(0.0)), method)
    assert history == [0.0] and not _vector(x, 20).any()


def test_eigenpairs(spark):
    rnd = np.random.default_rng(4)
    a = rnd.random((10, 10))
    a = a + a.T
    values, vectors, errors = solvers.eigenpairs(_operator(spark, a), spark.range(10), 2, 10)
    want = np.linalg.eigvalsh(a)
    want = want[np.argsort(-np.abs(want))[:2]]
    v = _vector(vectors, 10, "v0")
    assert errors.max() <= 1e-8 and np.allclose(values, want) and np.allclose(a @ v, values[0] * v)
