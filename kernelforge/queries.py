"""Registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.operators import dense, lowrank, solvers
from kernelforge.operators.block_lu import BlockLU
from kernelforge.operators.butterfly import Butterfly
from kernelforge.operators.nested import Nested, ridge_fit, ridge_predict
from kernelforge.operators.peeling import Peeled
from kernelforge.options import Options
from kernelforge.plans import blocks
from kernelforge.plans.cluster import cluster, tree
from kernelforge.shared import written
from kernelforge.sources import points

FLAGSHIP = "hodlr_multiply_parts"
_D = "list_distance(a.x, b.x)"
_EMB = "WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, CASE WHEN label % 2 = 0 THEN 1.0 ELSE -1.0 END AS w FROM embeddings)"
#: kernel -> (h, SQL of the entry for rows a and b)
FORMS = {
    "rbf": (1.0, f"CASE WHEN {_D}*{_D} > 138.15510557964274 THEN 0.0 ELSE exp(-{_D}*{_D}/2.0) END"),
    "power4": (1.0, f"pow({_D}, 8)"),
    "multiquadric": (0.5, f"sqrt({_D}*{_D} + 0.5)"),
    "inverse_multiquadric": (0.5, f"1.0/sqrt({_D}*{_D} + 0.5)"),
    "polynomial": (1.0, "pow(list_dot_product(a.x, b.x) + 1.0, 2)"),
    "laplacian": (1.0, f"exp(-{_D})"),
    "inverse_distance": (1.0, f"CASE WHEN a.id = b.id THEN 1.0 ELSE 1.0/{_D} END"),
    "helmholtz_re": (2.0, f"CASE WHEN a.id = b.id THEN 1.0 ELSE cos(2.0*{_D})/{_D} END"),
    "helmholtz_im": (2.0, f"CASE WHEN a.id = b.id THEN 0.0 ELSE -sin(2.0*{_D})/{_D} END"),
    "fourier_re": (1.0, "cos(2*pi()*list_dot_product(a.x, b.x))"),
    "fourier_im": (1.0, "-sin(2*pi()*list_dot_product(a.x, b.x))"),
}


def _multiply(kernel: str, h: float):
    def query(spark, sf_dir: str) -> DataFrame:
        p = points.embeddings(spark, sf_dir)
        return dense.multiply(p, p, kernel, h).select("id", F.round("y", 3).alias("y"))

    return query


def norms(spark, sf_dir: str) -> DataFrame:
    return dense.norms(points.embeddings(spark, sf_dir), "rbf", 1.0).select(*(F.round(c, 4).alias(c) for c in ("frobenius", "one", "infinity", "max")))


def extract(spark, sf_dir: str) -> DataFrame:
    p = points.embeddings(spark, sf_dir)
    asked = p.select(F.col("id").alias("i"), ((F.col("id") * 7) % p.count()).alias("j"))
    return dense.extract(p, asked, "laplacian", 1.0, 0.5).select("i", "j", F.round("v", 6).alias("v"))


def nearest(spark, sf_dir: str) -> DataFrame:
    p = points.embeddings(spark, sf_dir)
    return dense.nearest(p, p.where("id % 20 = 0"), 8).select("id", "rank", "other", F.round("d2", 6).alias("d2"))


def gram_distance(spark, sf_dir: str) -> DataFrame:
    from kernelforge.functions.kernels import entry, gram_distance

    p = points.embeddings(spark, sf_dir)
    a, b = p.select(F.col("id").alias("i"), F.col("x").alias("xi")), p.select(F.col("id").alias("j"), F.col("x").alias("xj"))
    z = lambda u, v: entry("polynomial", F.col(u), F.col(v), 1.0)
    return a.withColumn("j", (F.col("i") * 3 + 1) % p.count()).join(b, "j").select("i", "j", F.round(gram_distance(z("xi", "xj"), z("xi", "xi"), z("xj", "xj")), 6).alias("d"))


def _cluster(order: str):
    def query(spark, sf_dir: str) -> DataFrame:
        return cluster(points.parts(spark, sf_dir), 60, order).select("id", "node", "new_id")

    return query


def tree_shape(spark, sf_dir: str) -> DataFrame:
    t = tree(cluster(points.parts(spark, sf_dir), 60, "natural"))
    return t.select("node", "level", "n", F.round(F.element_at("center", 1), 6).alias("c1"), F.round(F.element_at("center", 2), 6).alias("c2"), F.round("radius", 6).alias("radius"))


def hodlr_plan(spark, sf_dir: str) -> DataFrame:
    return blocks.hodlr(tree(cluster(points.parts(spark, sf_dir), 60, "ckd")))


def h_plan(spark, sf_dir: str) -> DataFrame:
    t = tree(cluster(points.parts(spark, sf_dir), 60, "ckd"))
    return blocks.report(blocks.hierarchical(t, 2.1), t)


def blr_plan(spark, sf_dir: str) -> DataFrame:
    t = tree(cluster(points.parts(spark, sf_dir), 60, "ckd"))
    return blocks.hierarchical(t, 2.1, start=2, blr=True)


def near_nearest(spark, sf_dir: str) -> DataFrame:
    c = cluster(points.parts(spark, sf_dir), 60, "ckd")
    return dense.near_nearest(c, blocks.near_leaves(tree(c), 20.0), 5)


def cluster_lineitem(spark, sf_dir: str) -> DataFrame:
    return cluster(points.lineitems(spark, sf_dir), 500, "ckd").select("id", "node", "new_id")


def cluster_gram(spark, sf_dir: str) -> DataFrame:
    """Sizes of the leaves of a tree made from kernel entries alone."""
    return cluster(points.parts(spark, sf_dir), 60, "tm_gram", ("rbf", 0.5)).groupBy("node").agg(F.count("*").alias("n"))


def periodic_plan(spark, sf_dir: str) -> DataFrame:
    t = tree(cluster(points.parts(spark, sf_dir), 60, "ckd"))
    return blocks.report(blocks.hierarchical(t, 2.1, periods=(1.0, 0.0)), t)


def hodlr_multiply_parts(spark, sf_dir: str) -> DataFrame:
    p = points.parts(spark, sf_dir)
    return Nested(p, "inverse_multiquadric", 1.0, 0.0, Options(leaf=100, tol=1e-11)).multiply(p).select("id", F.round("y", 3).alias("y"))


def h_multiply(spark, sf_dir: str) -> DataFrame:
    """Strong admissibility, two right-hand sides at once."""
    p = points.parts(spark, sf_dir)
    w = p.select("id", F.array("w", F.lit(1.0)).alias("w"))
    y = Nested(p, "multiquadric", 0.5, 2.0, Options(leaf=100, tol=1e-11, strong=True)).multiply(w)
    return y.select("id", F.round(F.col("y")[0], 3).alias("y1"), F.round(F.col("y")[1], 3).alias("y2"))


def hodlr_multiply_complex(spark, sf_dir: str) -> DataFrame:
    """A complex kernel and a complex vector."""
    p = points.parts(spark, sf_dir)
    w = p.select("id", "w", F.lit(0.5).alias("wi"))
    return Nested(p, "fourier", 1.0, 0.0, Options(leaf=100, tol=1e-11)).multiply(w).select("id", F.round("y", 3).alias("y"), F.round("yi", 3).alias("yi"))


def _stiff(spark, sf_dir: str, tol: float, **options) -> tuple[DataFrame, Nested]:
    p = points.parts(spark, sf_dir)
    return p, Nested(p, "rbf", 0.3, 5.0, Options(leaf=100, tol=tol, **options))


def hodlr_solve(spark, sf_dir: str) -> DataFrame:
    """A direct solve."""
    p, a = _stiff(spark, sf_dir, 1e-11)
    return a.solve(p).select("id", F.round("w", 5).alias("w"))


def hodlr_solve_preconditioned(spark, sf_dir: str) -> DataFrame:
    """The exact matrix solved by GMRES, with factors at a loose tolerance as its preconditioner."""
    p, rough = _stiff(spark, sf_dir, 1e-4)
    x, _ = solvers.gmres(dense.operator(p, "rbf", 0.3, 5.0), p.select("id", "w"), 1e-9, 40, precondition=lambda v: rough.solve(v).withColumnRenamed("w", "y"))
    return x.select("id", F.round("w", 5).alias("w"))


def hodlr_logdet(spark, sf_dir: str) -> DataFrame:
    phase, logabs = Nested(points.suppliers(spark, sf_dir), "laplacian", 0.1, 0.5, Options(leaf=16, tol=1e-11)).logdet()
    return spark.createDataFrame([(round(phase.real), round(logabs, 6))], "sign long, logabs double")


def hodlr_entries(spark, sf_dir: str) -> DataFrame:
    """Entries of the compressed matrix."""
    p = points.parts(spark, sf_dir)
    asked = p.select(F.col("id").alias("i"), ((F.col("id") * 37) % p.count()).alias("j"))
    return Nested(p, "inverse_multiquadric", 1.0, 0.0, Options(leaf=100, tol=1e-11)).extract(asked).select("i", "j", F.round("v", 6).alias("v"))


def hodlr_structure(spark, sf_dir: str) -> DataFrame:
    """Blocks by level and kind, with what they hold at most."""
    made = Nested(points.parts(spark, sf_dir), "inverse_multiquadric", 1.0, 0.0, Options(leaf=100, tol=1e-3)).structure()
    return made.groupBy("level", "kind").agg(F.count("*").alias("blocks"), F.sum(F.col("rows") * F.col("cols")).cast("long").alias("entries"), (F.max("rank_m") <= 100).alias("low"))


def ridge(spark, sf_dir: str) -> DataFrame:
    """Kernel ridge regression: fitted on the parts whose key is no multiple of 5, applied to the others."""
    p = points.parts(spark, sf_dir).withColumn("label", F.when(F.element_at("x", 1) > 0.5, 1).otherwise(-1))
    w = ridge_fit(p.where("id % 5 <> 0"), "rbf", 0.3, 5.0, Options(leaf=100, tol=1e-11))
    return ridge_predict(p.where("id % 5 = 0"), w, "rbf", 0.3).select("id", F.round("y", 5).alias("y"))


def _ridge(p: DataFrame, ridge: float):
    """The exact kernel matrix of p plus a ridge, as an operator."""
    return dense.operator(p, "rbf", 1.0, ridge)


def _solve(method: str):
    def query(spark, sf_dir: str) -> DataFrame:
        p = points.embeddings(spark, sf_dir)
        x, _ = solvers.solve(_ridge(p, 20.0), p.select("id", "w"), method, tol=1e-10, most=60, precondition=dense.low_degrees(p, 1.0, 20.0))
        return x.select("id", F.round("w", 7).alias("w"))

    return query


def composed(spark, sf_dir: str) -> DataFrame:
    """2 (K + I) K w + w / 2, by composed operators."""
    p = points.embeddings(spark, sf_dir)
    k = _ridge(p, 0.0)
    made = solvers.added((2.0, solvers.chained(solvers.shifted(k, 1.0), k)), (0.5, solvers.identity))
    return made(p.select("id", "w")).select("id", F.round("y", 3).alias("y"))


def eigenvalues(spark, sf_dir: str) -> DataFrame:
    """The three largest, each with whether it has converged."""
    p = points.parts(spark, sf_dir)
    values, _, errors = Nested(p, "rbf", 1.0, 0.0, Options(leaf=100, tol=1e-11)).eigenpairs(3, steps=40, tol=1e-7)
    return spark.createDataFrame([(i + 1, float(v), bool(e <= 1e-7)) for i, (v, e) in enumerate(zip(values, errors, strict=True))], "rank int, value double, converged boolean").select("rank", F.round("value", 3).alias("value"), "converged")


def _stored(method: str, transpose: bool = False):
    def query(spark, sf_dir: str) -> DataFrame:
        """Far blocks of a strong plan of the parts' places compressed one by one and stored, near ones dense; then a product, of the transposed matrix if asked."""
        p = points.parts(spark, sf_dir)

        def made(places: DataFrame):
            c = written(cluster(places, 100, "ckd"))
            stored = written(lowrank.compress(c, blocks.hierarchical(tree(c), 2.1), "inverse_multiquadric", 1.0, 1e-12, method))
            return lambda w: lowrank.multiply(c, stored, w, "inverse_multiquadric", transpose)

        return dense.by_place(p, made)(p.select("id", "w")).select("id", F.round("y", 2).alias("y"))

    return query


def far_norms(spark, sf_dir: str) -> DataFrame:
    """Frobenius norms of a plan's far blocks by level, from their factors."""
    c = cluster(points.parts(spark, sf_dir).select("id", "x"), 60, "ckd")
    made = lowrank.compress(c, blocks.hierarchical(tree(c), 2.1), "inverse_multiquadric", 1.0, 1e-10, "aca").where("kind = 'low_rank'")
    return made.groupBy("level").agg(F.count("*").alias("blocks"), F.round(F.sqrt(F.sum("norm2")), 4).alias("norm"))


def _waves(kernel: str):
    def query(spark, sf_dir: str) -> DataFrame:
        """Places of the parts in the unit interval against frequencies about 0, as many."""
        p = points.parts(spark, sf_dir)
        n = p.count()
        rows = p.select("id", F.array((F.col("id") - 1) / F.lit(float(n))).alias("x"))
        cols = p.select("id", F.array((F.col("id") - 1 - F.lit(n // 2)).cast("double")).alias("x"), "w")
        return Butterfly(rows, cols, kernel, 1.0, Options(leaf=64, tol=1e-12), keep=False).multiply(cols).select("id", F.round("y", 2).alias("y"), F.round("yi", 2).alias("yi"))

    return query


def black_box(spark, sf_dir: str) -> DataFrame:
    """The matrix of the parts' places rebuilt from its products alone, then applied to all parts."""
    p = points.parts(spark, sf_dir)

    def made(places: DataFrame):
        operator = Nested(places, "polynomial", 1.0, 0.0, Options(leaf=250, tol=1e-13)).multiply
        rebuilt = Peeled(operator, cluster(places, 250, "ckd"), 1e-9, 10)
        return lambda w: rebuilt.multiply(w.select("id", F.array("w").alias("w"))).select("id", F.col("y")[0].alias("y"))

    return dense.by_place(p, made, 2.0)(p.select("id", "w")).select("id", F.round("y", 2).alias("y"))


def blr_solve(spark, sf_dir: str) -> DataFrame:
    """A direct solve by block LU of 8 to 16 tiles a side."""
    p = points.parts(spark, sf_dir)
    return BlockLU(p, "rbf", 0.3, 5.0, max(250, p.count() // 16), 1e-11).solve(p).select("id", F.round("w", 5).alias("w"))


def blr_logdet(spark, sf_dir: str) -> DataFrame:
    s = points.suppliers(spark, sf_dir)
    phase, logabs = BlockLU(s, "laplacian", 0.1, 0.5, max(32, s.count() // 4), 1e-11).logdet()
    return spark.createDataFrame([(round(phase.real), round(logabs, 6))], "sign long, logabs double")


QUERIES = {f"multiply_{k}": _multiply(k, h) for k, (h, _) in FORMS.items()}
QUERIES |= {f"cluster_{k}": _cluster(k) for k in ("natural", "ckd", "tm")}
QUERIES |= {f.__name__: f for f in (norms, extract, nearest, gram_distance, tree_shape, hodlr_plan, h_plan, blr_plan, near_nearest, cluster_lineitem, cluster_gram, periodic_plan)}
QUERIES |= {f.__name__: f for f in (hodlr_multiply_parts, h_multiply, hodlr_multiply_complex, hodlr_solve, hodlr_solve_preconditioned, hodlr_logdet, hodlr_entries, hodlr_structure, ridge, composed, eigenvalues)}
QUERIES |= {f"solve_{m}": _solve(m) for m in ("gmres", "tfqmr")}
QUERIES |= {"stored_multiply": _stored("merged"), "stored_multiply_transposed": _stored("batch_aca", True), "far_norms": far_norms, "butterfly_fourier": _waves("fourier"), "butterfly_fio": _waves("fio"), "black_box": black_box, "blr_solve": blr_solve, "blr_logdet": blr_logdet}


_PARTS = "SELECT p_partkey AS id, p_size/50.0 AS x1, p_retailprice/2000.0 AS x2, p_partkey % 7 / 7.0 AS w FROM part"
_ITEMS = "SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity/50.0 AS x1, l_extendedprice/105000.0 AS x2, l_discount/0.1 AS x3, l_tax/0.08 AS x4 FROM lineitem"


def _extents(dim: int) -> str:
    return ", ".join(f"max(x{i}) OVER g - min(x{i}) OVER g AS e{i}" for i in range(1, dim + 1))


def _widest(dim: int) -> str:
    """The coordinate of largest extent, the first of equals."""
    return "CASE " + " ".join(f"WHEN e{i} >= greatest({', '.join(f'e{j}' for j in range(1, dim + 1))}) THEN x{i}" for i in range(1, dim + 1)) + " END"


def _keyed(rows: str, key: str, dim: int) -> str:
    """rows with the key that sorts them in their node; tm: the distance to the row farthest from the centroid."""
    if key != "tm":
        return f"SELECT *, {key} AS key FROM (SELECT *, {_extents(dim)} FROM {rows} WINDOW g AS (PARTITION BY node))"
    gap = lambda a, b: "sqrt(" + " + ".join(f"({a.format(i)} - {b.format(i)}) * ({a.format(i)} - {b.format(i)})" for i in range(1, dim + 1)) + ")"
    centers = ", ".join(f"avg(x{i}) OVER g AS c{i}" for i in range(1, dim + 1))
    ends = ", ".join(f"arg_max(x{i}, (d, id)) OVER g AS f{i}" for i in range(1, dim + 1))
    return f"SELECT *, {gap('x{}', 'f{}')} AS key FROM (SELECT *, {ends} FROM (SELECT *, {gap('x{}', 'c{}')} AS d FROM (SELECT *, {centers} FROM {rows} WINDOW g AS (PARTITION BY node))) WINDOW g AS (PARTITION BY node))"


def _split_sql(levels: int, key: str, source: str, dim: int) -> str:
    """Common table expressions l0 .. of (id, x1 .., node), each level split at its groups' medians."""
    xs = ", ".join(f"x{i}" for i in range(1, dim + 1))
    out = f"WITH l0 AS MATERIALIZED (SELECT id, {xs}, 1::BIGINT AS node FROM ({source}))"
    for k in range(levels):
        out += f", l{k + 1} AS MATERIALIZED (SELECT id, {xs}, node*2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY key, id) > (count(*) OVER (PARTITION BY node) + 1)//2 THEN 1 ELSE 0 END AS node FROM ({_keyed(f'l{k}', key, dim)}))"
    return out


def _levels_sql(key: str, rows: str, source: str = _PARTS, dim: int = 2, leaf: int = 60, most: int = 9) -> str:
    """The unrolled tree at whichever depth the table has, up to ``most``."""
    parts = [f"SELECT * FROM l{k} WHERE (SELECT {'true' if k == 0 else f'n >> {k - 1} > {leaf}'} AND n >> {k} <= {leaf} FROM (SELECT count(*) AS n FROM l0))" for k in range(most + 1)]
    return f"{_split_sql(most, key, source, dim)}, leaf AS ({' UNION ALL '.join(parts)}), {rows}"


def _ordered(key: str, dim: int = 2) -> str:
    return f"last AS ({_keyed('leaf', key, dim)}) SELECT id, node, row_number() OVER (ORDER BY node, key, id) AS new_id FROM last"


def _cg_sql(steps: int) -> str:
    """Tables s0 .. of (id, x, r, p): conjugate gradients on the matrix k (i, j, v) and the vector b (id, w), unrolled."""
    out = ", s0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS x, w::DOUBLE AS r, w::DOUBLE AS p FROM b)"
    for n in range(steps):
        out += f", q{n} AS MATERIALIZED (SELECT i AS id, sum(v * p) AS q FROM k JOIN s{n} ON j = id GROUP BY i)"
        out += f", a{n} AS MATERIALIZED (SELECT sum(r * r) AS rr, coalesce(sum(r * r) / nullif(sum(p * q), 0), 0) AS alpha FROM s{n} JOIN q{n} USING (id))"
        out += f", t{n} AS MATERIALIZED (SELECT id, x + alpha * p AS x, r - alpha * q AS r, p, rr FROM s{n} JOIN q{n} USING (id), a{n})"
        out += f", s{n + 1} AS MATERIALIZED (SELECT id, x, r, r + coalesce((SELECT sum(r * r) FROM t{n}) / nullif(rr, 0), 0) * p AS p FROM t{n})"
    return out


def _eigen_sql(values: int, rounds: int) -> str:
    """The largest eigenvalues of k (i, j, v) by power iteration, each with the former ones' vectors taken out."""
    out = ""
    for e in range(values):
        out += f", e{e}_0 AS MATERIALIZED (SELECT id, 1.0 + sin(id * {e + 1}) AS u FROM b)"
        for n in range(rounds):
            less = "".join(f" - (SELECT sum(y.u * z.u) FROM e{e}_{n} y JOIN v{f} z USING (id)) * l{f}.value * v{f}.u" for f in range(e))
            joins = "".join(f" JOIN v{f} USING (id) CROSS JOIN l{f}" for f in range(e))
            out += f", m{e}_{n} AS MATERIALIZED (SELECT id, y{less} AS y FROM (SELECT i AS id, sum(v * u) AS y FROM k JOIN e{e}_{n} ON j = id GROUP BY i){joins})"
            out += f", e{e}_{n + 1} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM m{e}_{n}) AS u FROM m{e}_{n})"
        out += f", v{e} AS MATERIALIZED (SELECT * FROM e{e}_{rounds}), l{e} AS MATERIALIZED (SELECT sum(y * u) AS value FROM m{e}_{rounds - 1} JOIN e{e}_{rounds - 1} USING (id))"
    return out


_TREE = "every AS (SELECT x1, x2, node >> k AS node FROM leaf, range(0, 13) r(k) WHERE node >> k >= 1), mid AS (SELECT node, count(*) AS n, avg(x1) AS c1, avg(x2) AS c2 FROM every GROUP BY node), tree AS (SELECT node, floor(log2(node))::INT AS level, any_value(n) AS n, any_value(c1) AS c1, any_value(c2) AS c2, max(sqrt(pow(x1 - c1, 2) + pow(x2 - c2, 2))) AS radius FROM every JOIN mid USING (node) GROUP BY node)"
_FAR = "sqrt(pow(a.c1 - b.c1, 2) + pow(a.c2 - b.c2, 2)) > 2.1 * (a.radius + b.radius) / 2"
_HALVES = f"known AS (SELECT a.node AS m, b.node AS n, a.level, {_FAR} AS far FROM tree a, tree b WHERE a.level = b.level)"
_CLOSE = _HALVES.replace("2.1", "20.0")
_NEAR = " AND ".join(f"NOT EXISTS (FROM known u WHERE u.m = k.m >> {i} AND u.n = k.n >> {i} AND u.level = k.level - {i} AND u.far)" for i in range(1, 10))
_CKD, _NAT = _widest(2), "id"
_RBF3 = f"{_D}*{_D} > {138.15510557964274 * 0.09}", f"exp(-{_D}*{_D}/0.18)"
_STIFF = f"WITH p AS (SELECT id, [x1, x2]::DOUBLE[] AS x, w FROM ({_PARTS})), b AS (SELECT id, w FROM p), k AS MATERIALIZED (SELECT a.id AS i, b.id AS j, CASE WHEN {_RBF3[0]} THEN 0.0 ELSE {_RBF3[1]} END + CASE WHEN a.id = b.id THEN 5.0 ELSE 0.0 END AS v FROM p a, p b)"
_PERIODIC = "sqrt(pow(least(abs(a.c1 - b.c1), abs(abs(a.c1 - b.c1) - 1.0)), 2) + pow(a.c2 - b.c2, 2)) > 2.1 * (a.radius + b.radius) / 2"
ORACLE_SQL = {f"multiply_{k}": f"{_EMB} SELECT a.id, round(sum(({v}) * b.w), 3) AS y FROM p a, p b GROUP BY a.id" for k, (_, v) in FORMS.items()}
ORACLE_SQL |= {
    "cluster_ckd": _levels_sql(_CKD, _ordered(_CKD)),
    "cluster_natural": _levels_sql(_NAT, _ordered(_NAT)),
    "cluster_tm": _levels_sql("tm", _ordered("tm")),
    "cluster_lineitem": _levels_sql(_widest(4), _ordered(_widest(4), 4), _ITEMS, 4, 500, 11),
    "cluster_gram": _levels_sql(_NAT, "sizes AS (SELECT node, count(*) AS n FROM leaf GROUP BY node) SELECT * FROM sizes"),
    "norms": f"{_EMB}, k AS (SELECT a.id AS i, b.id AS j, {FORMS['rbf'][1]} AS v FROM p a, p b) SELECT round(sqrt(sum(v*v)), 4) AS frobenius, (SELECT round(max(s), 4) FROM (SELECT sum(abs(v)) AS s FROM k GROUP BY j)) AS one, (SELECT round(max(s), 4) FROM (SELECT sum(abs(v)) AS s FROM k GROUP BY i)) AS infinity, round(max(abs(v)), 4) AS max FROM k",
    "extract": f"{_EMB} SELECT a.id AS i, b.id AS j, round(exp(-{_D}) + CASE WHEN a.id = b.id THEN 0.5 ELSE 0 END, 6) AS v FROM p a JOIN p b ON b.id = (a.id * 7) % (SELECT count(*) FROM p)",
    "nearest": f"{_EMB} SELECT id, rank::INT AS rank, other, round(d2, 6) AS d2 FROM (SELECT a.id, b.id AS other, {_D}*{_D} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D}, b.id) AS rank FROM p a, p b WHERE a.id % 20 = 0 AND a.id <> b.id) WHERE rank <= 8",
    "gram_distance": f"{_EMB} SELECT a.id AS i, b.id AS j, round(1 - pow(list_dot_product(a.x,b.x)+1.0, 4)/(pow(list_dot_product(a.x,a.x)+1.0, 2)*pow(list_dot_product(b.x,b.x)+1.0, 2)), 6) AS d FROM p a JOIN p b ON b.id = (a.id * 3 + 1) % (SELECT count(*) FROM p)",
    "tree_shape": _levels_sql(_NAT, f"{_TREE} SELECT node, level, n, round(c1, 6) AS c1, round(c2, 6) AS c2, round(radius, 6) AS radius FROM tree"),
    "h_plan": _levels_sql(_CKD, f"{_TREE}, {_HALVES}, plan AS (SELECT m, n, level, CASE WHEN far THEN 'low_rank' ELSE 'dense' END AS kind FROM known k WHERE (far OR level = (SELECT max(level) FROM tree)) AND {_NEAR}) SELECT p.level, kind, count(*) AS blocks, sum(a.n * b.n)::BIGINT AS entries FROM plan p JOIN tree a ON a.node = p.m JOIN tree b ON b.node = p.n GROUP BY p.level, kind"),
    "blr_plan": _levels_sql(_CKD, f"{_TREE}, {_HALVES} SELECT m AS node_m, n AS node_n, level, CASE WHEN far THEN 'low_rank' ELSE 'dense' END AS kind FROM known WHERE level = 2"),
    "near_nearest": _levels_sql(_CKD, f"{_TREE}, {_CLOSE}, near AS (SELECT m, n FROM known k WHERE NOT far AND level = (SELECT max(level) FROM tree) AND {_NEAR}), met AS (SELECT a.id, b.id AS other, (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) AS d2 FROM near JOIN leaf a ON a.node = m JOIN leaf b ON b.node = n WHERE a.id <> b.id) SELECT id, rank, other, d2 FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY d2, other))::INT AS rank FROM met) WHERE rank <= 5"),
    "composed": f"{_EMB}, k AS (SELECT a.id AS i, b.id AS j, {FORMS['rbf'][1]} AS v FROM p a, p b), u AS (SELECT i AS id, sum(v * w) AS y FROM k JOIN p ON p.id = j GROUP BY i), z AS (SELECT i AS id, sum(v * y) AS y FROM k JOIN u ON u.id = j GROUP BY i) SELECT id, round(2 * (z.y + u.y) + p.w / 2, 3) AS y FROM z JOIN u USING (id) JOIN p USING (id)",
    "hodlr_plan": "WITH d AS (SELECT min(k)::INT AS depth FROM (SELECT count(*) AS n FROM part), range(0, 40) t(k) WHERE n >> k <= 60) SELECT node_m, node_m + 1 - 2 * (node_m % 2) AS node_n, floor(log2(node_m))::INT AS level, 'low_rank' AS kind FROM d, range(2, 1000000) r(node_m) WHERE node_m < (2 << depth) UNION ALL SELECT m, m, depth + 1, 'dense' FROM d, range(1, 1000000) r(m) WHERE m >= (1 << depth) AND m < (2 << depth)",
}
_H_PLAN = ORACLE_SQL["h_plan"]
ORACLE_SQL["periodic_plan"] = _H_PLAN.replace(_FAR, _PERIODIC)
_IMQ = "1.0/sqrt({0}*{0} + 1.0)".format(_D)
_POINTS = f"WITH p AS (SELECT id, [x1, x2]::DOUBLE[] AS x, w FROM ({_PARTS}))"
_RIDGE20 = f"{_EMB}, b AS (SELECT id, w FROM p), k AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {FORMS['rbf'][1]} + CASE WHEN a.id = b.id THEN 20.0 ELSE 0.0 END AS v FROM p a, p b)"
_FIT = f"WITH p AS (SELECT id, [x1, x2]::DOUBLE[] AS x FROM ({_PARTS})), b AS (SELECT id, x, CASE WHEN x[1] > 0.5 THEN 1.0 ELSE -1.0 END AS w FROM p WHERE id % 5 <> 0), k AS MATERIALIZED (SELECT a.id AS i, b.id AS j, CASE WHEN {_RBF3[0]} THEN 0.0 ELSE {_RBF3[1]} END + CASE WHEN a.id = b.id THEN 5.0 ELSE 0.0 END AS v FROM b a, b)"
ORACLE_SQL |= {
    "solve_gmres": f"{_RIDGE20}{_cg_sql(14)} SELECT id, round(x, 7) AS w FROM s14",
    "solve_tfqmr": f"{_RIDGE20}{_cg_sql(14)} SELECT id, round(x, 7) AS w FROM s14",
    "hodlr_multiply_parts": f"{_POINTS} SELECT a.id, round(sum({_IMQ} * b.w), 3) AS y FROM p a, p b GROUP BY a.id",
    "h_multiply": f"{_POINTS} SELECT a.id, round(sum(v * w), 3) AS y1, round(sum(v), 3) AS y2 FROM (SELECT a.id, b.w, sqrt({_D}*{_D} + 0.5) + CASE WHEN a.id = b.id THEN 2.0 ELSE 0.0 END AS v FROM p a, p b) a GROUP BY a.id",
    "hodlr_multiply_complex": f"{_POINTS} SELECT id, round(sum(re * w - im * 0.5), 3) AS y, round(sum(im * w + re * 0.5), 3) AS yi FROM (SELECT a.id, b.w, {FORMS['fourier_re'][1]} AS re, {FORMS['fourier_im'][1]} AS im FROM p a, p b) GROUP BY id",
    "hodlr_solve": f"{_STIFF}{_cg_sql(30)} SELECT id, round(x, 5) AS w FROM s30",
    "hodlr_solve_preconditioned": f"{_STIFF}{_cg_sql(30)} SELECT id, round(x, 5) AS w FROM s30",
    "hodlr_entries": f"{_POINTS} SELECT a.id AS i, b.id AS j, round({_IMQ}, 6) AS v FROM p a JOIN p b ON b.id = (a.id * 37) % (SELECT count(*) FROM p)",
    "hodlr_structure": "WITH d AS (SELECT min(k)::INT AS depth, any_value(n) AS n FROM (SELECT count(*) AS n FROM part), range(0, 40) t(k) WHERE n >> k <= 100), "
    + "c AS (WITH RECURSIVE t(node, n, depth) AS (SELECT 1::BIGINT, n::BIGINT, depth FROM d UNION ALL SELECT 2 * node + b, CASE WHEN b = 0 THEN (n + 1) // 2 ELSE n // 2 END, depth FROM t, range(0, 2) r(b) WHERE floor(log2(node)) < depth) SELECT node, n, depth, floor(log2(node))::INT AS level FROM t) "
    + "SELECT a.level, 'low_rank' AS kind, count(*) AS blocks, sum(a.n * b.n)::BIGINT AS entries, true AS low FROM c a JOIN c b ON b.node = a.node + 1 - 2 * (a.node % 2) WHERE a.node > 1 GROUP BY a.level UNION ALL SELECT level, 'dense', count(*), sum(n * n)::BIGINT, true FROM c WHERE level = depth GROUP BY level",
    "hodlr_logdet": "WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_acctbal/10000.0 AS x FROM supplier), k AS (SELECT a.id AS i, b.id AS j, exp(-abs(a.x - b.x)/0.1) + CASE WHEN a.id = b.id THEN 0.5 ELSE 0.0 END AS v FROM p a, p b), "
    + "m AS (SELECT 1::BIGINT AS step, i, j, v FROM k UNION ALL SELECT a.step + 1, a.i, a.j, a.v - b.v * c.v / d.v FROM m a JOIN m b ON b.i = a.i AND b.j = a.step JOIN m c ON c.i = a.step AND c.j = a.j JOIN m d ON d.i = a.step AND d.j = a.step WHERE a.i > a.step AND a.j > a.step) "
    + "SELECT 1::BIGINT AS sign, round(sum(ln(v)), 6) AS logabs FROM m WHERE i = step AND j = step",
    "ridge": f"{_FIT}{_cg_sql(30)} SELECT a.id, round(sum(s30.x * CASE WHEN {_RBF3[0]} THEN 0.0 ELSE {_RBF3[1]} END), 5) AS y FROM p a, b JOIN s30 ON s30.id = b.id WHERE a.id % 5 = 0 GROUP BY a.id",
    "eigenvalues": f"{_POINTS}, b AS (SELECT id FROM p), k AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {FORMS['rbf'][1]} AS v FROM p a, p b){_eigen_sql(3, 12)} "
    + " UNION ALL ".join(f"SELECT {e + 1}::INT AS rank, round(value, 3) AS value, true AS converged FROM l{e}" for e in range(3)),
    "stored_multiply": f"{_POINTS} SELECT a.id, round(sum({_IMQ} * b.w), 2) AS y FROM p a, p b GROUP BY a.id",
    "stored_multiply_transposed": f"{_POINTS} SELECT a.id, round(sum({_IMQ} * b.w), 2) AS y FROM p a, p b GROUP BY a.id",
    "far_norms": _H_PLAN.split("SELECT p.level, kind")[0] + ", x AS (SELECT id, [x1, x2]::DOUBLE[] AS x, node FROM leaf), deep AS (SELECT max(level) AS d FROM tree) "
    + f"SELECT p.level, count(DISTINCT (m, n)) AS blocks, round(sqrt(sum(pow({_IMQ}, 2))), 4) AS norm FROM plan p, deep JOIN x a ON a.node >> (d - p.level) = p.m JOIN x b ON b.node >> (d - p.level) = p.n WHERE kind = 'low_rank' GROUP BY p.level",
    "black_box": f"{_POINTS} SELECT a.id, round(sum((pow(list_dot_product(a.x, b.x) + 1.0, 2) + CASE WHEN a.id = b.id THEN 2.0 ELSE 0.0 END) * b.w), 2) AS y FROM p a, p b GROUP BY a.id",
} | {
    f"butterfly_{name}": f"WITH c AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey AS id, (p_partkey - 1)/n::DOUBLE AS x, (p_partkey - 1 - n // 2)::DOUBLE AS k, p_partkey % 7 / 7.0 AS w FROM part, c) SELECT id, round(sum(cos(f) * w), 2) AS y, round(sum(sin(f) * w), 2) AS yi FROM (SELECT a.id, b.w, 2*pi()*({phase}) AS f FROM p a, p b) GROUP BY id"
    for name, phase in (("fourier", "-a.x*b.k"), ("fio", "a.x*b.k + (2 + sin(2*pi()*a.x))/8*abs(b.k)"))
}
ORACLE_SQL |= {"blr_solve": ORACLE_SQL["hodlr_solve"], "blr_logdet": ORACLE_SQL["hodlr_logdet"]}
