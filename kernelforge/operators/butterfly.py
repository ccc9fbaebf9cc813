"""Butterfly compression of one rectangular kernel block, for oscillatory kernels whose low rank is local only.

Rows and columns have cluster trees of the same depth L. At step l a node of level l of the rows' tree meets a node of level L - l of the columns'
tree, and the columns' part is interpolated from a skeleton of its columns that serves these rows: candidates are the skeletons that the
columns' two children had for the rows' parent, and coefficients come from a pivoted QR on sampled rows, at the tolerance or, where that is
finer, at the rounding of the entries: a phase of 60,000 turns is known to 1e-11 of one only, and what is below that has full rank. After step L each leaf of rows
has one skeleton of all columns, and a dense block with it. Each of the L + 1 steps has 2**L pairs. Kept factors are made by a job a step, over a
table of (row node, column node). For one product they need not be kept: a task then takes ROUND steps of all pairs below a node of rows and a
node of columns, which need no others, applies each factor where it is made, and hands on skeletons and vectors only.

Skeletons are choices of columns, so an entry needs no other factors than those on its path. Edge cases: a block of one leaf by
one leaf is dense; points of each side need distinct ids; repeated points are as good as others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.functions.kernels import block, is_complex
from kernelforge.operators.blocks_algebra import interpolative
from kernelforge.options import Options
from kernelforge.plans.cluster import cluster, depth_of
from kernelforge.shared import written

_STEP = "step int, m long, n long, c int, r int, cl int, t binary, s binary, z binary"
#: Steps that a task takes at once where factors are not kept, for 2**(ROUND - 1) nodes of columns.
ROUND = 4


def _array(x) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def grain(kernel: str, x: np.ndarray, y: np.ndarray, h, a: np.ndarray) -> float:
    """The share of the largest entry of ``a``, the kernel of x and y, by which entries move when their points move by two units in the last place: some rows tell."""
    some = slice(None, None, max(1, len(x) // 16))
    moved = block(kernel, x[some] * (1 + 2 * np.finfo(float).eps), y, h) - a[some]
    return float(np.abs(moved).max() / max(1e-300, np.abs(a).max())) if moved.size else 0.0


class Butterfly:
    def __init__(self, rows: DataFrame, cols: DataFrame, kernel: str, h, options: Options = Options(), keep: bool = True) -> None:
        """keep: factors are stored, for several products; else a product makes them anew, and only what the next round needs is stored."""
        self.kernel, self.h, self.options = kernel, h, options
        self.dtype = np.complex128 if is_complex(kernel) else np.float64
        sizes = [(d.count(), len(d.first()["x"]) if d.limit(1).count() else 1) for d in (rows, cols)]
        self.dims = sizes[0][1], sizes[1][1]
        depth = min(depth_of(n, options.leaf) for n, _ in sizes)
        self.depth = depth
        side = lambda d, n: cluster(d.select("id", "x"), max(options.leaf, -(-n // (1 << depth))), "ckd")
        self.rows, self.cols = (written(side(d, n).select("id", "x", "node", "new_id")) for d, (n, _) in zip((rows, cols), sizes, strict=True))
        packed = lambda d: d.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("p"))
        self.row_leaves, self.col_leaves = written(packed(self.rows)), written(packed(self.cols))
        self._steps = self._build() if keep else None

    @property
    def steps(self) -> list[DataFrame]:
        if self._steps is None:
            self._steps = self._build()
        return self._steps

    def _build(self) -> list[DataFrame]:
        return self._rounds(self.col_leaves.select(F.lit(1).cast("long").alias("m"), F.col("node").alias("n"), "p", F.lit(None).cast("binary").alias("z")), True)

    def _rounds(self, leaves: DataFrame, keep: bool) -> list[DataFrame]:
        """The tables of all rounds from the leaves of columns (m, n, p, z): of all pairs with their factors, a step a round, or of the last pairs of every ROUND steps without."""
        kernel, h, dims, depth, tol, most, dtype = self.kernel, self.h, self.dims, self.depth, self.options.tol, self.options.max_rank, self.dtype
        quota = self.options.samples
        # The rows that stand for a node of rows, the same for all its columns: all of them, or where a level's nodes have more than ``quota``, one of each of as many
        # stretches in the order of the tree, and the outermost in each coordinate: beyond the last of them an interpolation would not hold.
        n = self.rows.count()
        every = self.rows.select("id", "x", "new_id", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "node").withColumn("m", F.expr(f"shiftright(node, {depth} - level)"))
        large = sum(n >> level > quota for level in range(depth + 1))
        share = F.when(F.col("level") < large, F.floor((F.col("new_id") - 1) * F.expr(f"shiftleft({quota}L, level)") / F.lit(max(1, n)))).otherwise(F.col("id"))
        each = every.groupBy("level", "m", share.alias("k")).agg(F.min_by("x", F.xxhash64("id")).alias("x")).groupBy("level", "m").agg(F.flatten(F.collect_list("x")).alias("rows"))
        ends = [of("x", F.element_at("x", i + 1)) for i in range(dims[0]) for of in (F.min_by, F.max_by)]
        ends = every.where(f"level < {large}").groupBy("level", "m").agg(F.concat(*ends).alias("ends"))
        proxies = each.join(ends, ["level", "m"], "left").select("level", "m", F.concat("rows", F.coalesce("ends", F.array().cast("array<double>"))).alias("rows"))
        proxies = written(proxies)

        def compress(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a = block(kernel, rows, x, h)
            known = max(tol, grain(kernel, rows, x, h, a))
            if a.shape[0] > a.shape[1] > 0:
                a = np.linalg.qr(a, mode="r")
            return interpolative(a, known, most) if a.size else (np.zeros(0, int), np.zeros((0, len(x))))

        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = [f.split()[0] for f in _STEP.split(", ")]

        def take(batches, a: int, b: int):
            """Steps a to b of what meets below a node of rows of level a and a node of columns of level depth - b."""
            for batch in batches:
                for top, fed, beside in zip(batch.column("top").to_pylist(), batch.column("fed"), batch.column("beside"), strict=True):
                    held = beside.values
                    rows = {(level, m): np.asarray(v.values, float).reshape(-1, dims[0]) for level, m, v in zip(held.field("level").to_pylist(), held.field("m").to_pylist(), held.field("rows"), strict=True)}
                    now = {(top, r["n"]): (r["cl"], np.frombuffer(r["x"]).reshape(-1, dims[1]), None if r["z"] is None else np.frombuffer(r["z"], dtype)) for r in fed.as_py()}
                    for step in range(a, b + 1):
                        made = {}
                        for (m, n), (cl, x, z) in sorted(now.items(), key=lambda e: e[0]):
                            if (step, m) not in rows:
                                continue
                            cols, p = compress(rows[step, m], x)
                            made[m, n] = x[cols], None if z is None else p @ z
                            if keep or step == b:
                                out = (step, m, n, len(x), len(cols), cl, _array(p) if keep else None, _array(x[cols]), None if z is None else _array(made[m, n][1].astype(dtype)))
                                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], names)
                        # Both children of the rows' node take the merged skeletons of the columns' two children.
                        now = {}
                        for m, n in sorted({(m, n >> 1) for m, n in made}):
                            of = [made[m, k] for k in (2 * n, 2 * n + 1) if (m, k) in made]
                            merged = len(of[0][0]), np.concatenate([s for s, _ in of]), None if of[0][1] is None else np.concatenate([z for _, z in of])
                            now |= {(2 * m, n): merged, (2 * m + 1, n): merged}

        def leaf_points(batches):
            for batch in batches:
                for m, n, p, z in zip(batch.column("m").to_pylist(), batch.column("n").to_pylist(), batch.column("p"), batch.column("z").to_pylist(), strict=True):
                    x = np.asarray(p.values.field("x").flatten(), float)
                    yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([n]), pa.array([0], pa.int32()), pa.array([_array(x)], pa.binary()), pa.array([z], pa.binary())], ["m", "n", "cl", "x", "z"])

        now = leaves.mapInArrow(leaf_points, "m long, n long, cl int, x binary, z binary")
        out, a, session = [], 0, self.rows.sparkSession
        tasks = min(int(session.conf.get("spark.sql.shuffle.partitions")), 8 * session.sparkContext.defaultParallelism)
        while a <= depth:
            b = a if keep else min(a + ROUND - 1, depth)
            fed = now.groupBy(F.col("m").alias("top"), F.shiftright("n", b - a).alias("low")).agg(F.collect_list(F.struct("n", "cl", "x", "z")).alias("fed"))
            beside = proxies.where(f"level between {a} and {b}").groupBy(F.expr(f"shiftright(m, level - {a})").alias("top")).agg(F.collect_list(F.struct("level", "m", "rows")).alias("beside"))
            out.append(written(fed.join(beside, "top").repartition(tasks).mapInArrow(lambda i, a=a, b=b: take(i, a, b), _STEP)))
            merged = out[-1].groupBy("m", F.shiftright("n", 1).alias("n")).agg(F.min_by("r", "n").alias("cl"), F.concat(F.min_by("s", "n"), F.max_by("s", "n")).alias("x"), F.concat(F.min_by("z", "n"), F.max_by("z", "n")).alias("z"))
            now = merged.select(F.explode(F.array(F.col("m") * 2, F.col("m") * 2 + 1)).alias("m"), "n", "cl", "x", "z")
            a = b + 1
        return out

    def _packed(self, w: DataFrame) -> DataFrame:
        """(m, n, z) for the leaves of columns, in order of id; w has id, w and perhaps wi."""
        dtype, imaginary = self.dtype, "wi" in w.columns
        both = self.cols.join(w.select("id", F.col("w").cast("double").alias("w"), (F.col("wi").cast("double") if imaginary else F.lit(0.0)).alias("wi")), "id", "left")
        held = both.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("wi", F.lit(0.0)).alias("wi")))).alias("p"))

        def pack(batches):
            for batch in batches:
                for node, p in zip(batch.column("node").to_pylist(), batch.column("p"), strict=True):
                    v = p.values.field("w").to_numpy() + (1j * p.values.field("wi").to_numpy() if dtype is np.complex128 else 0)
                    yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([node]), pa.array([_array(v.astype(dtype))], pa.binary())], ["m", "n", "z"])

        return held.mapInArrow(pack, "m long, n long, z binary")

    def multiply(self, w: DataFrame) -> DataFrame:
        """id, y (and yi) of the block times w."""
        dtype, kernel, h, dims, pair = self.dtype, self.kernel, self.h, self.dims, self.dtype is np.complex128

        def apply(batches):
            for batch in batches:
                rows = batch.to_pylist()
                z = [_array(np.frombuffer(r["t"], dtype).reshape(r["r"], r["c"]) @ np.frombuffer(r["z"], dtype)) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("n"), pa.array(z, pa.binary())], ["m", "n", "z"])

        now = self._packed(w)
        if self._steps is None:
            now = self._rounds(now.join(self.col_leaves.withColumnRenamed("node", "n"), "n").select("m", "n", "p", "z"), False)[-1].select("m", "n", "s", "z")
        for step, made in enumerate(self._steps or []):
            now = written(made.select("m", "n", "c", "r", "t").join(now, ["m", "n"]).mapInArrow(apply, "m long, n long, z binary"))
            if step < self.depth:
                merged = now.groupBy("m", F.shiftright("n", 1).alias("n")).agg(F.concat(F.min_by("z", "n"), F.max_by("z", "n")).alias("z"))
                now = merged.select(F.explode(F.array(F.col("m") * 2, F.col("m") * 2 + 1)).alias("m"), "n", "z")

        def finish(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    x = np.array([p["x"] for p in r["p"]], float)
                    y = block(kernel, x, np.frombuffer(r["s"]).reshape(-1, dims[1]), h) @ np.frombuffer(r["z"], dtype)
                    yield pa.RecordBatch.from_arrays([pa.array([p["id"] for p in r["p"]], pa.int64()), pa.array(y.real), *([pa.array(y.imag)] if pair else [])], ["id", "y", *(["yi"] if pair else [])])

        skeletons = now if self._steps is None else now.join(self._steps[-1].select("m", "n", "s"), ["m", "n"])
        last = skeletons.join(self.row_leaves.select(F.col("node").alias("m"), "p"), "m")
        return last.mapInArrow(finish, "id long, y double" + (", yi double" if pair else ""))

    def extract(self, requests: DataFrame) -> DataFrame:
        """i, j, v (and vi): entries of the compressed block, each by the factors on its path."""
        dtype, kernel, h, dims, depth, pair = self.dtype, self.kernel, self.h, self.dims, self.depth, self.dtype is np.complex128
        places = self.col_leaves.select("node", F.posexplode("p").alias("place", "p")).select(F.col("p.id").alias("j"), F.col("node").alias("nj"), "place")
        now = requests.select("i", "j").join(self.rows.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("node").alias("ni")), "i").join(places, "j")
        now = written(now.withColumn("z", F.lit(None).cast("binary")).withColumn("left", F.lit(True)))
        kind = "i long, j long, xi array<double>, ni long, nj long, place int, z binary, left boolean"

        def follow(batches, step: int):
            for batch in batches:
                rows, out = batch.to_pylist(), []
                for r in rows:
                    t = np.frombuffer(r["t"], dtype).reshape(r["r"], r["c"])
                    if step == 0:
                        z = t[:, r["place"]]
                    else:
                        z = (t[:, : r["cl"]] if r["left"] else t[:, r["cl"] :]) @ np.frombuffer(r["z"], dtype)
                    out.append(_array(z))
                left = [not r["nj"] >> step & 1 for r in rows]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("i", "j", "xi", "ni", "nj", "place")), pa.array(out, pa.binary()), pa.array(left)], ["i", "j", "xi", "ni", "nj", "place", "z", "left"])

        for step, made in enumerate(self.steps):
            at = made.select("m", "n", "c", "r", "cl", "t")
            now = now.withColumn("m", F.shiftright("ni", depth - step)).withColumn("n", F.shiftright("nj", step)).join(at, ["m", "n"])
            now = written(now.mapInArrow(lambda b, step=step: follow(b, step), kind))

        def finish(batches):
            for batch in batches:
                rows = batch.to_pylist()
                v = np.array([(block(kernel, np.array([r["xi"]]), np.frombuffer(r["s"]).reshape(-1, dims[1]), h) @ np.frombuffer(r["z"], dtype))[0] for r in rows], dtype)
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(v.real), *([pa.array(v.imag)] if pair else [])], ["i", "j", "v", *(["vi"] if pair else [])])

        last = now.join(self.steps[-1].select(F.col("m").alias("ni"), "s"), "ni")
        return last.mapInArrow(finish, "i long, j long, v double" + (", vi double" if pair else ""))

    def statistics(self) -> DataFrame:
        """step, pairs, least and largest rank, numbers stored."""
        return reduce(DataFrame.union, self.steps).groupBy("step").agg(F.count("*").alias("pairs"), F.min("r").alias("least_rank"), F.max("r").alias("largest_rank"), F.sum(F.col("r") * F.col("c")).alias("numbers"))

    def error(self, w: DataFrame, sample: int = 20) -> float:
        """Relative error of the product at some rows, against exact ones."""
        some = self.rows.orderBy(F.xxhash64(F.lit(self.options.seed + 1), "id")).limit(sample).select("id", "x")
        ids = [r["id"] for r in some.collect()]  # ``sample`` rows
        got = {r["id"]: complex(r["y"], r["yi"] if "yi" in r else 0) for r in self.multiply(w).where(F.col("id").isin(ids)).collect()}
        want = exact(some, self.cols, w, self.kernel, self.h)
        total = {r["id"]: complex(r["y"], r["yi"]) for r in want.collect()}
        off = sum(abs(got[i] - total[i]) ** 2 for i in total)
        return float((off / max(1e-300, sum(abs(v) ** 2 for v in total.values()))) ** 0.5)


def exact(rows: DataFrame, cols: DataFrame, w: DataFrame, kernel: str, h) -> DataFrame:
    """id, y, yi of a few rows (id, x) times w: partial sums of each batch of columns; the rows travel with the code."""
    few = rows.select("id", "x").toArrow()
    ids, x = few["id"].to_numpy(), np.array(few["x"].to_pylist(), float)
    imaginary = "wi" in w.columns

    def run(batches):
        for batch in batches:
            if not len(batch) or not len(x):
                continue
            v = batch.column("w").to_numpy() + (1j * batch.column("wi").to_numpy() if imaginary else 0)
            y = np.asarray(block(kernel, x, np.asarray(batch.column("x").flatten(), float).reshape(len(batch), -1), h) @ v, complex)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y.real.copy()), pa.array(y.imag.copy())], ["id", "y", "yi"])

    both = cols.select("id", "x").join(w.select("id", F.col("w").cast("double").alias("w"), *([F.col("wi").cast("double").alias("wi")] if imaginary else [])), "id")
    return both.select("x", "w", *(["wi"] if imaginary else [])).mapInArrow(run, "id long, y double, yi double").groupBy("id").agg(F.sum("y").alias("y"), F.sum("yi").alias("yi"))
