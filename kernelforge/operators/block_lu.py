"""Block LU factors of a matrix of low-rank and dense tiles (BLR), with solves and determinants, as tables.

The tiles of one tree level are factored as A = L U, with U's diagonal tiles the identity and L's the updated tiles D. Step k takes all
products of finished tiles that fall on row and column k at once (left-looking), so every tile is written once, and a step is two jobs:
sums, then inv(D) on row k. A task holds one tile and at most CHUNK pairs of tiles; longer sums are made of partial ones.
Sums are cut back to the tolerance as they grow; a tile whose rank does not pay is stored dense.

A vector passes through the tiles once forwards and once backwards, one job for each of the tiles' rows. Vectors (id, w) have w double, or
array<double> for several right-hand sides, and wi for imaginary parts of complex kernels.

With a diagonal added, points at one place are one point of the factors: for the class c of m such ids, the sum s of their solutions has
(K + diagonal / m) s = the mean of their right-hand sides, and each has (its right-hand side - that mean) / diagonal + s / m. That is exact.

Edge cases: ids without a value count as 0, values of unknown ids drop out; a singular diagonal tile is an error; no points give empty
results; a matrix of one tile is solved densely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.functions.kernels import is_complex
from kernelforge.operators import lowrank
from kernelforge.plans import blocks
from kernelforge.plans.cluster import cluster, tree
from kernelforge.shared import folder, spread, written

#: Pairs of tiles that one task sums, and points of a tile's side at most: a dense tile is 13 MB at most, however many points there are.
CHUNK, SIDE = 4, 1250
#: Tiles that one task compresses.
BLOCKS = 8
_SIDE = "m int, n int, rank int, u binary, v binary"
_TILE = f"i long, j long, kind string, part long, {_SIDE}"
_FIELDS = ["i", "j", "kind", "part", "m", "n", "rank", "u", "v"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
#: Rank of a tile that is stored dense.
DENSE = -1


def _read(r: dict, dtype) -> tuple[np.ndarray, ...]:
    """(block,) or the factors (u, v)."""
    u = np.frombuffer(r["u"], dtype)
    return (u.reshape(r["m"], r["n"]),) if r["rank"] == DENSE else (u.reshape(r["m"], r["rank"]), np.frombuffer(r["v"], dtype).reshape(r["rank"], r["n"]))


def _row(i: int, j: int, kind: str, part: int, tile: tuple[np.ndarray, ...]) -> tuple:
    u, v = (np.ascontiguousarray(x) for x in (tile if len(tile) == 2 else (tile[0], np.zeros((0, 0)))))
    n = v.shape[1] if len(tile) == 2 else u.shape[1]
    return i, j, kind, part, u.shape[0], n, v.shape[0] if len(tile) == 2 else DENSE, u.tobytes(), v.tobytes()


def _tiles(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _FIELDS)


def product(a: tuple, b: tuple) -> tuple:
    """Of two tiles; low rank if either is."""
    if len(a) == 1 and len(b) == 1:
        return (a[0] @ b[0],)
    if len(a) == 1:
        return a[0] @ b[0], b[1]
    if len(b) == 1:
        return a[0], a[1] @ b[0]
    core = a[1] @ b[0]
    return (a[0] @ core, b[1]) if core.shape[1] <= core.shape[0] else (a[0], core @ b[1])


def summed(terms: list[tuple[float, tuple]], tol: float) -> tuple:
    """The sum of scaled tiles: dense if any is, else cut back to the tolerance whenever its columns outgrow the tile."""
    if any(len(t) == 1 for _, t in terms):
        return (sum(s * (t[0] if len(t) == 1 else t[0] @ t[1]) for s, t in terms),)
    u, v = terms[0][0] * terms[0][1][0], terms[0][1][1]
    for s, t in terms[1:]:
        u, v = np.concatenate((u, s * t[0]), axis=1), np.concatenate((v, t[1]))
        if u.shape[1] > min(u.shape[0], v.shape[1]):
            u, v = lowrank.recompress(u, v, tol)
    return lowrank.recompress(u, v, tol) if len(terms) > 1 and u.shape[1] else (u, v)


def settled(tile: tuple, low: bool, tol: float) -> tuple:
    """A tile as it is stored: low rank where that was planned and pays."""
    if low and len(tile) == 1:
        tile = lowrank.qr_then_svd(tile[0], tol)
    pays = len(tile) == 2 and tile[0].shape[1] * (tile[0].shape[0] + tile[1].shape[1]) < tile[0].shape[0] * tile[1].shape[1]
    return tile if pays or len(tile) == 1 else (tile[0] @ tile[1],)


def _values(group: pa.Table, width: int, dtype) -> tuple[np.ndarray, ...]:
    """ids and values of a tile row by place; the first row of each place, each row's place and the places' sizes."""
    found = sorted(group.to_pylist(), key=lambda r: (r["rep"], r["id"]))
    v = np.zeros((len(found), width), dtype)
    for at, r in enumerate(found):
        if r["w"] is not None:
            v[at] = np.array(r["w"], float) + (1j * np.array(r["wi"], float) if r.get("wi") is not None else 0)
    _, first, place, n = np.unique([r["rep"] for r in found], return_index=True, return_inverse=True, return_counts=True)
    return np.array([r["id"] for r in found], np.int64), v, first, place, n


class BlockLU:
    def __init__(self, points: DataFrame, kernel: str, h, diagonal: float = 0.0, leaf: int = 1000, tol: float = 1e-6, para: float = 2.1, method: str = "batch_aca", order: str = "ckd") -> None:
        """Factors of the kernel matrix of points, ``diagonal`` added to its diagonal; tiles have at most ``leaf`` points a side, and SIDE at most, as a task holds several."""
        self.dtype, self.tol, self.spark, self.diagonal = (np.complex128 if is_complex(kernel) else np.float64), tol, points.sparkSession, diagonal
        points = points.select("id", F.col("x").cast("array<double>").alias("x"))
        self.extra, self.logs, of = 0, 0.0, points.select("id", F.col("id").alias("rep"))
        if diagonal:
            classes = written(points.groupBy("x").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
            # Rows beyond the first of their place, and the logarithms of the classes' sizes.
            self.extra, self.logs = (v or 0 for v in classes.agg(F.sum(F.col("copies") - 1), F.sum(F.log("copies"))).first())
        if self.extra:
            of = points.join(classes.select("x", "rep"), "x").select("id", "rep")
            points = classes.select(F.col("rep").alias("id"), "x", (F.lit(float(diagonal)) / F.col("copies")).alias("diagonal"))
        c = written(cluster(points, min(leaf, SIDE), order, (kernel, h)))
        depth = c.agg(F.max("depth")).first()[0]
        self.count = 0 if depth is None else 1 << depth
        tile = (F.col("node") - self.count) if self.count else F.lit(0).cast("long")
        self.places = written(of.join(c.select(F.col("id").alias("rep"), tile.alias("i")), "rep"))
        self.base = folder(self.spark, "lu")
        if not self.count:
            return
        t = tree(c)
        made = lowrank.compress(c, blocks.hierarchical(t, para, start=depth, blr=True), kernel, h, tol, method, diagonal, self.count**2 // BLOCKS)
        dense = F.col("kind") == "dense"
        # rank DENSE marks a tile that is stored as it is; kind keeps what the plan wants
        self.matrix = written(made.select((F.col("node_m") - self.count).alias("i"), (F.col("node_n") - self.count).alias("j"), "kind", F.lit(-1).cast("long").alias("part"), "m", "n", F.when(dense, DENSE).otherwise(F.col("rank")).alias("rank"), "u", "v"))
        for k in range(self.count):
            self._step(k)

    def _finished(self, side: str) -> DataFrame:
        """Tiles of all finished steps: "lower" are L's columns with the diagonal, "upper" U's rows."""
        read = self.spark.read.schema(_TILE + ", step int")
        return read.parquet(f"{self.base}/sums").where("i >= j") if side == "lower" else read.parquet(f"{self.base}/upper")

    def _step(self, k: int) -> None:
        dtype, tol = self.dtype, self.tol
        own = self.matrix.where((F.least("i", "j") == k)).select("i", "j", "kind", F.lit(0).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("p"), F.struct(*_FIELDS[4:]).alias("a"), F.lit(None).cast(f"struct<{_SIDE.replace(' ', ':').replace(',:', ',')}>").alias("b"))
        terms = own
        if k:
            lower = self._finished("lower").where(f"step < {k} and i >= {k}").select("i", F.col("j").alias("p"), F.struct(*_FIELDS[4:]).alias("a"))
            upper = self._finished("upper").where(f"step < {k} and j >= {k}").select("j", F.col("i").alias("p"), F.struct(*_FIELDS[4:]).alias("b"))
            pairs = lower.join(upper.where(f"j = {k}"), "p").unionByName(lower.where(f"i = {k}").join(upper.where(f"j > {k}"), "p"))
            kinds = own.select("i", "j", "kind")
            terms = terms.unionByName(pairs.join(F.broadcast(kinds), ["i", "j"]).select("i", "j", "kind", F.floor(F.col("p") / CHUNK).alias("chunk"), "p", "a", "b"))  # 2 * count short rows

        def partial(group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["p"])
            found = summed([(1.0, _read(r["a"], dtype)) if r["b"] is None else (-1.0, product(_read(r["a"], dtype), _read(r["b"], dtype))) for r in rows], tol)
            r = rows[0]
            return _tiles([_row(r["i"], r["j"], r["kind"], r["chunk"], found if k > CHUNK else settled(found, r["kind"] == "low_rank", tol))])

        def total(group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["part"])
            r = rows[0]
            return _tiles([_row(r["i"], r["j"], r["kind"], 0, settled(summed([(1.0, _read(x, dtype)) for x in rows], tol), r["kind"] == "low_rank", tol))])

        made = spread(terms, "i", "j", "chunk").groupBy("i", "j", "chunk").applyInArrow(partial, _TILE)
        if k > CHUNK:
            made = spread(made, "i", "j").groupBy("i", "j").applyInArrow(total, _TILE)
        made.write.parquet(f"{self.base}/sums/step={k}")
        made = self.spark.read.schema(_TILE).parquet(f"{self.base}/sums/step={k}")
        diagonal = made.where("i = j").select(F.col("i").alias("k"), F.struct(*_FIELDS[4:]).alias("d"))

        def scaled(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    d, tile = _read(r["d"], dtype)[0], _read(r["a"], dtype)
                    yield from _tiles([_row(r["i"], r["j"], r["kind"], 0, (np.linalg.solve(d, tile[0]), *tile[1:]))]).to_batches()

        # One tile, whose side is bounded by leaf.
        right = made.where("i < j").select("i", "j", "kind", F.struct(*_FIELDS[4:]).alias("a")).join(F.broadcast(diagonal), F.col("i") == F.col("k"))
        spread(right, "j").mapInArrow(scaled, _TILE).write.parquet(f"{self.base}/upper/step={k}")

    def _vector(self, b: DataFrame) -> tuple[DataFrame, DataFrame, int, bool]:
        """(i, v): one binary of the means of each place's values, in the order of its least ids, for each tile row; the values by id, their width, and whether w is no array."""
        dtype, scalar = self.dtype, dict(b.dtypes)["w"] != "array<double>"
        parts = ["w", "wi"] if "wi" in b.columns else ["w"]
        given = b.select("id", *(F.array(F.col(c).cast("double")).alias(c) if scalar else F.col(c) for c in parts))
        width = given.agg(F.max(F.size("w"))).first()[0] or 1
        rows = self.places.join(given, "id", "left")

        def pack(group: pa.Table) -> pa.Table:
            _, v, first, _, n = _values(group, width, dtype)
            return pa.table({"i": group["i"][:1], "v": pa.array([(np.add.reduceat(v, first) / n[:, None]).tobytes()], pa.binary())})

        return written(rows.groupBy("i").applyInArrow(pack, "i long, v binary")), rows, width, scalar

    def _sweep(self, given: DataFrame, side: str) -> DataFrame:
        """Forwards (lower): y_k = inv(D) (b_k - sum of L(k, p) y_p), p < k; backwards (upper): x_k = y_k - sum of U(k, j) x_j, j > k."""
        dtype, base, forwards = self.dtype, folder(self.spark, "sweep"), side == "lower"
        done = lambda: self.spark.read.schema("i long, v binary, step int").parquet(base).select(F.col("i").alias("j"), F.col("v").alias("y"))
        for k in range(self.count) if forwards else reversed(range(self.count)):
            row = self._finished(side).where(f"i = {k}" + (f" and step <= {k}" if forwards else f" and step = {k}"))
            tiles = row.where("i <> j").select("i", "j", F.struct(*_FIELDS[4:]).alias("a"))
            first = k == (0 if forwards else self.count - 1)
            none = F.lit(None).cast("binary")
            terms = given.where(f"i = {k}").select("i", F.lit(-1).cast("long").alias("j"), "v")

            def apply(batches):
                for batch in batches:
                    for r in batch.to_pylist():
                        y = np.frombuffer(r["y"], dtype).reshape(r["a"]["n"], -1)
                        for f in reversed(_read(r["a"], dtype)):
                            y = f @ y
                        yield pa.RecordBatch.from_pydict({"i": [r["i"]], "j": [r["j"]], "v": pa.array([(-y).tobytes()], pa.binary())})

            if not first:
                terms = terms.unionByName(tiles.join(done(), "j").mapInArrow(apply, "i long, j long, v binary"))
            if forwards:
                terms = terms.withColumn("d", none).unionByName(row.where("i = j").select("i", F.lit(-2).cast("long").alias("j"), none.alias("v"), F.col("u").alias("d")))

            def total(group: pa.Table) -> pa.Table:
                rows = sorted(group.to_pylist(), key=lambda r: r["j"])
                v = sum(np.frombuffer(r["v"], dtype) for r in rows if r["v"] is not None)
                if rows[0].get("d") is not None:
                    d = np.frombuffer(rows[0]["d"], dtype)
                    n = round(len(d) ** 0.5)
                    v = np.linalg.solve(d.reshape(n, n), v.reshape(n, -1))
                return pa.table({"i": [rows[0]["i"]], "v": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())})

            terms.groupBy("i").applyInArrow(total, "i long, v binary").write.parquet(f"{base}/step={k}")
        return self.spark.read.schema("i long, v binary, step int").parquet(base).select("i", "v")

    def solve(self, b: DataFrame) -> DataFrame:
        """(id, w) with A w = b, of the shape of b (id, w); wi too for complex kernels."""
        dtype, vector = self.dtype, ("array<double>" if dict(b.dtypes)["w"] == "array<double>" else "double")
        imaginary = dtype is np.complex128
        schema = f"id long, w {vector}" + (f", wi {vector}" if imaginary else "")
        if not self.count:
            return self.spark.createDataFrame([], schema)
        given, rows, width, scalar = self._vector(b)
        x = self._sweep(self._sweep(given, "lower"), "upper")
        extra, diagonal = self.extra, self.diagonal

        def place(left: pa.Table, right: pa.Table) -> pa.Table:
            if not extra:
                ids = np.sort(left.column("id").to_numpy())
                v = np.frombuffer(right.column("v")[0].as_py(), dtype).reshape(len(ids), -1)
            else:
                ids, own, first, at, n = _values(left, width, dtype)
                mean, s = np.add.reduceat(own, first) / n[:, None], np.frombuffer(right.column("v")[0].as_py(), dtype).reshape(len(n), -1)
                v = (own - mean[at]) / diagonal + (s / n[:, None])[at]
            kind = pa.float64() if scalar else pa.list_(pa.float64())
            cols = {"id": ids} | {c: pa.array((part[:, 0] if scalar else list(part)), kind) for c, part in (("w", v.real), ("wi", v.imag))[: 1 + imaginary]}
            return pa.table(cols)

        return (rows if extra else self.places).groupBy("i").cogroup(x.groupBy("i")).applyInArrow(place, schema)

    def logdet(self) -> tuple[complex, float]:
        """(phase, log of the absolute value) of the determinant: a short row for each diagonal tile reaches the driver."""
        if not self.count:
            return 1.0 + 0j, 0.0
        dtype = self.dtype

        def one(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    phase, size = np.linalg.slogdet(_read(r, dtype)[0])
                    yield pa.RecordBatch.from_pydict({"re": [float(np.real(phase))], "im": [float(np.imag(phase))], "size": [float(size)]})

        rows = self._finished("lower").where("i = j").drop("step").mapInArrow(one, "re double, im double, size double").collect()
        phase, size = complex(np.prod([complex(r["re"], r["im"]) for r in rows])), float(sum(r["size"] for r in rows))
        if self.extra:
            phase, size = complex(phase * np.sign(self.diagonal) ** (self.extra % 2)), float(size + self.logs + self.extra * np.log(abs(self.diagonal)))
        return phase, size

    def statistics(self) -> DataFrame:
        """kind, tiles, numbers (stored ones) and rank (the largest) of the factors."""
        whole = self._finished("lower").drop("step").unionByName(self._finished("upper").drop("step"))
        low = F.col("rank") != DENSE
        numbers = F.when(low, F.col("rank") * (F.col("m") + F.col("n"))).otherwise(F.col("m") * F.col("n")).cast("long")
        return whole.groupBy(F.when(low, "low_rank").otherwise("dense").alias("kind")).agg(F.count("*").alias("tiles"), F.sum(numbers).alias("numbers"), F.max("rank").alias("rank"))
