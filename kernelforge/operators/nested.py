"""Kernel matrices with nested skeleton bases: products, entries, direct solves and determinants, as tables.

Every tree node has a skeleton of its own points and an interpolation matrix T, so that its rows against all that is far are T times the
skeleton's rows. T comes from a pivoted QR at the tolerance, of a node's candidates (its points, or its children's
skeletons) against proxies: candidates of the nodes beside it, and a sample of all points. One level is one job whose tasks
hold a node each, of a few ranks' size; nothing of the size of the data is broadcast or collected.

Plans: weak (siblings are far, HSS; its blocks tile the matrix as HODLR's do) and strong (near and far by geometry, H with nested
bases). Vectors (id, w) have w double, or array<double> for several right-hand sides, and wi for imaginary parts; they pass through
the tree in rounds of CHUNK levels, in which one task takes a subtree. Kernels are symmetric in their two points, so transposed products are products.

A weak matrix is factored bottom-up by telescoping: with D a node's block (a leaf's dense one, or its children's reduced blocks and their coupling),
R = inv(T' inv(D) T) goes up as the reduced block; the logarithm of the determinant is the sum of log|D| - log|R| over all nodes.

Edge cases: ids without a value in a vector count as 0, values for unknown ids drop out; repeated points are
as good as others; no points give empty results; points of one leaf make a dense matrix.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.functions.kernels import block, is_complex
from kernelforge.operators import dense, solvers
from kernelforge.operators.blocks_algebra import interpolative
from kernelforge.options import Options
from kernelforge.plans import blocks
from kernelforge.plans.cluster import cluster, tree
from kernelforge.shared import spread, written

CHUNK = 8
_NODE = "node long, level int, c int, r int, rl int, x binary, t binary, s binary"
_VECTOR = "node long, level int, kind int, v binary"


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _vectors(rows: list[tuple]) -> pa.Table:
    return _table(rows, ["node", "level", "kind", "v"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])


def _outer(x) -> np.ndarray:
    return np.asarray(x).tobytes()


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row at each place, in the order of rows, and of each row the number of its place."""
    _, first, place = np.unique(x, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    return first[order], np.argsort(order)[place.reshape(-1)]


class Nested:
    def __init__(self, points: DataFrame, kernel: str, h, diagonal: float = 0.0, options: Options = Options(), gram: bool = False) -> None:
        self.kernel, self.h, self.diagonal, self.options = kernel, h, diagonal, options
        self.dtype = np.complex128 if is_complex(kernel) else np.float64
        self.points = written(cluster(points.select("id", "x"), options.leaf, options.order, (kernel, h)).select("id", "x", "node", "depth"))
        n, dim, depth = self.points.agg(F.count("*"), F.max(F.size("x")), F.max("depth")).first()
        self.n, self.dim, self.depth, self.factors = n, dim or 1, depth or 0, None
        self.tree = written(tree(self.points))
        pairs = {}
        if self.depth and n:
            pairs = dict(blocks.frontier(self.tree, options.near_para, self.depth))
        if options.strong and self.depth:
            plan = [p.where("far").select("node_m", "node_n", F.lit(level).alias("level")) for level, p in pairs.items()]
            self.low = written(reduce(DataFrame.union, plan))
            self.dense = pairs[self.depth].where("not far").select("node_m", "node_n")
        else:
            plan = blocks.hodlr(self.tree)
            self.low = plan.where("kind = 'low_rank'").select("node_m", "node_n", "level")
            self.dense = plan.where("kind = 'dense'").select("node_m", "node_n")
        members = self.points.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("m"))

        def pack(batches):
            for batch in batches:
                for node, m in zip(batch.column("node").to_pylist(), batch.column("m"), strict=True):
                    ids, x = m.values.field("id").to_numpy(), np.asarray(m.values.field("x").flatten(), float)
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([len(ids)], pa.int32()), pa.array([_outer(ids)], pa.binary()), pa.array([_outer(x)], pa.binary())], ["node", "c", "ids", "x"])

        self.leaves = written(members.mapInArrow(pack, "node long, c int, ids binary, x binary"))
        self.nodes = self._skeletons(pairs) if self.depth else None

    # -- construction ------------------------------------------------------------------------------------------------

    def _skeletons(self, pairs: dict) -> DataFrame:
        some = self.points.orderBy(F.xxhash64(F.lit(self.options.seed), "id")).limit(self.options.samples).select("node", "x").toArrow()
        at, sample = some["node"].to_numpy(), np.asarray(some["x"].combine_chunks().flatten(), float).reshape(len(some), self.dim)
        kernel, h, dim, depth, strong, tol, most = self.kernel, self.h, self.dim, self.depth, self.options.strong, self.options.tol, self.options.max_rank
        cands, out = self.leaves.select("node", "c", F.lit(0).alias("rl"), "x"), []
        for level in range(depth, 0, -1):
            known = pairs[level]
            # Proxies: the candidates of near nodes for a weak plan, some of far ones for a strong one.
            beside = known.where("far" if strong else "not far and node_m <> node_n").join(cands.select(F.col("node").alias("node_n"), F.col("x").alias("other")), "node_n")
            beside = beside.groupBy("node_m").agg(F.collect_list("other").alias("others"))
            near = known.where("not far").groupBy("node_m").agg(F.collect_list("node_n").alias("near"))
            rows = cands.join(beside.withColumnRenamed("node_m", "node"), "node", "left").join(near.withColumnRenamed("node_m", "node"), "node", "left")

            def skeletons(batches, level=level):
                node_of = at >> (depth - level)
                for batch in batches:
                    for r in batch.to_pylist():
                        x = np.frombuffer(r["x"]).reshape(-1, dim)
                        out_of = ~np.isin(node_of, (r["near"] or [r["node"]]) if strong else [r["node"]])
                        others = [np.frombuffer(o).reshape(-1, dim) for o in r["others"] or []]
                        proxies = np.concatenate([sample[out_of], *([o[:: max(1, len(o) // 16)] for o in others] if strong else others)])
                        # Points at one place have one row and one column: others like them tell nothing more.
                        proxies, (first, place) = proxies[_places(proxies)[0]], _places(x)
                        a = block(kernel, proxies, x[first], h) if len(proxies) else np.zeros((0, len(first)))
                        if a.shape[0] > a.shape[1] > 0:
                            a = np.linalg.qr(a, mode="r")
                        cols, p = interpolative(a, tol, most) if a.size else (np.zeros(0, int), np.zeros((0, len(first))))
                        cols, p = first[cols], p[:, place]
                        yield pa.RecordBatch.from_arrays([pa.array([r["node"]]), pa.array([level], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([len(cols)], pa.int32()), pa.array([r["rl"]], pa.int32()), pa.array([r["x"]], pa.binary()), pa.array([_outer(np.ascontiguousarray(p.T))], pa.binary()), pa.array([_outer(x[cols])], pa.binary())], [f.split()[0] for f in _NODE.split(", ")])

            made = written(spread(rows, "node").mapInArrow(skeletons, _NODE))
            out.append(made)
            cands = made.groupBy(F.shiftright("node", 1).alias("node")).agg(F.sum("r").cast("int").alias("c"), F.min_by("r", "node").alias("rl"), F.concat(F.min_by("s", "node"), F.max_by("s", "node")).alias("x"))
        self.top = written(cands)  # the root's candidates: its children's skeletons
        return reduce(DataFrame.union, out)

    # -- passes through the tree -------------------------------------------------------------------------------------

    def _chunks(self) -> list[tuple[int, int]]:
        """(highest, lowest level) of the rounds, from the leaves up."""
        out, b = [], self.depth
        while b >= 1:
            out.append((max(1, b - CHUNK + 1), b))
            b = out[-1][0] - 1
        return out

    def _vector(self, w: DataFrame) -> tuple[DataFrame, int, bool]:
        """Leaf vectors, the number of right-hand sides, and whether w was scalar."""
        scalar = not w.schema["w"].dataType.simpleString().startswith("array")
        has_i, dtype = "wi" in w.columns, self.dtype
        as_array = lambda c: F.array(F.col(c).cast("double")) if scalar else F.col(c).cast("array<double>")
        cols = [as_array("w").alias("w"), *([as_array("wi").alias("wi")] if has_i else [])]
        k = 1 if scalar else w.agg(F.max(F.size("w"))).first()[0] or 1
        zero = F.array_repeat(F.lit(0.0), k)
        fill = lambda c: F.transform(F.coalesce(F.col(c), zero), lambda v: F.coalesce(v, F.lit(0.0))).alias(c)
        both = self.points.select("id", "node").join(w.select("id", *cols), "id", "left").select("node", "id", fill("w"), *([fill("wi")] if has_i else []))
        held = both.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("id", "w", *(["wi"] if has_i else [])))).alias("m"))
        depth = self.depth

        def pack(batches):
            for batch in batches:
                for node, m in zip(batch.column("node").to_pylist(), batch.column("m"), strict=True):
                    v = np.asarray(m.values.field("w").flatten(), float).reshape(-1, k).astype(dtype)
                    if has_i:
                        v = v + 1j * np.asarray(m.values.field("wi").flatten(), float).reshape(-1, k)
                    yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([depth], pa.int32()), pa.array([0], pa.int32()), pa.array([_outer(v)], pa.binary())], ["node", "level", "kind", "v"])

        if has_i and dtype is np.float64:
            raise ValueError("imaginary parts need a complex kernel")
        return written(held.mapInArrow(pack, _VECTOR)), k, scalar

    def _up(self, nodes: DataFrame, leaf: DataFrame, k: int, own: bool = False) -> DataFrame:
        """Vectors of all nodes, kind 0: T' times the leaf's or the children's vectors; with own, kind 1: G times those."""
        dtype, depth, out, feed = self.dtype, self.depth, [], leaf
        for a, b in self._chunks():

            def climb(left: pa.Table, right: pa.Table) -> pa.Table:
                z, rows = {r["node"]: np.frombuffer(r["v"], dtype).reshape(-1, k) for r in right.to_pylist()}, []
                for r in sorted(left.to_pylist(), key=lambda r: -r["level"]):
                    node = r["node"]
                    v = z[node] if r["level"] == depth else np.concatenate([z[2 * node], z[2 * node + 1]])
                    z[node] = np.frombuffer(r["t"], dtype).reshape(r["c"], r["r"]).T @ v
                    rows.append((node, r["level"], 0, _outer(z[node])))
                    if own:
                        rows.append((node, r["level"], 1, _outer(np.frombuffer(r["g"], dtype).reshape(r["c"], r["c"]) @ v)))
                return _vectors(rows)

            part = nodes.where(F.col("level").between(a, b)).withColumn("top", F.expr(f"shiftright(node, level - {a})"))
            fed = feed.withColumn("top", F.expr(f"shiftright(node, level - {a})"))
            got = written(spread(part, "top").groupBy("top").cogroup(spread(fed, "top").groupBy("top")).applyInArrow(climb, _VECTOR))
            out.append(got)
            feed = got.where(f"level = {a} and kind = 0")
        return reduce(DataFrame.union, out)

    def _down(self, nodes: DataFrame, given: DataFrame, k: int) -> DataFrame:
        """Leaf vectors from given vectors of nodes: kind 2 in skeletons, kind 1 in candidates."""
        dtype, depth, carried = self.dtype, self.depth, None
        for a, b in reversed(self._chunks()):

            def descend(left: pa.Table, right: pa.Table) -> pa.Table:
                skeleton, whole, rows = {}, {}, []
                for r in right.to_pylist():
                    into = whole if r["kind"] == 1 else skeleton
                    v = np.frombuffer(r["v"], dtype).reshape(-1, k)
                    into[r["node"]] = into[r["node"]] + v if r["node"] in into else v
                for r in sorted(left.to_pylist(), key=lambda r: r["level"]):
                    node, v = r["node"], np.zeros((r["c"], k), dtype)
                    if node in skeleton:
                        v = v + np.frombuffer(r["t"], dtype).reshape(r["c"], r["r"]) @ skeleton[node]
                    if node in whole:
                        v = v + whole[node]
                    if r["level"] == depth:
                        rows.append((node, depth, 0, _outer(v)))
                        continue
                    for child, part in ((2 * node, v[: r["rl"]]), (2 * node + 1, v[r["rl"] :])):
                        if r["level"] == b:
                            rows.append((child, b + 1, 2, _outer(part)))
                        else:
                            skeleton[child] = skeleton[child] + part if child in skeleton else part
                return _vectors(rows)

            part = nodes.where(F.col("level").between(a, b)).withColumn("top", F.expr(f"shiftright(node, level - {a})"))
            fed = given.where(F.col("level").between(a, b)).select("node", "level", "kind", "v")
            fed = (fed if carried is None else fed.union(carried)).withColumn("top", F.expr(f"shiftright(node, level - {a})"))
            carried = written(spread(part, "top").groupBy("top").cogroup(spread(fed, "top").groupBy("top")).applyInArrow(descend, _VECTOR))
        return carried

    def _by_id(self, vectors: DataFrame, k: int, scalar: bool, name: str) -> DataFrame:
        """(id, name) and name + 'i' for complex kernels, from the sums of leaf vectors."""
        dtype, pair = self.dtype, self.dtype is np.complex128
        kind = "double" if scalar else "array<double>"

        def place(left: pa.Table, right: pa.Table) -> pa.Table:
            cols = {"id": pa.array([], pa.int64()), name: pa.array([], pa.float64() if scalar else pa.list_(pa.float64()))}
            if len(left):
                ids, v = np.frombuffer(left["ids"][0].as_py(), np.int64), sum(np.frombuffer(r, dtype).reshape(-1, k) for r in right["v"].to_pylist())
                v = np.zeros((len(ids), k), dtype) + v
                shape = lambda u: pa.array(u[:, 0]) if scalar else pa.array(u.tolist(), pa.list_(pa.float64()))
                cols = {"id": pa.array(ids), name: shape(v.real), **({f"{name}i": shape(v.imag)} if pair else {})}
            elif pair:
                cols[f"{name}i"] = cols[name]
            return pa.table(cols)

        schema = f"id long, {name} {kind}" + (f", {name}i {kind}" if pair else "")
        return self.leaves.groupBy("node").cogroup(vectors.groupBy("node")).applyInArrow(place, schema)

    def _near(self, leaf: DataFrame, k: int) -> DataFrame:
        """Dense blocks times leaf vectors."""
        kernel, h, diagonal, dim, dtype = self.kernel, self.h, self.diagonal, self.dim, self.dtype

        def apply(batches):
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    x, y, v = np.frombuffer(r["xm"]).reshape(-1, dim), np.frombuffer(r["xn"]).reshape(-1, dim), np.frombuffer(r["v"], dtype).reshape(-1, k)
                    rows.append((r["node_m"], 0, 0, _outer(block(kernel, x, y, h) @ v + (diagonal * v if r["node_m"] == r["node_n"] else 0))))
                yield from _vectors(rows).to_batches()

        side = lambda s: self.leaves.select(F.col("node").alias(f"node_{s}"), F.col("x").alias(f"x{s}"))
        both = self.dense.join(side("m"), "node_m").join(side("n"), "node_n").join(leaf.select(F.col("node").alias("node_n"), "v"), "node_n")
        return spread(both, "node_m", "node_n").mapInArrow(apply, _VECTOR)

    def _coupled(self, z: DataFrame, k: int) -> DataFrame:
        """Far blocks: each node's sum over its partners, in skeletons."""
        kernel, h, dim, dtype = self.kernel, self.h, self.dim, self.dtype

        def apply(batches):
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    x, y = np.frombuffer(r["sm"]).reshape(-1, dim), np.frombuffer(r["sn"]).reshape(-1, dim)
                    rows.append((r["node_m"], r["level"], 2, _outer((block(kernel, x, y, h) @ np.frombuffer(r["v"], dtype).reshape(-1, k)).astype(dtype))))
                yield from _vectors(rows).to_batches()

        side = lambda s: self.nodes.select(F.col("node").alias(f"node_{s}"), F.col("s").alias(f"s{s}"))
        return self.low.join(side("m"), "node_m").join(side("n"), "node_n").join(z.where("kind = 0").select(F.col("node").alias("node_n"), "v"), "node_n").mapInArrow(apply, _VECTOR)

    # -- operations --------------------------------------------------------------------------------------------------

    def multiply(self, w: DataFrame) -> DataFrame:
        """id, y (and yi) of the matrix times w."""
        leaf, k, scalar = self._vector(w)
        out = self._near(leaf, k)
        if self.depth:
            out = out.union(self._down(self.nodes, self._coupled(self._up(self.nodes, leaf, k), k), k))
        return self._by_id(out, k, scalar, "y")

    def factor(self) -> Nested:
        """Makes solve and logdet ready. Weak plans only."""
        if self.options.strong:
            raise ValueError("only weak plans have direct factors; solve strong ones by iteration")
        kernel, h, diagonal, dim, dtype, depth, jitter = self.kernel, self.h, self.diagonal, self.dim, self.dtype, self.depth, self.options.jitter
        schema = _NODE + ", g binary, d binary, phase_re double, phase_im double, logabs double"
        names, kinds = [f.split()[0] for f in schema.split(", ")], [pa.int64(), *[pa.int32()] * 4, *[pa.binary()] * 5, *[pa.float64()] * 3]

        def inverse(d: np.ndarray) -> np.ndarray:
            """Singular values under jitter of the norm are raised to it."""
            if not d.size:
                return d
            try:
                out = np.linalg.inv(d)
                if np.isfinite(out).all():
                    return out
            except np.linalg.LinAlgError:
                pass
            u, s, v = np.linalg.svd(d)
            return (v.conj().T / np.maximum(s, jitter * max(1e-300, np.linalg.norm(d)))) @ u.conj().T

        def own_block(r: dict, reduced: dict) -> np.ndarray:
            x = np.frombuffer(r["x"]).reshape(-1, dim)
            k = block(kernel, x, x, h).astype(dtype)
            if r["level"] == depth:
                return k + diagonal * np.eye(len(x))
            k[: r["rl"], : r["rl"]], k[r["rl"] :, r["rl"] :] = reduced[2 * r["node"]], reduced[2 * r["node"] + 1]
            return k

        def climb(left: pa.Table, right: pa.Table) -> pa.Table:
            reduced = {r["node"]: np.frombuffer(r["d"], dtype).reshape(r["r"], r["r"]) for r in right.to_pylist()}
            rows = []
            for r in sorted(left.to_pylist(), key=lambda r: -r["level"]):
                d, t = own_block(r, reduced), np.frombuffer(r["t"], dtype).reshape(r["c"], r["r"])
                back = inverse(d)
                small = inverse(t.T @ back @ t)
                e = back @ t @ small
                (p, a), (q, b) = np.linalg.slogdet(d), np.linalg.slogdet(small)
                phase = p / q if q else p
                reduced[r["node"]] = small
                rows.append((r["node"], r["level"], r["c"], r["r"], r["rl"], r["x"], _outer(e), r["s"], _outer(back - e @ t.T @ back), _outer(small), float(phase.real), float(phase.imag), float(a - b)))
            return _table(rows, names, kinds)

        def root(t: pa.Table) -> pa.Table:
            rows = {r["node"]: r for r in t.to_pylist()}
            reduced = {n: np.frombuffer(r["d"], dtype).reshape(r["r"], r["r"]) for n, r in rows.items() if n > 1}
            d = own_block(rows[1], reduced)
            phase, logabs = np.linalg.slogdet(d)
            return _table([(1, 0, len(d), 0, rows[1]["rl"], None, None, None, _outer(inverse(d)), None, float(phase.real), float(phase.imag), float(logabs))], names, kinds)

        out, feed = [], None
        for a, b in self._chunks():
            part = self.nodes.where(F.col("level").between(a, b)).withColumn("top", F.expr(f"shiftright(node, level - {a})"))
            feed = self.nodes.limit(0).select("node", "level", "r", F.lit(None).cast("binary").alias("d")) if feed is None else feed
            fed = feed.withColumn("top", F.expr(f"shiftright(node, level - {a})"))
            out.append(written(spread(part, "top").groupBy("top").cogroup(spread(fed, "top").groupBy("top")).applyInArrow(climb, schema)))
            feed = out[-1].where(f"level = {a}").select("node", "level", "r", "d")
        whole = self.leaves.select("node", F.lit(0).alias("level"), F.lit(0).alias("r"), F.lit(0).alias("rl"), "x", F.lit(None).cast("binary").alias("d"))
        if self.depth:
            whole = self.top.select("node", F.lit(0).alias("level"), F.lit(0).alias("r"), "rl", "x", F.lit(None).cast("binary").alias("d"))
            whole = whole.union(feed.select("node", "level", "r", F.lit(0), F.lit(None).cast("binary"), "d"))
        self.root = written(whole.groupBy(F.lit(True)).applyInArrow(root, schema))  # two skeletons' size, or one leaf
        self.factors = reduce(DataFrame.union, out) if out else None
        return self

    def solve(self, b: DataFrame) -> DataFrame:
        """id, w (and wi): the matrix's inverse times b, by the factors."""
        if self.factors is None and not hasattr(self, "root"):
            self.factor()
        leaf, k, scalar = self._vector(b)
        dtype = self.dtype

        def at_root(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return _vectors([])
            r, z = left.to_pylist()[0], {x["node"]: np.frombuffer(x["v"], dtype).reshape(-1, k) for x in right.to_pylist()}
            f = np.frombuffer(r["g"], dtype).reshape(r["c"], r["c"]) @ np.concatenate([z[n] for n in sorted(z)])
            return _vectors([(1, 0, 0, _outer(f))] if set(z) == {1} else [(2, 1, 2, _outer(f[: r["rl"]])), (3, 1, 2, _outer(f[r["rl"] :]))])

        z = self._up(self.factors, leaf, k, own=True) if self.depth else leaf
        first = z.where(f"level = {min(1, self.depth)} and kind = 0")
        f = self.root.groupBy(F.lit(True)).cogroup(first.groupBy(F.lit(True))).applyInArrow(at_root, _VECTOR)
        if self.depth:
            f = self._down(self.factors, z.where("kind = 1").union(f), k)
        return self._by_id(f, k, scalar, "w")

    def logdet(self) -> tuple[complex, float]:
        """(phase, logarithm of the absolute determinant); phases are multiplied as summed angles."""
        if not hasattr(self, "root"):
            self.factor()
        both = self.root if self.factors is None else self.factors.select(self.root.columns).union(self.root)
        angle, logabs = both.agg(F.sum(F.atan2("phase_im", "phase_re")), F.sum("logabs")).first()
        return complex(np.exp(1j * (angle or 0.0))), logabs or 0.0

    def extract(self, requests: DataFrame) -> DataFrame:
        """i, j, v (and vi): entries of the compressed matrix for requested (i, j), in rows that climb to the level of their block."""
        dtype, kernel, h, dim, diagonal = self.dtype, self.kernel, self.h, self.dim, self.diagonal
        place = lambda s: self.points.select(F.col("id").alias(s), F.col("node").alias(f"n{s}"), F.col("x").alias(f"x{s}"))
        asked = requests.select("i", "j").join(place("i"), "i").join(place("j"), "j")
        asked = asked.withColumn("req", F.monotonically_increasing_id())
        asked = written(asked)
        near = asked.join(self.dense, (F.col("ni") == F.col("node_m")) & (F.col("nj") == F.col("node_n")), "left_semi")

        def direct(batches):
            for batch in batches:
                rows = batch.to_pylist()
                v = np.array([block(kernel, np.array([r["xi"]]), np.array([r["xj"]]), h)[0, 0] + diagonal * (r["i"] == r["j"]) for r in rows], dtype)
                yield pa.RecordBatch.from_arrays([pa.array([r["i"] for r in rows], pa.int64()), pa.array([r["j"] for r in rows], pa.int64()), pa.array(v.real), pa.array(v.imag)], ["i", "j", "v", "vi"])

        schema = "i long, j long, v double, vi double"
        out = near.mapInArrow(direct, schema)
        if self.depth:
            ids = self.leaves.select("node", "ids")
            state = None
            for s in ("i", "j"):
                row = asked.select("req", F.lit(s).alias("side"), F.col(s).alias("id"), F.col(f"n{s}").alias("node"))
                state = row if state is None else state.union(row)
            state = state.join(ids, "node").withColumn("v", F.lit(None).cast("binary")).withColumn("left", F.lit(True))
            depth = self.depth
            for level in range(depth, 0, -1):

                def climb(batches, level=level):
                    for batch in batches:
                        rows = []
                        for r in batch.to_pylist():
                            t = np.frombuffer(r["t"], dtype).reshape(r["c"], r["r"])
                            if level == depth:
                                v = t[np.searchsorted(np.frombuffer(r["ids"], np.int64), r["id"])]
                            else:
                                v = np.frombuffer(r["v"], dtype) @ (t[: r["rl"]] if r["left"] else t[r["rl"] :])
                            rows.append((r["req"], r["side"], r["node"], level, _outer(v), r["s"]))
                        yield from _table(rows, ["req", "side", "node", "level", "v", "s"], [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]).to_batches()

                at_level = self.nodes.where(f"level = {level}").select("node", "c", "r", "rl", "t", "s")
                now = written(state.join(at_level, "node").mapInArrow(climb, "req long, side string, node long, level int, v binary, s binary"))
                a, b = (now.where(f"side = '{s}'").select("req", F.col("node").alias(f"node_{m}"), F.col("v").alias(f"v{s}"), F.col("s").alias(f"s{s}")) for s, m in (("i", "m"), ("j", "n")))
                met = a.join(b, "req").join(self.low.select("node_m", "node_n"), ["node_m", "node_n"], "left_semi")

                def couple(batches):
                    for batch in batches:
                        rows = batch.to_pylist()
                        v = np.array([np.frombuffer(r["vi"], dtype) @ block(kernel, np.frombuffer(r["si"]).reshape(-1, dim), np.frombuffer(r["sj"]).reshape(-1, dim), h) @ np.frombuffer(r["vj"], dtype) for r in rows], dtype)
                        yield pa.RecordBatch.from_arrays([pa.array([r["i"] for r in rows], pa.int64()), pa.array([r["j"] for r in rows], pa.int64()), pa.array(v.real), pa.array(v.imag)], ["i", "j", "v", "vi"])

                out = out.union(met.join(asked.select("req", "i", "j"), "req").mapInArrow(couple, schema))
                state = now.select("req", "side", F.lit(None).cast("long").alias("id"), F.shiftright("node", 1).alias("node"), F.lit(None).cast("binary").alias("ids"), "v", (F.col("node") % 2 == 0).alias("left"))
        return out if dtype is np.complex128 else out.drop("vi")

    def solve_iterative(self, b: DataFrame, method: str = "gmres", precondition: Nested | None = None) -> tuple[DataFrame, list[float]]:
        """Solution (id, w) and residuals by gmres, tfqmr or refine, preconditioned by another matrix's factors; real kernels."""
        given = {"tol": self.options.tol_solve, "most": self.options.max_iter}
        if method == "gmres":
            given["restart"] = self.options.restart
        if precondition is not None:
            given["precondition"] = lambda v: precondition.solve(v).withColumnRenamed("w", "y")
        return solvers.solve(self.multiply, b, method, **given)

    # -- reports and checks ------------------------------------------------------------------------------------------

    def structure(self) -> DataFrame:
        """A row for each block: level, node_m, node_n, kind, rows, cols and ranks."""
        size = self.tree.select("node", "n")
        low, near = self.low.withColumn("kind", F.lit("low_rank")), self.dense.select("node_m", "node_n", F.lit(self.depth).alias("level"), F.lit("dense").alias("kind"))
        out = low.union(near).join(size.select(F.col("node").alias("node_m"), F.col("n").alias("rows")), "node_m").join(size.select(F.col("node").alias("node_n"), F.col("n").alias("cols")), "node_n")
        if not self.depth:
            return out.withColumn("rank_m", F.lit(None).cast("int")).withColumn("rank_n", F.lit(None).cast("int"))
        rank = self.nodes.select("node", "r")
        return out.join(rank.select(F.col("node").alias("node_m"), F.col("r").alias("rank_m")), "node_m", "left").join(rank.select(F.col("node").alias("node_n"), F.col("r").alias("rank_n")), "node_n", "left")

    def statistics(self) -> DataFrame:
        """level, nodes, least, mean and largest rank, numbers stored for T and for skeletons."""
        rows = self.nodes if self.depth else self.leaves.select(F.lit(0).alias("level"), F.lit(0).alias("r"), "c").limit(0)
        return rows.groupBy("level").agg(F.count("*").alias("nodes"), F.min("r").alias("least_rank"), F.avg("r").alias("mean_rank"), F.max("r").alias("largest_rank"), F.sum(F.col("c") * F.col("r")).alias("basis_numbers"), F.sum(F.col("r") * self.dim).alias("skeleton_numbers"))

    def error(self, w: DataFrame, sample: int = 20) -> float:
        """Relative error of the product at some points, against exact rows; real kernels, scalar w."""
        some = self.points.orderBy(F.xxhash64("id")).limit(sample).select("id", "x")
        exact = dense.multiply(some, self.points.join(w.select("id", "w"), "id").select("id", "x", "w"), self.kernel, self.h, self.diagonal).withColumnRenamed("y", "e")
        got = self.multiply(w).join(exact, "id").agg(F.sqrt(F.sum(F.pow(F.col("y") - F.col("e"), 2)) / F.sum(F.col("e") * F.col("e")))).first()
        return got[0] or 0.0

    def entry_error(self, sample: int = 40) -> float:
        """Relative error of all entries between some points and some others, against the kernel; real kernels."""
        order = lambda seed: self.points.orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample)
        asked = order(1).select(F.col("id").alias("i"), F.lit(0).alias("k")).join(order(2).select(F.col("id").alias("j"), F.lit(0).alias("k")), "k").select("i", "j")
        exact = dense.extract(self.points.select("id", "x"), asked, self.kernel, self.h, self.diagonal).withColumnRenamed("v", "e")
        got = self.extract(asked).join(exact, ["i", "j"]).agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("e"), 2)) / F.sum(F.col("e") * F.col("e")))).first()
        return got[0] or 0.0

    def solution_error(self, seed: int = 42) -> float:
        """Relative error of solving for a hashed vector's product."""
        x = self.points.select("id", (F.xxhash64(F.lit(seed), "id") / F.lit(float(2**63))).alias("w"))
        y = written(self.multiply(x).select("id", F.col("y").alias("w")))
        both = self.solve(y).withColumnRenamed("w", "got").join(x, "id")
        return both.agg(F.sqrt(F.sum(F.pow(F.col("got") - F.col("w"), 2)) / F.sum(F.col("w") * F.col("w")))).first()[0] or 0.0

    def shifted(self, by: float) -> Nested:
        """The same matrix with another diagonal, on the same bases."""
        import copy

        other = copy.copy(self)
        other.diagonal, other.factors = self.diagonal + by, None
        other.__dict__.pop("root", None)
        return other

    def eigenpairs(self, n: int = 4, near: float | None = None, steps: int = 60, tol: float = 1e-8):
        """Eigenvalues of largest size, or nearest to ``near`` by shift and inverse; vectors and residuals as in solvers.eigenpairs."""
        ids = self.points.select("id")
        if near is None:
            return solvers.eigenpairs(self.multiply, ids, n, steps, tol)
        moved = self.shifted(-near).factor()
        values, vectors, errors = solvers.eigenpairs(lambda v: moved.solve(v).withColumnRenamed("w", "y"), ids, n, steps, tol)
        return near + 1 / values, vectors, errors


def ridge_fit(train: DataFrame, kernel: str, h: float, ridge: float, options: Options = Options()) -> DataFrame:
    """Weights (id, x, w) of kernel ridge regression on (id, x, label), by direct factors."""
    w = Nested(train, kernel, h, ridge, options).solve(train.select("id", F.col("label").cast("double").alias("w")))
    return train.select("id", "x").join(w, "id")


def ridge_predict(points: DataFrame, weights: DataFrame, kernel: str, h: float) -> DataFrame:
    return dense.multiply(points, weights, kernel, h).withColumn("label", F.signum("y").cast("int"))
