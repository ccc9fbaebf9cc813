"""Low-rank factors u @ v of blocks at a tolerance: compressors, sums and recompression in numpy, and stored low-rank blocks of a plan as tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.functions.kernels import block, is_complex
from kernelforge.operators.blocks_algebra import aca, interpolative, pinv, pivoted_qr, rrqr, svd
from kernelforge.shared import spread

Factors = tuple[np.ndarray, np.ndarray]


def recompress(u: np.ndarray, v: np.ndarray, tol: float) -> Factors:
    """The same product with fewer columns, by the SVD of the small middle of two QRs."""
    q, r = np.linalg.qr(u)
    p, s = np.linalg.qr(v.T)
    a, b = svd(r @ s.T, tol)
    return q @ a, b @ p.T


def add(a: Factors, b: Factors, tol: float, scale: float = 1.0) -> Factors:
    """a + scale * b, recompressed."""
    return recompress(np.concatenate((a[0], scale * b[0]), axis=1), np.concatenate((a[1], b[1])), tol)


def add_crossed(terms: list[Factors], tol: float) -> Factors:
    """The sum of several products by cross approximation on their rows and columns: nothing of the terms' summed rank is factored."""
    m, n = terms[0][0].shape[0], terms[0][1].shape[1]
    u, v = aca(lambda i: sum(a[i] @ b for a, b in terms), lambda j: sum(a @ b[:, j] for a, b in terms), m, n, tol)
    return recompress(u, v, tol)


def norm(u: np.ndarray, v: np.ndarray) -> float:
    """Frobenius norm from the factors' small Gram matrices."""
    return float(max(0.0, np.sum((u.conj().T @ u) * (v @ v.conj().T).T).real) ** 0.5)


def grown_norm(square: float, u: np.ndarray, v: np.ndarray, du: np.ndarray, dv: np.ndarray) -> float:
    """Squared norm of u @ v + du @ dv from that of u @ v."""
    cross = np.sum((u.conj().T @ du) * (v @ dv.conj().T).conj()).real if u.size else 0.0
    return square + 2 * float(cross) + norm(du, dv) ** 2


def qr_then_svd(a: np.ndarray, tol: float) -> Factors:
    """Pivoted QR first, then the SVD of what is left of the rows."""
    q, v = rrqr(a, tol)
    u, v = svd(v, tol)
    return q @ u, v


def lq(a: np.ndarray, tol: float) -> Factors:
    """Lower factor and orthonormal rows, by row pivots."""
    q, r, order = pivoted_qr(a.conj().T, tol)
    low = np.empty_like(r.conj().T)
    low[order] = r.conj().T
    return low, q.conj().T


def least_squares(a: np.ndarray, b: np.ndarray, tol: float) -> np.ndarray:
    """The shortest solution, with singular values cut by the rank rule."""
    return pinv(a, tol) @ b


def batch_aca(rows, cols, m: int, n: int, tol: float, size: int = 64, seed: int = 42) -> Factors:
    """Cross approximation that takes ``size`` pivots at a time: rows(i) and cols(j) give several rows or columns.

    A pivoted QR of some columns of the remainder picks rows, one of these rows picks columns, and what they cross is added as a pseudo-skeleton.
    It ends when a batch adds less than the tolerance times the norm so far, or nothing.
    """
    rnd, us, vs, square = np.random.default_rng(seed), np.zeros((m, 0)), np.zeros((0, n)), 0.0
    left = np.arange(n)
    j = rnd.permutation(n)[: min(size, n)]
    while len(j):
        c = cols(j) - us @ vs[:, j]
        _, _, i = pivoted_qr(c.conj().T, 1e-15)
        i = i[: min(size, len(j), m)]
        r = rows(i) - us[i] @ vs
        picked, _ = interpolative(r, tol * 0.1, min(size, n))  # as many as the core is well conditioned for; the rest is left to the next batch
        if not len(picked):
            break
        c, core = cols(picked) - us @ vs[:, picked], r[:, picked]
        du, dv = recompress(c @ pinv(core, 1e-13), r, tol * 1e-2)
        grown = grown_norm(square, us, vs, du, dv)
        us, vs = np.concatenate((us, du), axis=1), np.concatenate((vs, dv))
        small = norm(du, dv) <= tol * max(grown, 1e-300) ** 0.5
        square, left = grown, np.setdiff1d(left, picked)
        if small or us.shape[1] >= min(m, n) or not len(left):
            break
        j = left[rnd.permutation(len(left))[: min(size, len(left))]]
    return recompress(us, vs, tol) if us.shape[1] else (np.zeros((m, 1)), np.zeros((1, n)))


def merged(get, i: np.ndarray, j: np.ndarray, tol: float, leaf: int = 64, compress=None) -> Factors:
    """Hierarchical merge: four sub-blocks' factors are joined, first side by side, then on top of each other, each time recompressed."""
    if min(len(i), len(j)) <= leaf:
        return (compress or (lambda f, p, q: svd(f(p, q), tol)))(get, i, j)
    parts = [[merged(get, p, q, tol, leaf, compress) for q in np.array_split(j, 2)] for p in np.array_split(i, 2)]
    sides = []
    for left, right in parts:
        v = np.zeros((left[1].shape[0] + right[1].shape[0], len(j)), np.result_type(left[1], right[1]))
        v[: left[1].shape[0], : left[1].shape[1]], v[left[1].shape[0] :, left[1].shape[1] :] = left[1], right[1]
        sides.append(recompress(np.concatenate((left[0], right[0]), axis=1), v, tol))
    (a, b), (c, d) = sides
    u = np.zeros((len(i), a.shape[1] + c.shape[1]), np.result_type(a, c))
    u[: len(a), : a.shape[1]], u[len(a) :, a.shape[1] :] = a, c
    return recompress(u, np.concatenate((b, d)), tol)


def skeleton(get, i: np.ndarray, j: np.ndarray, tol: float, samples: int = 200, seed: int = 42) -> Factors:
    """Pseudo-skeleton of sampled rows and columns: columns, inverse of what they cross, rows."""
    rnd = np.random.default_rng(seed)
    rows, cols = (x[np.sort(rnd.permutation(len(x))[:samples])] for x in (i, j))
    picked, _ = interpolative(get(rows, j), tol)
    other, _ = interpolative(get(i, cols).T, tol)
    return get(i, j[picked]) @ pinv(get(i[other], j[picked]), tol), get(i[other], j)


def _aca(get, i, j, tol):
    return recompress(*aca(lambda a: get(i[a : a + 1], j)[0], lambda b: get(i, j[b : b + 1])[:, 0], len(i), len(j), tol), tol)


def _batch(get, i, j, tol):
    return batch_aca(lambda a: get(i[a], j), lambda b: get(i, j[b]), len(i), len(j), tol)


#: name -> factors of get(i, j) at a tolerance.
METHODS = {
    "svd": lambda get, i, j, tol: svd(get(i, j), tol),
    "rrqr": lambda get, i, j, tol: qr_then_svd(get(i, j), tol),
    "aca": _aca,
    "batch_aca": _batch,
    "merged": lambda get, i, j, tol: merged(get, i, j, tol),
    "merged_aca": lambda get, i, j, tol: merged(get, i, j, tol, 64, lambda f, p, q: _batch(f, p, q, tol)),
    "skeleton": skeleton,
}


def compress(clustered: DataFrame, plan: DataFrame, kernel: str, h, tol: float, method: str = "batch_aca", diagonal: float = 0.0, tasks: int = 1) -> DataFrame:
    """node_m, node_n, level, kind, m, n, rank, u, v (binary; u is the block itself where kind is dense), norm2: a row for each block of a plan.

    A block's points meet in one task: right for H and BLR plans, whose large blocks are near the leaves' size; weak plans over very many points
    are compressed by nested bases instead. Each point's own diagonal, if clustered has that column, goes before the one for all. tasks: the least number of them, as what a task makes of its blocks is in memory until it is written.
    """
    depth = clustered.agg(F.max("depth")).first()[0] or 0
    sizes = plan.select("level").distinct().withColumn("at", F.least("level", F.lit(depth)))
    own = ["diagonal"] if "diagonal" in clustered.columns else []
    members = clustered.join(F.broadcast(sizes)).withColumn("node", F.expr(f"shiftright(node, {depth} - at)")).groupBy("level", "node").agg(F.sort_array(F.collect_list(F.struct("id", "x", *own))).alias("p"))
    side = lambda s: members.select("level", F.col("node").alias(f"node_{s}"), F.col("p").alias(f"p{s}"))
    both = plan.join(side("m"), ["level", "node_m"]).join(side("n"), ["level", "node_n"])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.array([p["x"] for p in r[s]], float) for s in ("pm", "pn"))
                i, j = np.arange(len(x)), np.arange(len(y))
                if r["kind"] == "dense":
                    u = block(kernel, x, y, h) + (np.eye(len(x)) * ([p["diagonal"] for p in r["pm"]] if own else diagonal) if r["node_m"] == r["node_n"] else 0)
                    v, square = np.zeros((0, len(y)), u.dtype), float(np.linalg.norm(u) ** 2)
                else:
                    u, v = METHODS[method](lambda a, b: block(kernel, x[a], y[b], h), i, j, tol)
                    square = norm(u, v) ** 2
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
                out = (r["node_m"], r["node_n"], r["level"], r["kind"], len(x), len(y), v.shape[0], np.ascontiguousarray(u).tobytes(), np.ascontiguousarray(v).tobytes(), square)
                yield pa.RecordBatch.from_arrays([pa.array([w], k) for w, k in zip(out, kinds, strict=True)], ["node_m", "node_n", "level", "kind", "m", "n", "rank", "u", "v", "norm2"])

    return spread(both, "node_m", "node_n", least=tasks).mapInArrow(run, "node_m long, node_n long, level int, kind string, m int, n int, rank int, u binary, v binary, norm2 double")


def multiply(clustered: DataFrame, stored: DataFrame, w: DataFrame, kernel: str, transpose: bool = False) -> DataFrame:
    """id, y (real) of stored blocks times w (id, w), or of the transposed matrix: one pass of products of blocks, sums by id."""
    dtype = np.complex128 if is_complex(kernel) else np.float64
    depth = clustered.agg(F.max("depth")).first()[0] or 0
    levels = [r["level"] for r in stored.select("level").distinct().collect()]  # the tree's depth at most
    at = reduce(DataFrame.union, (clustered.join(w.select("id", F.col("w").cast("double").alias("w")), "id").select(F.lit(level).alias("level"), F.expr(f"shiftright(node, {depth - min(level, depth)})").alias("node"), "id", "w") for level in levels))
    vectors = at.groupBy("level", "node").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("p"))
    into, out_of = ("node_n", "node_m") if transpose else ("node_m", "node_n")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                u = np.frombuffer(r["u"], dtype).reshape(r["m"], -1)
                a = (u, np.frombuffer(r["v"], dtype).reshape(r["rank"], r["n"])) if r["kind"] != "dense" else (u,)
                v = np.array([p["w"] for p in r["p"]])
                for f in reversed(a) if not transpose else a:
                    v = (f.T if transpose else f) @ v
                yield pa.RecordBatch.from_arrays([pa.array([r["level"]] * len(v), pa.int32()), pa.array([r[into]] * len(v), pa.int64()), pa.array(np.arange(len(v))), pa.array(np.ascontiguousarray(v.real))], ["level", "node", "place", "y"])

    y = stored.join(vectors.withColumnRenamed("node", out_of), ["level", out_of]).mapInArrow(run, "level int, node long, place long, y double").groupBy("level", "node", "place").agg(F.sum("y").alias("y"))
    places = vectors.select("level", "node", F.posexplode("p").alias("place", "p")).select("level", "node", F.col("place").cast("long").alias("place"), F.col("p.id").alias("id"))
    return places.join(y, ["level", "node", "place"], "left").groupBy("id").agg(F.sum(F.coalesce("y", F.lit(0.0))).alias("y"))


