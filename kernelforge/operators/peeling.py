"""A hierarchical matrix from products alone, of a symmetric operator on (id, w array) to (id, y array).

One product of random vectors tells all: with Omega a node's rows of them, Y its rows of the product and Z what Omega takes to zero, Y Z is of the
blocks beside the node's own only, so its range is the node's basis U. Of the own block D = W + U U' W' with W = (1 - U U') Y inv(Omega) is left in the
node; what remains is U times a smaller matrix on U' Omega and U' (Y - D Omega), which the parent takes up: bases are nested, and a level costs no product of its own.
A task takes a subtree of about TASK numbers, and CHUNK levels above. Columns are as many as a node has rows, and the rank and some to spare; if a
basis fills them, the rank grows by ``rate`` and the product is made anew.

Leaves of more than twice the rank are halved in tree order, so that columns are few. Edge cases: a tree of one leaf is one dense block;
an operator that is not symmetric gives a wrong matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.shared import written

#: Numbers of a product in a task, levels above that a task takes, columns beyond the rank, and the share of a product's norm that is its rounding.
TASK, CHUNK, SPARE, ROUNDING = 1_000_000, 8, 5, 1e-14
_NODE = "node long, level int, c int, r int, u binary, d binary, ids binary, omega binary, y binary, settled boolean"
_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.bool_()]


def _matrix(col) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1)))


def _hashed(v: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits to others (the finalizer of splitmix64)."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def normal(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k normal numbers for each id, the same wherever it stands."""
    step = np.array([0x9E3779B97F4A7C15], np.uint64)
    own = _hashed(ids.astype(np.int64).view(np.uint64) + step * np.uint64(seed + 1))[:, None]
    u = [((_hashed(own + step * (np.arange(k, dtype=np.uint64) * np.uint64(2) + np.uint64(1 + i))) >> np.uint64(11)) + 0.5) / 2.0**53 for i in range(2)]
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


def split(omega: np.ndarray, y: np.ndarray, tol: float, top: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """A node's u and d, and whether the columns had room to spare."""
    c, s = omega.shape
    q, r = np.linalg.qr(omega.T, mode="complete")
    inverse = lambda z: np.linalg.solve(r[:c], (z @ q[:, :c]).T).T
    if top:
        return np.zeros((c, 0)), inverse(y), True
    u, size, _ = np.linalg.svd(y @ q[:, c:], full_matrices=False)
    u = u[:, size > max(0.1 * tol * size[0], ROUNDING * np.linalg.norm(y))] if size.size else u
    w = inverse(y - u @ (u.T @ y))
    return u, w + u @ (u.T @ w.T), u.shape[1] == c or u.shape[1] <= s - c - SPARE + 1


class Peeled:
    def __init__(self, operator: Callable[[DataFrame], DataFrame], clustered: DataFrame, tol: float = 1e-6, rank: int = 16, rate: float = 2.0, rounds: int = 6, seed: int = 42) -> None:
        self.places = written(clustered.select("id", "node", "new_id", "depth"))
        n, depth = self.places.agg(F.count("*"), F.max("depth")).first()
        self.n, self.depth = n, depth or 0
        for attempt in range(rounds):
            if self._build(operator, rank, tol, seed + attempt):
                return
            rank = int(np.ceil(rank * rate))
        raise ArithmeticError("the rank did not settle")

    def _build(self, operator, k: int, tol: float, seed: int) -> bool:
        depth, extra, top = self.depth, 0, 0
        while depth and self.n >> (depth + extra) > 2 * k:
            extra += 1
        deep = depth + extra
        columns = max(2 * k, (self.n >> deep) + 1) + k + SPARE
        while top < depth and (self.n >> top) * columns > TASK:
            top += 1
        self.top, self.low = top, F.expr(f"shiftright(node, {depth - top})")

        def vectors(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(normal(batch.column("id").to_numpy(), columns, seed))], ["id", "w"])

        def climb(now: dict, ids: dict, a: int, b: int) -> pa.Table:
            """Rows of the nodes of levels a to b, of which ``now`` has omega and y at level b."""
            rows = []
            for level in range(b, a - 1, -1):
                above = {}
                for node, (omega, y) in sorted(now.items(), key=lambda e: e[0]):
                    if len(omega) > columns - (level > 0):
                        return _table([(node, level, len(omega), 0, None, None, None, None, None, False)])
                    u, d, settled = split(omega, y, tol, level == 0)
                    small = u.T @ omega, u.T @ (y - d @ omega)
                    rows.append((node, level, len(omega), u.shape[1], _bytes(u), _bytes(d), ids.get(node), *(map(_bytes, small) if level == a else (None, None)), settled))
                    above.setdefault(node >> 1, []).append(small)
                now = {node: tuple(np.concatenate(z) for z in zip(*both, strict=True)) for node, both in above.items()}
            return _table(rows)

        def below(t: pa.Table) -> pa.Table:
            t = t.sort_by("new_id")
            all_ids, leaf, y = t["id"].to_numpy(), t["node"].to_numpy(), _matrix(t["y"].combine_chunks())
            cut = np.flatnonzero(np.diff(leaf)) + 1
            now, ids = {}, {}
            for at in np.split(np.arange(len(leaf)), cut):
                parts = [(int(leaf[at[0]]), at)]
                for _ in range(extra):
                    parts = [half for node, p in parts for half in ((2 * node, p[: (len(p) + 1) // 2]), (2 * node + 1, p[(len(p) + 1) // 2 :]))]
                for node, p in parts:
                    now[node], ids[node] = (normal(all_ids[p], columns, seed), y[p]), _bytes(all_ids[p])
            return climb(now, ids, top, deep)

        def above(a: int, b: int) -> Callable[[pa.Table], pa.Table]:
            def run(t: pa.Table) -> pa.Table:
                now = {}
                for r in sorted(t.to_pylist(), key=lambda r: r["node"]):
                    now.setdefault(r["node"] >> 1, []).append([np.frombuffer(r[c]).reshape(-1, columns) for c in ("omega", "y")])
                return climb({node: tuple(np.concatenate(z) for z in zip(*both, strict=True)) for node, both in now.items()}, {}, a, b)

            return run

        y = operator(self.places.select("id").mapInArrow(vectors, "id long, w array<double>")).select("id", "y")
        self.rounds = [(top, deep)]
        self.factors = [written(self.places.select("id", "node", "new_id").join(y, "id").groupBy(self.low.alias("under")).applyInArrow(lambda t: below(t), _NODE))]
        while (b := self.rounds[-1][0] - 1) >= 0 and self._settled():
            a = max(0, b - CHUNK + 1)
            fed = self.factors[-1].where(f"level = {b + 1}").select("node", "omega", "y")
            self.factors.append(written(fed.groupBy(F.expr(f"shiftright(node, {b + 1 - a})").alias("under")).applyInArrow(above(a, b), _NODE)))
            self.rounds.append((a, b))
        return self._settled()

    def _settled(self) -> bool:
        return self.factors[-1].where("not settled").isEmpty()

    def multiply(self, w: DataFrame) -> DataFrame:
        """id, y (arrays as w)."""
        k = w.agg(F.max(F.size("w"))).first()[0] or 1

        def sweep(left: pa.Table, right: pa.Table, deepest: bool, down: bool) -> pa.Table:
            """Up through the nodes of a subtree; if ``down``, back as well, to the children's vectors or the leaves' values."""
            nodes = {r["node"]: r for r in left.to_pylist()}
            fed, given = right.filter(pc.is_valid(right["z"])), right.filter(pc.is_valid(right["v"]))
            kept = {node: tuple(np.frombuffer(r[c]).reshape(r["c"], -1 if r[m] else 0) for c, m in (("u", "r"), ("d", "c"))) for node, r in nodes.items()}
            parts = dict(zip(fed["node"].to_pylist(), fed["z"].to_pylist(), strict=True)) if not deepest else {}
            values = _matrix(fed["z"].combine_chunks()) if deepest and len(fed) else np.zeros((0, k))
            order = np.argsort(fed["node"].to_numpy()) if deepest else None
            places, z, sent = fed["node"].to_numpy()[order] if deepest else None, {}, {}
            for node in sorted(nodes, reverse=True):
                if deepest and nodes[node]["ids"] is not None:
                    ids = np.frombuffer(nodes[node]["ids"], np.int64)
                    at = np.minimum(np.searchsorted(places, ids), max(0, len(places) - 1))
                    z[node] = np.where((places[at] == ids)[:, None], values[order[at]], 0.0) if len(places) else np.zeros((len(ids), k))
                else:
                    z[node] = np.concatenate([sent[c] if c in sent else np.asarray(parts[c], float).reshape(-1, k) for c in (2 * node, 2 * node + 1) if c in sent or c in parts])
                sent[node] = kept[node][0].T @ z[node]
            if not down:
                first = min(nodes, default=None)
                out = [] if first is None else [(first, sent[first].reshape(-1).tolist())]
                return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.float64())))], ["node", "y"])
            got = {node: np.asarray(v, float).reshape(-1, k) for node, v in zip(given["node"].to_pylist(), given["v"].to_pylist(), strict=True)}
            keys, out = [np.zeros(0, np.int64)], [np.zeros((0, k))]
            pieces = []
            for node in sorted(nodes):
                u, d = kept[node]
                y = d @ z[node] + (u @ got[node] if node in got else 0)
                if deepest and nodes[node]["ids"] is not None:
                    keys.append(np.frombuffer(nodes[node]["ids"], np.int64))
                    out.append(y)
                    continue
                at = 0
                for c in (2 * node, 2 * node + 1):
                    if c in sent or c in parts:
                        size = len(sent[c]) if c in sent else len(parts[c]) // k
                        got[c] = y[at : at + size]
                        at += size
                        if c in parts:
                            pieces.append((c, got[c].reshape(-1).tolist()))
            if deepest:
                return pa.table([pa.array(np.concatenate(keys)), _lists(np.concatenate(out))], ["node", "y"])
            return pa.table([pa.array([r[i] for r in pieces], t) for i, t in enumerate((pa.int64(), pa.list_(pa.float64())))], ["node", "y"])

        none, kind = F.lit(None).cast("array<double>"), "node long, y array<double>"
        feeds, given = [self.places.join(w.select("id", F.col("w").cast("array<double>").alias("z")), "id").select(self.low.alias("under"), F.col("id").alias("node"), "z")], None

        def run(i: int, down: bool) -> DataFrame:
            a, _ = self.rounds[i]
            under = F.expr(f"shiftright(node, level - {a})").alias("under")
            fed = feeds[i].select("under", "node", "z", none.alias("v"))
            if down and given is not None:
                fed = fed.unionByName(given.select(F.col("node").alias("under"), "node", none.alias("z"), F.col("y").alias("v")))
            left = self.factors[i].select(under, "node", "level", "c", "r", "u", "d", "ids")
            return left.groupBy("under").cogroup(fed.groupBy("under")).applyInArrow(lambda x, y: sweep(x, y, i == 0, down), kind)

        for i in range(len(self.rounds) - 1):
            a = self.rounds[i + 1][0]
            feeds.append(written(run(i, False)).select(F.expr(f"shiftright(node, {self.rounds[i][0] - a})").alias("under"), "node", F.col("y").alias("z")))
        for i in reversed(range(1, len(self.rounds))):
            given = written(run(i, True))
        return run(0, True).select(F.col("node").alias("id"), "y")


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], [f.split()[0] for f in _NODE.split(", ")])
