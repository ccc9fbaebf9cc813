"""Approximate nearest neighbours: one navigable small-world graph per shard.

Rows go to shards of about SHARD rows by a hash of their id, so shards are even
whatever the data. A shard's equal vectors are one node with its ids of least
value (a query can't use more than k + 1 of them). Nodes get levels from the id's hash and are
inserted by searching the graph so far, in batches that are at most as large as what stands: a batch's searches go in step, its
members also see each other, and a node links to diverse ones of those found, and back, in each of its
layers. The graph is stored as flat neighbour arrays, one row a shard. Queries go in blocks to every shard,
where all of a block descend in step; shard results merge by distance and id.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do rows whose id is null; a query meets only vectors of its length; ties go
to the smaller id; of rows that repeat an id a query meets the nearest once, and asks with the least
vector; vectors of doubles are searched and measured as doubles; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernelforge.llm.shared import table
from kernelforge.llm.text import U64, mix

SHARD, LINKS, BEAM, BUILD = 16_384, 20, 96, 96
#: Queries that one task takes through a shard, nodes inserted at once, and numbers that a step of searches gathers.
BLOCK, BATCH, AT_ONCE = 2048, 1024, 1 << 22
_INDEX = "dim int, shard long, ids binary, of binary, vectors binary, entry int, layers array<struct<nodes:binary,links:binary>>"


def _scale(*xs: np.ndarray) -> float:
    """A power of two that numbers too large to be squared are divided by, which changes no order; 1 as a rule."""
    most = max((float(np.abs(x).max()) for x in xs if x.size), default=0.0)
    return 1.0 if most <= (1e15 if xs[0].dtype == np.float32 else 1e120) else 2.0 ** np.floor(np.log2(most))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None])


def _diverse(near: np.ndarray, d: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of distance, those nearer to the node than to any chosen; then the nearest of the rest."""
    if len(near) <= 1:
        return near
    between, least = _distances(x[near], x[near]), np.full(len(near), np.inf)
    chosen = []
    for c in range(len(near)):
        if len(chosen) == most:
            break
        if least[c] >= d[c]:
            chosen.append(c)
            np.minimum(least, between[c], out=least)
    rest = np.setdiff1d(np.arange(len(near)), chosen)[: most - len(chosen)]
    return near[np.concatenate((chosen, rest)).astype(np.int64)]


def _greedy(x: np.ndarray, links: np.ndarray, q: np.ndarray, now: np.ndarray, best: np.ndarray) -> None:
    """Moves each query to its nearest neighbour while that is nearer; now and best change in place."""
    moving = np.arange(len(q))
    while len(moving):
        near = links[now[moving]]
        d = ((x[near] - q[moving][:, None]) ** 2).sum(-1)
        d[near < 0] = np.inf
        k = d.argmin(1)
        least = d[np.arange(len(moving)), k]
        better = least < best[moving]
        moving = moving[better]
        now[moving], best[moving] = near[better, k[better]], least[better]


def _beams(x: np.ndarray, links: np.ndarray, q: np.ndarray, now: np.ndarray, best: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(distances, nodes) of the beam that each query ends with, -1 where there are fewer, and the number of distances taken."""
    m, n = len(q), len(x)
    beam_d, beam_n, done = np.full((m, beam), np.inf, x.dtype), np.full((m, beam), -1), np.zeros((m, beam), bool)
    beam_d[:, 0], beam_n[:, 0] = best, now
    seen = np.zeros((m, n), bool)
    seen[np.arange(m), now] = True
    active, taken = np.arange(m), 0
    while len(active):
        open_d = np.where(done[active] | (beam_n[active] < 0), np.inf, beam_d[active])
        k = open_d.argmin(1)
        go = np.isfinite(open_d[np.arange(len(active)), k])
        active, k = active[go], k[go]
        if not len(active):
            break
        done[active, k] = True
        near = links[beam_n[active, k]].astype(np.int64)
        near[seen[active[:, None], np.maximum(near, 0)]] = -1
        r, c = np.nonzero(near >= 0)
        seen[active[r], near[r, c]] = True
        taken += len(r)
        found = np.full(near.shape, np.inf, x.dtype)
        found[r, c] = ((x[near[r, c]] - q[active[r]]) ** 2).sum(-1)
        d = np.concatenate((beam_d[active], found), axis=1)
        order = np.argpartition(d, beam - 1, axis=1)[:, :beam]
        nn, dd = np.concatenate((beam_n[active], near), axis=1), np.concatenate((done[active], np.zeros(near.shape, bool)), axis=1)
        rows = np.arange(len(active))[:, None]
        beam_d[active], beam_n[active], done[active] = d[rows, order], nn[rows, order], dd[rows, order]
    return beam_d, beam_n, taken


def _insert(x: np.ndarray, layers: list[np.ndarray], level: np.ndarray, new: np.ndarray, entry: int) -> None:
    """Links new nodes into the layers' neighbour arrays, by search from the entry."""
    q, now = x[new], np.full(len(new), entry)
    best = ((q - x[entry]) ** 2).sum(1)
    for lev in range(len(layers) - 1, -1, -1):
        links, mine = layers[lev], np.flatnonzero(level[new] >= lev)
        if not len(mine):
            _greedy(x, links, q, now, best)
            continue
        found_d, found_n, _ = _beams(x, links, q, now, best, BUILD)
        k = found_d.argmin(1)
        now, best = found_n[np.arange(len(new)), k], found_d[np.arange(len(new)), k]
        peers = new[mine]
        among = _distances(x[peers], x[peers])
        np.fill_diagonal(among, np.inf)
        few = min(BUILD, len(mine) - 1)
        close = np.argpartition(among, few - 1, axis=1)[:, :few] if few else np.zeros((len(mine), 0), np.int64)
        back: dict[int, list[int]] = {}
        for i, row in enumerate(mine):
            held = found_n[row] >= 0
            near = np.concatenate((found_n[row][held], peers[close[i]]))
            d = np.concatenate((found_d[row][held], among[i, close[i]]))
            order = np.argsort(d, kind="stable")[:BUILD]
            chosen = _diverse(near[order], d[order], x, LINKS)
            links[peers[i], : len(chosen)] = chosen
            for c in chosen.tolist():
                back.setdefault(c, []).append(int(peers[i]))
        for c, more in back.items():
            near = np.unique(np.concatenate((links[c][links[c] >= 0], more)))
            near = near[near != c]
            if len(near) > links.shape[1]:
                d = ((x[near] - x[c]) ** 2).sum(1)
                order = np.argsort(d, kind="stable")
                near = _diverse(near[order], d[order], x, links.shape[1])
            links[c] = -1
            links[c, : len(near)] = near


def build_shard(ids: np.ndarray, x: np.ndarray, keep: int) -> dict:
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, first, inverse = np.unique(x.view(f"V{x.dtype.itemsize * x.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    nodes = x[first]
    rank = np.argsort(inverse, kind="stable")
    of = inverse[rank]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    held = rank[place < keep]
    h = mix(ids[first].view(U64) ^ U64(0x5EED))
    level = np.floor(-np.log(np.maximum((h >> U64(11)).astype(np.float64) / (1 << 53), 1e-12)) / np.log(LINKS)).astype(int)
    # The highest node is the entry and comes first; the others in an order that says nothing about them.
    turn = np.argsort(mix(h))
    turn = np.concatenate(([level.argmax()], turn[turn != level.argmax()]))
    layers = [np.full((len(nodes), 2 * LINKS), -1, np.int32) for _ in range(level.max() + 1)]
    done, scaled = 1, nodes / nodes.dtype.type(_scale(nodes))
    while done < len(turn):
        new = turn[done : done + min(BATCH, done)]
        _insert(scaled, layers, level, new, int(turn[0]))
        done += len(new)
    flat = []
    for lev, links in enumerate(layers):
        members = np.flatnonzero(level >= lev)
        flat.append({"nodes": members.astype(np.int32).tobytes(), "links": links[members].tobytes()})
    return {"ids": ids[held].tobytes(), "of": inverse[held].astype(np.int32).tobytes(), "vectors": nodes.tobytes(), "entry": int(turn[0]), "layers": flat}


def search_shard(index: dict, dim: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, int]:
    """The nodes that each query's beam ends with, [queries, beam], -1 where there are fewer; and the number of distances taken."""
    x = np.frombuffer(index["vectors"], q.dtype).reshape(-1, dim)
    scale, tables = q.dtype.type(_scale(x, q)), []
    x, q = x / scale, q / scale
    for layer in index["layers"]:
        members, links = np.frombuffer(layer["nodes"], np.int32), np.frombuffer(layer["links"], np.int32).reshape(-1, 2 * LINKS)
        full = links if len(members) == len(x) else np.full((len(x), 2 * LINKS), -1, np.int32)
        if len(members) < len(x):
            full[members] = links
        tables.append(full)
    out, taken, step = [], 0, max(16, AT_ONCE // (2 * LINKS * dim))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        now, best = np.full(len(part), index["entry"]), ((part - x[index["entry"]]) ** 2).sum(1)
        for links in reversed(tables[1:]):
            _greedy(x, links, part, now, best)
        _, nodes, n = _beams(x, tables[0], part, now, best, beam)
        out.append(nodes)
        taken += n
    return np.concatenate(out) if out else np.zeros((0, beam), np.int64), taken


def _kind(rows: DataFrame, vector: str) -> str:
    """The element type that vectors are searched in: their own if it is double, else float."""
    return "double" if getattr(rows.schema[vector].dataType, "elementType", None) == T.DoubleType() else "float"


def _valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col("v")
    wrong = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{_kind(rows, vector)}>").alias("v"))
    return rows.where(v.isNotNull() & ~wrong & F.exists(v, lambda e: e != 0)).withColumn("dim", F.size("v"))


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, keep: int = 11) -> DataFrame:
    """The index: a row for each shard, with flat neighbour arrays for each layer."""
    good, dtype = _valid(rows, key, vector), _kind(rows, vector) == "double" and np.float64 or np.float32
    n = good.count()
    shards = max(1, -(-n // shard))

    def one(t: pa.Table) -> pa.Table:
        dim, x = t["dim"][0].as_py(), np.array(t["v"].combine_chunks().flatten(), dtype).reshape(len(t), -1)
        index = build_shard(t["id"].to_numpy(), x, keep)
        kind = pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": [t["shard"][0].as_py()], **{k: pa.array([index[k]], pa.binary()) for k in ("ids", "of", "vectors")}, "entry": pa.array([index["entry"]], pa.int32()), "layers": pa.array([index["layers"]], kind)})

    return good.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("dim", "shard").applyInArrow(one, _INDEX)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by Euclidean distance, but itself."""
    index = table(build(rows, key, vector, shard, k + 1), "graphs")
    dtype = np.float64 if _kind(rows, vector) == "double" else np.float32
    # Of rows that repeat an id, the least vector; a vector is told apart from longer ones by its length.
    asked = _valid(rows.where(is_query), key, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = table(asked, "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    asked = asked.join(index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")), "dim")
    shards = index.select(*(F.col(c).alias(c) for c in index.columns)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        row = right.to_pylist()[0]
        dim, ids, of = row["dim"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["of"], np.int32)
        x = np.frombuffer(row["vectors"], dtype).reshape(-1, dim).astype(np.float64)
        q, q_ids = np.array(left["v"].combine_chunks().flatten(), dtype).reshape(len(left), dim), left["id"].to_numpy()
        scale = _scale(x, q.astype(np.float64))
        found, _ = search_shard(row, dim, q, max(beam, k + 1))
        cut = np.searchsorted(of, np.arange(len(x) + 1))  # ids stand in order of node
        out_q, out_i, out_d = [], [], []
        for i in range(len(q)):
            nodes = found[i][found[i] >= 0]
            d = np.sqrt(((x[nodes] / scale - q[i].astype(np.float64) / scale) ** 2).sum(1)) * scale
            count = cut[nodes + 1] - cut[nodes]
            each = ids[np.concatenate([np.arange(cut[v], cut[v + 1]) for v in nodes])]
            dist = np.repeat(d, count)
            order = np.lexsort((each, dist))
            each, dist = each[order], dist[order]
            once = np.zeros(len(each), bool)
            once[np.unique(each, return_index=True)[1]] = True  # the nearest row of a repeated id
            best = np.flatnonzero(once & (each != q_ids[i]))[:k]
            out_q.append(np.full(len(best), q_ids[i]))
            out_i.append(each[best])
            out_d.append(dist[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_i), "score": np.concatenate(out_d)})

    by = ("dim", "shard", "block")
    found = asked.groupBy(*by).cogroup(shards.groupBy(*by)).applyInArrow(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
