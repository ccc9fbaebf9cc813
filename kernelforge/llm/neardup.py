"""MinHash near-duplicates by an LSH forest.

1. One pass makes each document's set of distinct word shingles, its fingerprint
   and, for each tree, a label of MAX_DEPTH MinHash values in sortable bytes. Documents with equal
   sets form one class and go on as its smallest id.
2. Each tree is one sorted order of the labels, range-partitioned by label and id, so no region
   is too large for a task. Neighbours in it are candidates by their longest common prefix: a region
   takes the least depth from MIN_DEPTH on at which it has at most CROWD rows, and MAX_DEPTH where it stays
   crowded. A pair at the threshold s that no tree joins even at MAX_DEPTH has probability
   (1 - s**MAX_DEPTH)**trees < MISS: 30 trees at 0.85, 49 at 0.8; shallower regions only add to that.
   Regions that share documents unite to candidate clusters (ids only, star contraction).
3. Each cluster's texts meet once and its exact components are searched breadth
   first on full shingle sets, where a document already reached is not compared
   again, so a dense group of n copies costs about n comparisons. A
   cluster over CHUNK shingles is cut into chunks by hash, and what the cuts
   part is recovered exactly: leaders of the chunks' components, then
   all documents outside the cluster's largest component, are compared with every chunk.

Shingles are compared by 52 bits of a hash: two of one set, or of a pair that is compared, fall together
with probability n**2 / 2**53 for n shingles.

Edge cases: null, empty or wordless texts have no shingle and link with nothing;
rows whose id is null can't be named and are left out; rows that repeat an id
are one node of the graph and return a row each; extra columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.graph import components
from kernelforge.llm.shared import join_small, table
from kernelforge.llm.text import SPACE, U64, Powers, blocks, mix, per_row, shingle_sets, string_buffer, word_hashes

MIN_DEPTH, MAX_DEPTH, MISS = 5, 7, 1e-5
#: Rows up to which a region is taken at less than MAX_DEPTH.
CROWD = 16
THRESHOLD = 85  # hundredths
#: Shingles that one task compares in memory.
CHUNK = 4_000_000
#: Probes that meet a chunk at once.
PROBES = 2_000


def trees(threshold: int) -> int:
    """Trees that all miss a pair at the threshold with probability MISS at most."""
    return 1 if threshold >= 100 else math.ceil(math.log(MISS) / math.log1p(-((threshold / 100) ** MAX_DEPTH)))


def _sets(batch, p: Powers, size: int):
    for i, j, buf, off in blocks(batch):
        row, _, _, h = word_hashes(buf, off, SPACE, p)
        yield i, j, *shingle_sets(row, h, j - i, size)


def signatures(docs: DataFrame, key: str, text: str, size: int, n_trees: int) -> DataFrame:
    """key, n_shingles, f1 and f2 (fingerprint of the set), labels (MAX_DEPTH big-endian 32-bit values for each tree; null for an empty set)."""
    seeds = mix(np.arange(7001, 7001 + n_trees * MAX_DEPTH, dtype=U64)) | U64(1)

    def run(batches):
        p = Powers()
        for batch in batches:
            for i, j, v, at in _sets(batch, p, size):
                n = np.diff(at)
                f1, f2 = per_row(np.add, mix(v), at, U64(0)), per_row(np.add, mix(v ^ U64(0x5851F42D4C957F2D)), at, U64(0))
                labels = np.zeros((j - i, len(seeds)), ">u4")
                for t, seed in enumerate(seeds):
                    labels[:, t] = per_row(np.minimum, v * seed, at, U64(0)) >> U64(32)
                each = [x.tobytes() if k else None for x, k in zip(labels, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(each, pa.binary())], ["key", "n_shingles", "f1", "f2", "labels"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_shingles long, f1 long, f2 long, labels binary")


def _regions(batches):
    """From a partition of a sorted tree: edges (a, b) from the first key of each region.

    What regions a partition's ends belong to, its neighbours decide too: rows with ``region`` (tree and prefix) give a key there and how many rows it stands for.
    """
    held = [(b.column("tree").to_numpy(), b.column("key").to_numpy(), string_buffer(b.column("label"))[0]) for b in batches if len(b)]
    if not held:
        return
    tree, key, flat = (np.concatenate(x) for x in zip(*held, strict=True))
    n, label = len(key), flat.reshape(len(key), -1)
    same, common = tree[1:] == tree[:-1], np.zeros(n, np.int64)  # common: length of the prefix shared with the row before
    for d in range(MAX_DEPTH):
        same = same & (label[1:, 4 * d : 4 * d + 4] == label[:-1, 4 * d : 4 * d + 4]).all(axis=1)
        common[1:] += same
    left = np.ones(n, bool)
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        start = np.flatnonzero(common < depth)
        size = np.diff(np.append(start, n))
        settled = (size <= CROWD) | (depth == MAX_DEPTH)
        for e in {0, len(start) - 1}:
            at, few = start[e], size[e] <= CROWD and depth < MAX_DEPTH
            keys = key[at : at + size[e]] if few else key[at : at + 1]
            prefix = int(tree[at]).to_bytes(4, "big") + label[at, : 4 * depth].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.int64()), pa.array([prefix] * len(keys), pa.binary()), pa.array(np.ones(len(keys), np.int64) if few else size[e : e + 1])], ["a", "b", "region", "n"])
            settled[e] &= depth == MAX_DEPTH
        lead, done = np.repeat(key[start], size), np.repeat(settled, size)
        take = np.flatnonzero(left & done & (lead != key))
        for k in range(0, len(take), 1 << 16):
            t = take[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(lead[t]), pa.array(key[t]), pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.int64())], ["a", "b", "region", "n"])
        left &= ~done


def candidates(reps: DataFrame, n_trees: int) -> DataFrame:
    """Edges (a, b) between documents of one region of some tree."""
    label = F.expr(f"transform(sequence(0, {n_trees - 1}), t -> substring(labels, t * {4 * MAX_DEPTH} + 1, {4 * MAX_DEPTH}))")
    forest = reps.select(F.posexplode(label).alias("tree", "label"), "key")
    order = forest.repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    found = table(order.mapInArrow(_regions, "a long, b long, region binary, n long"), "forest")
    ends = found.where("region is not null").select("region", "a", "n")
    few = (F.col("total") <= CROWD) | (F.length("region") == 4 + 4 * MAX_DEPTH)
    crossing = ends.groupBy("region").agg(F.min("a").alias("least"), F.sum("n").alias("total"), F.count("*").alias("rows")).where((F.col("rows") > 1) & few)
    return found.where("b is not null").select("a", "b").union(ends.join(crossing, "region").select(F.col("least").alias("a"), F.col("a").alias("b")))


class _Chunk:
    """Shingle sets of some documents in order of size, for exact intersections."""

    def __init__(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        n = np.array([len(v) for v in values], np.int64)
        order = np.argsort(n, kind="stable")
        self.keys, self.n = keys[order], n[order]
        self.values = [values[i] for i in order]

    def flat(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.values[i] for i in docs]), np.concatenate(([0], np.cumsum(self.n[docs])))


def _dense(groups: list[list[np.ndarray]]) -> tuple[list[list[np.ndarray]], int]:
    """Shingles as small integers."""
    flat = [v for g in groups for v in g]
    _, inverse = np.unique(np.concatenate(flat) if flat else np.zeros(0, U64), return_inverse=True)
    cut, out = np.cumsum([0, *map(len, flat)]), []
    for g in groups:
        out.append([inverse[cut[i] : cut[i + 1]].astype(np.int32) for i in range(len(g))])
        cut = cut[len(g) :]
    return out, int(inverse.max()) + 1 if len(inverse) else 0


def _linked(mine: np.ndarray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, flags: np.ndarray, threshold: int) -> np.ndarray:
    """Which of the documents in ``flat`` are similar to the set ``mine``. All sets hold something."""
    flags[mine] = True
    both = np.add.reduceat(flags[flat], at[:-1], dtype=np.int64)
    flags[mine] = False
    return 100 * both >= threshold * (len(mine) + sizes - both)


def search(keys: np.ndarray, values: list[np.ndarray], threshold: int) -> np.ndarray:
    """The smallest key of each document's component, breadth first; returns it in the order of keys."""
    (dense,), n_ids = _dense([values])
    c, flags, out = _Chunk(np.arange(len(keys)), dense), np.zeros(n_ids, bool), np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))  # positions in order of size that no component has yet
    while len(left):
        members, queue = [], [left[0]]
        left = left[1:]
        held = left
        flat, at = c.flat(held) if len(held) else (None, None)
        alive = np.ones(len(held), bool)
        n_alive = len(held)
        while queue:
            i = queue.pop()
            members.append(i)
            if not n_alive:
                continue
            if 2 * n_alive < len(held):
                held = held[alive]
                flat, at = c.flat(held)
                alive = np.ones(len(held), bool)
            size = c.n[i]
            lo = np.searchsorted(c.n[held], -(-threshold * size // 100))
            hi = np.searchsorted(c.n[held], 100 * size // threshold, "right")
            if lo >= hi:
                continue
            hit = np.zeros(len(held), bool)
            hit[lo:hi] = _linked(c.values[i], flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], c.n[held[lo:hi]], flags, threshold)
            hit &= alive
            alive &= ~hit
            n_alive -= int(hit.sum())
            queue.extend(held[hit])
        left = held[alive] if flat is not None else left
        own = c.keys[members]
        out[own] = keys[own].min()
    return out


def _read(t: pa.Table, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    p, values = Powers(), []
    for batch in t.combine_chunks().to_batches():
        for _, _, v, at in _sets(batch, p, size):
            values += np.split(v, at[1:-1])
    return t["key"].to_numpy(), values


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable over links), kept (key is its component's smallest)."""
    sigs = table(signatures(docs, key, text, size, trees(threshold)), "signatures")
    some = sigs.where("n_shingles > 0")
    classes = some.groupBy("f1", "f2", "n_shingles").agg(F.min("key").alias("rep"))
    classes = table(classes, "classes")
    every = some.join(classes, ["f1", "f2", "n_shingles"]).select("key", "n_shingles", "rep")
    every = every.union(sigs.where("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("rep")))
    reps = some.join(classes, [some["key"] == classes["rep"], some["n_shingles"] == classes["n_shingles"]], "left_semi")
    cluster = table(components(candidates(reps, trees(threshold)), "a", "b"), "clusters")
    sizes = cluster.join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node").groupBy("component").agg(F.sum("n_shingles").alias("total"))
    sizes = table(sizes.select("component", F.ceil(F.col("total") / chunk).alias("chunks")), "sizes")
    members = table(cluster.join(sizes, "component").select(F.col("node").alias("key"), "component", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk")), "members")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    held = join_small(texts, members, "key")

    def inner(group: pa.Table) -> pa.Table:
        keys, values = _read(group, size)
        full = [i for i, v in enumerate(values) if len(v)]
        own = keys.copy()
        if full:
            own[full] = search(keys[full], [values[i] for i in full], threshold)
        return pa.table({"a": own, "b": keys, "component": group["component"]})

    links = table(held.groupBy("component", "chunk").applyInArrow(inner, "a long, b long, component long"), "links")
    comp = components(links.select("a", "b"), "a", "b")
    wide = sizes.where("chunks > 1")
    if wide.limit(1).count():
        comp = table(comp, "inner")
        big = members.where("chunks > 1")
        leaders = links.select("a", "component").distinct().join(wide, "component").select(F.col("a").alias("key"), "component", "chunks")
        first = table(_probe(texts, big, leaders, size, threshold), "leader-links")
        comp = table(components(links.select("a", "b").union(first), "a", "b"), "outer")
        at = big.join(comp, big["key"] == comp["node"], "left").select("key", big["component"], "chunks", F.coalesce(comp["component"], "key").alias("own"))
        count = table(at.groupBy("component", "own").count(), "counts")
        largest = count.groupBy("component").agg(F.max_by("own", F.struct("count", "own")).alias("own"))
        rest = at.join(largest, ["component", "own"], "left_anti").join(leaders.select("key"), "key", "left_anti").select("key", "component", "chunks")
        second = table(_probe(texts, big, rest, size, threshold), "rest-links")
        comp = components(links.select("a", "b").union(first).union(second), "a", "b")
    comp = table(comp.where("node <> component").withColumnRenamed("component", "component_id").withColumnRenamed("node", "rep"), "components")
    out = join_small(every.select("key", "n_shingles", "rep"), comp, "rep", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "rep"))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))


def _probe(texts: DataFrame, big: DataFrame, probes: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) of each probe with every document of its cluster, blocks of probes against chunks."""
    probes = table(probes.distinct(), "probes")
    n_blocks = probes.groupBy("component").agg(F.ceil(F.count("*") / F.lit(PROBES)).alias("blocks"))
    asked = probes.join(n_blocks, "component").withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
    asked = join_small(texts, table(asked, "asked"), "key").select("component", "chunk", "block", F.col("key").alias("key"), F.col("text").alias("text"))
    there = big.join(n_blocks, "component").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    there = join_small(texts, table(there, "there"), "key").select("component", F.col("chunk").cast("long").alias("chunk"), "block", F.col("key").alias("key"), F.col("text").alias("text"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        (lk, lv), (rk, rv) = _read(left, size), _read(right, size)
        (lv, rv), n_ids = _dense([lv, rv])
        keep = [i for i, v in enumerate(rv) if len(v)]
        c, flags = _Chunk(rk[keep], [rv[i] for i in keep]), np.zeros(n_ids, bool)
        flat, at = c.flat(np.arange(len(keep))) if keep else (None, None)
        a, b = [], []
        for k, v in zip(lk, lv, strict=True):
            if not len(v) or flat is None:
                continue
            lo, hi = np.searchsorted(c.n, -(-threshold * len(v) // 100)), np.searchsorted(c.n, 100 * len(v) // threshold, "right")
            if lo < hi:
                hit = c.keys[lo:hi][_linked(v, flat[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], c.n[lo:hi], flags, threshold)]
                a.append(np.full(len(hit), k))
                b.append(hit)
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return asked.groupBy("component", "chunk", "block").cogroup(there.groupBy("component", "chunk", "block")).applyInArrow(compare, "a long, b long")
