"""Cluster trees by recursive median bisection.

Groups of more than TASK coordinates are split level by level: ranks come from a range sort (a row's number in its
partition plus the sizes of the group's earlier partitions), so no group is gathered into one task even at the root.
A smaller group is finished in one task, with all its levels, so the rounds are log2(coordinates / TASK).

Orders: natural (by id), ckd (the coordinate of largest extent), tm (distance to the point farthest from the centroid), tm_gram
(angular distance, by the kernel alone, to the point of largest mean distance to 50 sampled ones). Ties go by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernelforge.functions import kernels
from kernelforge.shared import written

#: Coordinates that one task holds, and points that stand for a group.
TASK, SAMPLE = 4_000_000, 50


def depth_of(n: int, leaf: int) -> int:
    """Smallest level with int(n / 2**level) <= leaf."""
    level = 0
    while n >> level > leaf:
        level += 1
    return level


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with rank (from 1) of each row in its group by ``order``."""
    dealt = written(df.repartitionByRange(group, *order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order))
    return dealt.withColumn("__r", inner).join(sizes, [group, "__p"]).withColumn("rank", (F.col("__r") + F.col("__before")).cast("long")).drop("__p", "__n", "__before", "__r")


def distance(a: str, b: str, periods: tuple[float, ...] = ()) -> Column:
    """Euclidean, or with periods the least over the images -1, 0 and 1 of the first three axes."""
    if not periods:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    period = F.array(*(F.lit(float(p)) for p in periods[:3]))
    gap = F.zip_with(F.zip_with(a, b, lambda u, v: F.abs(u - v)), period, lambda d, p: F.when(p.isNull() | (p == 0), d).otherwise(F.least(d, F.abs(d - p), d + p)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v * v))


def _means(x: str, dim: int) -> Column:
    return F.array(*(F.avg(F.element_at(x, i + 1)) for i in range(dim)))


def _gram(x: np.ndarray, y: np.ndarray, gram: tuple[str, float]) -> np.ndarray:
    zmn = kernels.block(gram[0], x, y, gram[1])
    own = lambda p: np.concatenate([np.diagonal(kernels.block(gram[0], p[i : i + 64], p[i : i + 64], gram[1])) for i in range(0, len(p), 64)]) if len(p) else np.zeros(0)
    return 1 - zmn * zmn / np.outer(own(x), own(y))


def _local_keys(ids: np.ndarray, x: np.ndarray, order: str, gram: tuple[str, float] | None) -> np.ndarray:
    """The sort keys of one group."""
    if order == "natural":
        return ids.astype(float)
    if order == "ckd":
        return x[:, int(np.argmax(x.max(0) - x.min(0)))]
    if order == "tm":
        d = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        return np.sqrt(((x - x[np.lexsort((ids, d))[-1]]) ** 2).sum(1))
    if order == "tm_gram":
        some = x[np.random.default_rng(len(ids)).permutation(len(ids))[:SAMPLE]]
        d = _gram(x, some, gram).mean(1)
        return _gram(x, x[np.lexsort((ids, d))[-1]][None], gram)[:, 0]
    raise ValueError(order)


def split_keys(df: DataFrame, order: str, dim: int, gram: tuple[str, float] | None = None) -> DataFrame:
    """df (id, x, node) with the key by which its node's members are sorted, for groups of any size."""
    if order == "natural":
        return df.withColumn("key", F.col("id").cast("double"))
    if order == "ckd":
        extent = [F.max(F.element_at("x", i + 1)) - F.min(F.element_at("x", i + 1)) for i in range(dim)]
        widest = df.groupBy("node").agg(F.array(*extent).alias("e")).select("node", F.array_position("e", F.array_max("e")).cast("int").alias("axis"))
        return df.join(widest, "node").withColumn("key", F.element_at("x", F.col("axis"))).drop("axis")
    if order == "tm":
        center = df.groupBy("node").agg(_means("x", dim).alias("c"))
        far = df.join(center, "node").withColumn("d", distance("x", "c"))
        end = far.groupBy("node").agg(F.max_by("x", F.struct("d", "id")).alias("end"))
        return df.join(end, "node").withColumn("key", distance("x", "end")).drop("end")
    if order == "tm_gram":
        entry = lambda a, b: kernels.entry(gram[0], a, b, gram[1])
        angle = lambda a, b: kernels.gram_distance(entry(a, b), entry(a, a), entry(b, b))
        # The SAMPLE rows of least hash in each group, by partial aggregation.
        low = df.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("k")).agg(F.min_by("x", F.xxhash64(F.lit(1), "id")).alias("x")).groupBy("node").agg(F.collect_list("x").alias("some"))
        far = df.join(low, "node").withColumn("d", F.aggregate(F.transform("some", lambda y: angle(F.col("x"), y)), F.lit(0.0), lambda s, v: s + v))
        end = far.groupBy("node").agg(F.max_by("x", F.struct("d", "id")).alias("end"))
        return df.join(end, "node").withColumn("key", angle(F.col("x"), F.col("end"))).drop("end")
    raise ValueError(order)


def _matrix(t: pa.Table, name: str = "x") -> np.ndarray:
    col = t[name].combine_chunks()
    return np.asarray(col.flatten(), float).reshape(len(t), -1)


def cluster(points: DataFrame, leaf: int = 200, order: str = "ckd", gram: tuple[str, float] | None = None, task: int | None = None) -> DataFrame:
    """points with node (heap number of the leaf, root 1), new_id (place in tree order, from 1) and depth; gram is the kernel of tm_gram and its parameter, task the points that one task takes."""
    points = written(points.withColumn("x", F.col("x").cast("array<double>")))
    n, dim = points.agg(F.count("*"), F.max(F.size("x"))).first()
    depth, done, task = depth_of(n, leaf), 0, task or TASK // max(1, dim or 1)
    now = points.withColumn("node", F.lit(1).cast("long"))
    while done < depth and n >> done > task:
        sorted_ = ranked(split_keys(now, order, dim, gram), "node", "key", "id")
        size = sorted_.groupBy("node").agg(F.max("rank").alias("size"))
        # Members [1, size] part after int((1 + size) / 2).
        now = written(sorted_.join(size, "node").withColumn("node", F.col("node") * 2 + (F.col("rank") > F.floor((F.col("size") + 1) / 2)).cast("long")).drop("size", "rank", "key"))
        done += 1

    def finish(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), _matrix(t)
        groups = [(t["node"][0].as_py(), np.arange(len(ids)))]
        for level in range(done, depth + 1):
            after = []
            for node, at in groups:
                at = at[np.lexsort((ids[at], _local_keys(ids[at], x[at], order, gram)))]
                half = (len(at) + 1) // 2
                after += [(node, at)] if level == depth else [(2 * node, at[:half]), (2 * node + 1, at[half:])]
            groups = after
        rows, sizes = np.concatenate([at for _, at in groups]), [len(at) for _, at in groups]
        t = t.drop_columns(["node"]).take(pa.array(rows))
        t = t.append_column("node", pa.array(np.repeat([node for node, _ in groups], sizes)))
        return t.append_column("rank", pa.array(np.concatenate([np.arange(1, s + 1) for s in sizes])))

    rest = [f for f in now.schema.fields if f.name != "node"]
    last = written(now.select(*(f.name for f in rest), "node").groupBy("node").applyInArrow(finish, T.StructType([*rest, T.StructField("node", T.LongType()), T.StructField("rank", T.LongType())])))
    # Places before a leaf: within the blocks of 1024 leaves, and the sums of blocks before.
    heads = last.groupBy("node").agg(F.max("rank").alias("n")).withColumn("big", F.shiftright("node", 10))
    big = heads.groupBy("big").agg(F.sum("n").alias("total"))
    before = Window.orderBy("big").rowsBetween(Window.unboundedPreceding, -1)
    big = big.select("big", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("big").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.withColumn("inner", inner).join(big, "big").select("node", (F.col("inner") + F.col("offset")).alias("head"))
    return last.join(heads, "node").withColumn("new_id", F.col("rank") + F.col("head")).withColumn("depth", F.lit(depth)).drop("rank", "head")


def tree(clustered: DataFrame, task: int | None = None) -> DataFrame:
    """node, level, n, center, radius of every node. Subtrees of at most ``task`` points are summed up in one task each; above them points are aggregated level by level."""
    n, dim, depth = clustered.agg(F.count("*"), F.max(F.size("x")), F.max("depth")).first()
    dim, depth, top = dim or 0, depth or 0, 0
    task = task or TASK // max(1, dim)
    while top < depth and n >> top > task:
        top += 1

    def below(t: pa.Table) -> pa.Table:
        leaf, x, out = t["node"].to_numpy(), _matrix(t), []
        for level in range(top, depth + 1):
            node = leaf >> (depth - level)
            order = np.argsort(node, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) > 0)))
            for at in np.split(order, cut[1:]):
                c = x[at].mean(0)
                out.append((int(node[at[0]]), level, len(at), c.tolist(), float(np.sqrt(((x[at] - c) ** 2).sum(1).max()))))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64()), strict=True)], ["node", "level", "n", "center", "radius"])

    out = clustered.select("node", "x", F.expr(f"shiftright(node, {depth - top})").alias("top")).groupBy("top").applyInArrow(lambda t: below(t), "node long, level int, n long, center array<double>, radius double")
    for level in range(top):
        here = clustered.select(F.expr(f"shiftright(node, {depth - level})").alias("node"), "x")
        center = here.groupBy("node").agg(F.count("*").alias("n"), _means("x", dim).alias("center"))
        radius = here.join(center.select("node", "center"), "node").groupBy("node").agg(F.max(distance("x", "center")).alias("radius"))
        out = out.union(center.join(radius, "node").select("node", F.lit(level).alias("level"), "n", "center", "radius"))
    return out
