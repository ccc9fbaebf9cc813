"""Block plans over a cluster tree: HODLR, H (near and far) and BLR, and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelforge.plans.cluster import distance
from kernelforge.shared import written

_CHILD = "explode(array(struct(2*node_m as node_m, 2*node_n as node_n), struct(2*node_m as node_m, 2*node_n+1 as node_n), struct(2*node_m+1 as node_m, 2*node_n as node_n), struct(2*node_m+1 as node_m, 2*node_n+1 as node_n)))"


def far(para: float, periods: tuple[float, ...] = ()) -> Column:
    """Of joined rows with center_m, center_n, radius_m, radius_n."""
    return distance("center_m", "center_n", periods) > F.lit(para) * (F.col("radius_m") + F.col("radius_n")) / 2


def _pairs(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    for s in ("m", "n"):
        pairs = pairs.join(tree.select(F.col("node").alias(f"node_{s}"), F.col("center").alias(f"center_{s}"), F.col("radius").alias(f"radius_{s}")), f"node_{s}")
    return pairs


def hodlr(tree: DataFrame) -> DataFrame:
    """node_m, node_n, level, kind: siblings compressed at every level, leaves dense."""
    depth = tree.agg(F.max("level")).first()[0] or 0
    low = tree.where("level > 0").select(F.col("node").alias("node_m"), (F.col("node") + 1 - 2 * (F.col("node") % 2)).alias("node_n"), "level", F.lit("low_rank").alias("kind"))
    return low.union(tree.where(F.col("level") == depth).select("node", "node", F.lit(depth + 1), F.lit("dense")))


def frontier(tree: DataFrame, para: float | None, depth: int, start: int = 0, periods: tuple[float, ...] = ()) -> list[tuple[int, DataFrame]]:
    """For the levels ``start`` to ``depth``, the pairs (node_m, node_n, far) that no farness from ``start`` on has parted; para None: far if and only if they differ (no geometry)."""
    tree, out = written(tree), []
    now = tree.where("level = 0").select(F.col("node").alias("node_m"), F.col("node").alias("node_n"))
    for level in range(depth + 1):
        if level >= start:
            known = written(now.withColumn("far", F.col("node_m") != F.col("node_n")) if para is None else _pairs(now, tree).select("node_m", "node_n", far(para, periods).alias("far")))
            out.append((level, known))
            now = known.where("not far")
        now = now.select(F.expr(_CHILD).alias("c")).select("c.*")
    return out


def hierarchical(tree: DataFrame, para: float | None, start: int = 0, blr: bool = False, periods: tuple[float, ...] = ()) -> DataFrame:
    """node_m, node_n, level, kind: far pairs compressed, leaf pairs dense, others cut in four. No block is above level ``start``; blr stops there."""
    depth = start if blr else tree.agg(F.max("level")).first()[0] or 0
    out = []
    for level, known in frontier(tree, para, depth, start, periods):
        done = known.select("node_m", "node_n", F.lit(level).alias("level"), F.when(F.col("far"), "low_rank").otherwise("dense").alias("kind"))
        out.append(done if level == depth else done.where("kind = 'low_rank'"))
    return reduce(DataFrame.union, out)


def near_leaves(tree: DataFrame, para: float) -> DataFrame:
    """Leaf pairs that no ancestors' farness parts."""
    plan = hierarchical(tree, para)
    return plan.where("kind = 'dense'").select("node_m", "node_n")


def report(plan: DataFrame, tree: DataFrame) -> DataFrame:
    """Blocks and entries by level and kind."""
    size = tree.select("node", "n")
    both = plan.join(size.withColumnRenamed("node", "node_m").withColumnRenamed("n", "rows"), "node_m").join(size.withColumnRenamed("node", "node_n").withColumnRenamed("n", "cols"), "node_n")
    return both.groupBy("level", "kind").agg(F.count("*").alias("blocks"), F.sum(F.col("rows") * F.col("cols")).alias("entries"))


def colors(pairs: DataFrame) -> DataFrame:
    """(node, color) such that nodes that meet in a pair, or share a partner, have different colors: rounds of local maxima of a hashed weight."""
    one = pairs.where("node_m <> node_n").select("node_m", "node_n").distinct()
    two = one.alias("a").join(one.alias("b"), F.col("a.node_n") == F.col("b.node_m")).select(F.col("a.node_m").alias("u"), F.col("b.node_n").alias("v"))
    edges = written(one.select(F.col("node_m").alias("u"), F.col("node_n").alias("v")).union(two).where("u <> v").distinct())
    left = written(pairs.select(F.col("node_m").alias("node")).union(pairs.select("node_n")).distinct())
    out, color = [], 0
    while left.limit(1).count():
        # A color is a maximal independent set of what is left: local maxima join it, their neighbours wait.
        open_, color = left, color + 1
        while open_.limit(1).count():
            w = lambda c: F.struct(F.xxhash64(F.lit(color), c), c)
            live = edges.join(open_.withColumnRenamed("node", "u"), "u", "left_semi").join(open_.withColumnRenamed("node", "v"), "v", "left_semi")
            best = live.groupBy("u").agg(F.max(w("v")).alias("best"))
            taken = written(open_.join(best, open_["node"] == best["u"], "left").where(F.col("best").isNull() | (w("node") > F.col("best"))).select("node"))
            out.append(taken.withColumn("color", F.lit(color)))
            near = edges.join(taken.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node"))
            open_ = written(open_.join(taken.union(near), "node", "left_anti"))
            left = left.join(taken, "node", "left_anti")
        left = written(left)
    return reduce(DataFrame.union, out) if out else left.withColumn("color", F.lit(0))
