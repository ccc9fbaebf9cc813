"""Connected components by alternating large and small stars, on edges of ids only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import table


def _stars(pairs: DataFrame) -> DataFrame:
    """Rows (u, v), u's neighbours, with the smallest of them and u as m. The minimum is aggregated before it is joined, so a hot u is split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node on an edge with the smallest node reachable. Nulls and loops link nothing."""
    now = table(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        now = table(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select("v", "m")).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            stars = now.groupBy("u").agg(F.min("v").alias("m"))
            return stars.select(F.col("u").alias("node"), F.col("m").alias("component")).union(now.select("v", F.col("v").alias("c")).distinct())
        before = state
