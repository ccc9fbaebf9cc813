"""Index arithmetic, sampling and random sources as Columns: the same for an id wherever its row stands."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def multi_index(single: Column, dims: tuple[int, ...]) -> Column:
    """Places (from 1) in each dimension of a single index (from 1), the first dimension fastest."""
    out, step = [], 1
    for n in dims:
        out.append((F.floor((single - 1) / F.lit(step)) % n + 1).cast("long"))
        step *= n
    return F.array(*out)


def single_index(multi: Column, dims: tuple[int, ...]) -> Column:
    step, out = 1, F.lit(1).cast("long")
    for i, n in enumerate(dims):
        out = out + (F.element_at(multi, i + 1) - 1) * F.lit(step)
        step *= n
    return out


def tree_level(node: Column) -> Column:
    """Level of a heap-numbered node, 0 for the root: the length of its binary form less one."""
    return (F.length(F.bin(node)) - 1).cast("int")


def bit_reversed(i: Column, bits: int) -> Column:
    """The number (from 0) of which the last ``bits`` bits are turned round."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") if bits else i


def evenly(first: int, last: int, n: int) -> list[int]:
    """n whole numbers from first to last, evenly spread."""
    return [first + math.floor(k * (last - first) / max(1, n - 1)) for k in range(n)]


def snapped(x: Column, how, near: float = 1e-14) -> Column:
    """how (F.floor or F.ceil) of x, but the nearest whole number where x is within ``near`` of it."""
    return F.when(F.abs(x - F.round(x)) < near, F.round(x)).otherwise(how(x)).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def normal(seed: int, *key: Column) -> Column:
    """A standard normal number from two hashes of the key."""
    return F.sqrt(-2 * F.log(1 - uniform(2 * seed, *key))) * F.cos(2 * math.pi * uniform(2 * seed + 1, *key))


def random_matrix(spark: SparkSession, m: int, n: int, rank: int | None = None, seed: int = 42) -> DataFrame:
    """i, j, v (from 1): normal numbers, or the product of two normal factors of the given rank."""
    cells = spark.range(1, m + 1).withColumnRenamed("id", "i").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    if rank is None:
        return cells.withColumn("v", normal(seed, F.col("i"), F.col("j")))
    terms = (normal(seed, F.col("i"), F.lit(-k)) * normal(seed + 1, F.lit(-k), F.col("j")) for k in range(1, rank + 1))
    return cells.withColumn("v", reduce(lambda a, b: a + b, terms))


def permutation(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """key and place (from 1) in a random order, by a range sort."""
    from kernelforge.plans.cluster import ranked

    dealt = df.select(key, F.lit(1).alias("__all"), F.xxhash64(F.lit(seed), key).alias("__h"))
    return ranked(dealt, "__all", "__h", key).select(key, F.col("rank").alias("place"))
