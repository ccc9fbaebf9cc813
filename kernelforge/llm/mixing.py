"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the corpus over its present
one. A document's number of copies inverts the Poisson distribution of that mean
at a uniform number hashed from seed, id and text, so the draw depends on nothing but the
row: any partitioning, retry or engine gives the same copies. The copies are
dealt out by a second hash and sorted by it within partitions, which is a global
shuffle in one exchange that no hot source can skew.

Edge cases: a null source is a source of its own, a null id or text hashes as empty;
equal rows draw alike; a source with weight 0 or not among the given weights goes; an empty
table gives an empty one. Result columns replace input columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelforge.llm.shared import join_small, table

#: Sources up to which the table of rates is broadcast (a few MB); more are joined by a shuffle.
MAX_SOURCES = 10_000
ALPHA = 0.7
SEED = "mix-1"


def cumulative(rate: float) -> list[float]:
    """P(X <= k) of a Poisson distribution for k = 0, 1, ... until it is 1 to within 1e-13."""
    if rate <= 0:
        return [1.0]
    # Terms as ratios to the likeliest one, downwards and upwards from it: none underflows that counts, at any rate.
    mode = int(rate)
    terms = [1.0]
    for k in range(mode, 0, -1):
        terms.append(terms[-1] * k / rate)
    terms.reverse()
    k = mode
    while terms[-1] > 1e-20:
        k += 1
        terms.append(terms[-1] * rate / k)
    whole, total, out = math.fsum(terms), 0.0, []
    for term in terms:
        total += term
        out.append(total / whole)
        if out[-1] >= 1 - 1e-13:
            break
    return out


def rates(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, total: float | None = None, source: str = "source") -> DataFrame:
    """A row for each source: __source, n, rate (mean copies of its documents) and cdf; without weights, shares are tempered: n ** alpha."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow("n", F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        counts = counts.join(given, counts["__source"].eqNullSafe(given["s"]), "left").select("__source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    counts = table(counts, "source-counts")
    n, whole = counts.agg(F.sum("n"), F.sum("w")).first()
    rate = F.col("w") * F.lit(float(total if total is not None else n or 0)) / F.lit(float(whole or 1)) / F.col("n")
    return counts.withColumn("rate", rate).withColumn("cdf", F.udf(cumulative, "array<double>", useArrow=False)("rate"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, total: float | None = None, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs repeated to the target weights and shuffled, with copy (from 0) and shuffle_key."""
    ident = F.coalesce(F.col(key).cast("string"), F.lit(""))
    u = uniform(F.lit(seed), ident, F.md5(F.coalesce(F.col(text), F.lit(""))))
    rate = table(rates(docs, weights, alpha, total, source), "source-rates").select("__source", "cdf")
    out = docs.drop("copy", "shuffle_key").withColumn("__u", u)
    out = join_small(out, rate, F.col(source).eqNullSafe(F.col("__source")), rows=MAX_SOURCES)
    # The number of k with P(X <= k) <= u is the inverse of the distribution at u.
    out = out.withColumn("__n", F.size(F.filter("cdf", lambda p: p <= F.col("__u")))).where("__n > 0").drop("cdf", "__source", "__u")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), ident, F.col("copy").cast("string"))))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
