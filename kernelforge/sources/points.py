"""Sources: points (id, x) from tables and files, matrices (i, j, v) from text and binary files, meshes, and sinks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelforge.shared import written


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("w"), "label")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points in the plane: size and retail price, scaled by fixed ranges."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50.0, F.col("p_retailprice") / 2000.0).alias("x"), (F.col("p_partkey") % 7 / 7.0).alias("w"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points on a line: the balance, scaled by a fixed range."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return df.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000.0).alias("x"))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 105000.0, F.col("l_discount") / 0.1, F.col("l_tax") / 0.08).alias("x"), F.lit(1.0).alias("w"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their place n (from 1) in the order of the files: places within partitions, and the sizes of partitions before."""
    held = written(lines.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    first = {r["p"]: r["a"] for r in held.groupBy(part.alias("p")).agg(F.min("__at").alias("a")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total - first[p] + 1
        total += sizes[p]
    if not before:
        return held.withColumn("n", F.lit(1).cast("long")).drop("__at")
    shift = F.create_map(*(F.lit(v).cast("long") for p in before for v in (p, before[p])))
    return held.withColumn("n", F.col("__at") + F.element_at(shift, part)).drop("__at")


def _cells(line: str, separator: str):
    return F.transform(F.split(F.trim(line), r"\s*,\s*" if separator == "," else r"[\s,]+"), lambda c: c.cast("double"))


def coordinates(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A text file with one point a line; the id is the line's place in the order of the file, empty lines left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # Lines that are left out leave no gap: they are counted after the filter.
    return _numbered(lines).select(F.col("n").alias("id"), _cells("value", separator).alias("x"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id and label (whole number), one a line."""
    return coordinates(spark, path, " ").select("id", F.element_at("x", 1).cast("int").alias("label"))


def matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A dense matrix as (i, j, v), 1-based."""
    return coordinates(spark, path, separator).select(F.col("id").alias("i"), F.posexplode("x").alias("j", "v")).select("i", (F.col("j") + 1).cast("long").alias("j"), "v")


def complex_matrix(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(i, j, re, im) of lines that hold a row's real parts and then its imaginary parts."""
    rows = coordinates(spark, path, separator)
    half = (F.size("x") / 2).cast("int")
    both = F.arrays_zip(F.slice("x", 1, half).alias("re"), F.slice("x", half + 1, half).alias("im"))
    return rows.select(F.col("id").alias("i"), F.posexplode(both).alias("j", "v")).select("i", (F.col("j") + 1).cast("long").alias("j"), "v.re", "v.im")


def complex_pairs(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(i, j, re, im) of lines "re im", row after row of n entries."""
    rows = coordinates(spark, path, " ")
    at = F.col("id") - 1
    return rows.select((F.floor(at / n) + 1).alias("i"), (at % n + 1).alias("j"), F.element_at("x", 1).alias("re"), F.element_at("x", 2).alias("im"))


def _binary(spark: SparkSession, path: str, take) -> DataFrame:
    def run(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                a = take(raw)
                for j in range(a.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(a) + 1)), pa.array(np.full(len(a), j + 1)), pa.array(np.ascontiguousarray(a[:, j]))], ["i", "j", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "i long, j long, v double")


def binary_matrix(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(i, j, v) of raw doubles, column after column. A file is read by one task (2 GB at most); several files are several matrices."""
    return _binary(spark, path, lambda raw: np.frombuffer(raw, "<f8").reshape(-1, rows).T)


def record_matrix(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(i, j, v) of doubles in records that a four-byte length stands before and after, column after column."""

    def take(raw: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(raw):
            (n,) = struct.unpack_from("<i", raw, at)
            out.append(np.frombuffer(raw, "<f8", n // 8, at + 4))
            at += n + 8
        return np.concatenate(out).reshape(-1, rows).T

    return _binary(spark, path, take)


def mesh(spark: SparkSession, nodes: str, elements: str) -> tuple[DataFrame, DataFrame]:
    """(id, x) and (id, corners): files with a count in the first line and then a number and its values a line."""

    def read(path: str) -> DataFrame:
        return coordinates(spark, path, " ").where(F.size("x") > 1).select(F.element_at("x", 1).cast("long").alias("id"), F.expr("slice(x, 2, size(x) - 1)").alias("x"))

    return read(nodes), read(elements).select("id", F.col("x").cast("array<long>").alias("corners"))


def centers(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(id, x): the middle of each element's corners."""
    each = elements.select("id", F.posexplode("corners").alias("place", "corner")).join(nodes.select(F.col("id").alias("corner"), "x"), "corner")
    axes = each.select("id", F.posexplode("x").alias("axis", "v")).groupBy("id", "axis").agg(F.avg("v").alias("v"))
    return axes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("axis", "v"))).alias("c")).select("id", F.col("c.v").alias("x"))


def save(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def save_text(df: DataFrame, path: str, separator: str = " ") -> None:
    """Rows as lines; arrays are spread."""
    each = [F.array_join(F.col(f.name).cast("array<string>"), separator) if f.dataType.typeName() == "array" else F.col(f.name).cast("string") for f in df.schema.fields]
    df.select(F.concat_ws(separator, *each).alias("value")).write.mode("overwrite").text(path)
