"""A training-corpus pipeline over ``documents``; part of the llm subpackage.

Each stage reads what its predecessor kept and returns the columns of documents;
the last adds copy and shuffle_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelforge.llm import decontaminate, langid, mixing, neardup, pii
from kernelforge.llm.shared import join_small, table

#: Similarity of near copies, in hundredths (op4 has one of its own).
NEAR = 80
#: No SQL states naive Bayes or MD5-seeded Poisson draws in full; a test holds run(), from what the
#: language stage keeps on, against plain code; that stage itself is held to held-out accuracy (op7).
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays doubtful (posterior under 0.5), go."""
    model = langid.fit(docs)
    found = langid.predict(docs, model, into="__language")
    return found.where("__language.lang_pred <> 'und' and __language.score >= 0.5").drop("__language")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays; of rows that repeat an id, the least.

    Rows without an id take part one by one, as if their ids came after all others: copies of them go too.
    """
    names, last = docs.columns, docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    unnamed = docs.where("doc_id is null").withColumn("__key", F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
    docs = docs.where("doc_id is not null").withColumn("__key", F.col("doc_id").cast("long")).unionByName(table(unnamed, "unnamed"))
    gone = table(neardup.near_duplicates(docs, key="__key", threshold=NEAR).where("not kept").select(F.col("__key").alias("__id")).distinct(), "duplicates")
    repeated = table(docs.groupBy(F.col("__key").alias("__id")).count().where("count > 1").select("__id"), "repeated-ids")
    left = join_small(docs, gone, docs["__key"] == gone["__id"], "left_anti")
    if not repeated.limit(1).count():
        return left.select(*names)
    single = join_small(left, repeated, left["__key"] == repeated["__id"], "left_anti")
    several = join_small(left, repeated, left["__key"] == repeated["__id"], "left_semi")
    # A least row is combined within tasks, so an id of very many rows is no load for one of them.
    one = several.groupBy("__key").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return single.select(*names).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    found = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="__hits")
    return found.where("not (__hits.n_hit > 0 and 20 * __hits.n_hit >= __hits.n_words)").drop("__hits")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    names = docs.columns
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to tempered target weights and shuffled."""
    return mixing.mix(docs)


STAGES = [("language", language_stage), ("neardup", neardup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("mixing", mixing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"stage-{name}")
    return docs
