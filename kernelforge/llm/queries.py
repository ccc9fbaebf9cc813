"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelforge.llm import ann, chat, decontaminate, langid, licenses, lm, mixing, neardup, pii, substrings


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(n: int, key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), crc_mod(7) != 2)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key", F.length("text").alias("n_text"))


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        ((c["n_hit"] > 0) & (20 * c["n_hit"] >= c["n_words"])).alias("contaminated"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod(5) != 0)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "language.lang_pred", "language.score", "language.margin")


QUERIES = {f.__name__: f for f in (op2_lm_scoring, op3_mix_sources, op4_minhash_neardup, op6_decontamination, op7_language_id)}


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove(read(spark, sf_dir, "documents"))
    size = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op10_suffix_dedup"] = op10_suffix_dedup


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


QUERIES |= {f.__name__: f for f in (op1_ann_search, op5_pii_spans)}


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


REPLY = {"reply": {"properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0, "maximum": 5}}, "required": ["text", "turn"]}}


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls: each user turn calls ``reply`` under an identifier of its own, which waits for the call two turns before
    if there is one, and which the next assistant turn answers. Long texts and late turns break the tool's schema."""
    rows = read(spark, sf_dir, "conversations")
    ident = lambda back: F.format_string("%d-%d", "conv_id", F.col("turn") - back)
    waits = F.when(F.col("turn") >= 2, F.array(ident(2)))
    call = F.array(F.struct(ident(0).alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), waits.alias("depends_on")))
    rows = rows.withColumn("calls", F.when(F.col("role") == "user", call)).withColumn("result_for", F.when((F.col("role") == "assistant") & (F.col("turn") > 0), ident(1)))
    return chat.link(rows, REPLY).withColumn("problems", F.array_join("problems", " | "))


QUERIES |= {f.__name__: f for f in (op8_license_scan, op9_chat_format)}
