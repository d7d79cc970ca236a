"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.llm import audit, bpe, chat, fingerprint, minhash, mixing, negatives, packing, secrets, tokens, toxicity, vectors, warc
from yearloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    # One more conversation whose texts look like another template's marks.
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digest(chat.format_chats(rows.unionByName(probe)))


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_chat, op3_merkle, op4_warc, op5_secrets, op6_vectors, op7_mixing, op8_token_planes, op9_minhash,
        op10_best_fit, op11_audit, op12_byte_bpe, op13_negatives,
    )
    return {f.__name__: f for f in every}
