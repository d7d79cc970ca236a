"""A corpus from documents to packed sequences, in five stages; each works on all that the one before it kept.

toxicity  drops the documents whose score is 0.5 or more
minhash   keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)
secrets   replaces secrets in the texts by a mark; no document is dropped
mixing    repeats and drops documents so that sources come near their target weights
packing   cuts and packs the token ids into sequences

Each stage's result is written as Parquet and read again as the next one's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearloom.llm import minhash, mixing, packing, secrets, toxicity
from yearloom.llm.common import table, unused
from yearloom.scale.written import materialise

#: SQL has no tokenizer, trained model or HyperMinHash, so the stages are tested against brute force instead.
ORACLE_SQL = None


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the grammar, weighed on the labelled ones, scores 0.5 or more; null texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*docs.columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the least doc_id, whatever ids other groups have.

    Texts without words and null texts stay as they are; of rows alike in doc_id and text one stays.
    """
    return minhash.one_per_component(docs, materialise(minhash.near_duplicates(docs), "stage-groups"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text.

    Whole texts are searched, however long; every row stays, repeated rows and
    null texts too, with its other columns.
    """
    clean = secrets.redact(secrets.find_secrets(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Documents without words, null texts too, add nothing to a mix and go; of
    rows alike in doc_id and text as many are taken as the mix asks for.
    """
    mixed = mixing.mix(docs)
    copies = F.explode(F.sequence(F.lit(1), "passes"))
    return mixed.filter("passes > 0").select(*docs.columns, copies.alias(unused(mixed, "copy")[0])).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole texts are packed, in pieces if they are long; null texts are empty,
    repeated rows are packed as often as they come.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("minhash", minhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows.  An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
