"""The corpus pipeline: five stages from raw documents to tokenized ones, each written as Parquet and read again.

All but the last stage return the columns of documents; each works on all rows that the one before kept. No stage
carries state over: a lost executor costs the tasks it ran. Columns beyond those of documents go along to the fourth stage.
Stages with Python workers bound the Arrow batches of the session (`small_batches`), as each holds whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm import bpe, langid, mixing, secrets, simhash
from voxfield.llm.common import drop, is_held_out, scratch, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those without a language for half of their letters."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.learn(docs, ~is_held_out("doc_id", 4, 2)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each class of documents whose five-word shingles overlap by 0.8 or more. Candidates are texts whose SimHash fingerprints
    differ in two bits at most, and those of an exact prefix filter, which adds what fingerprints miss; each is judged by its shingles."""
    small_batches(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts, and counts their characters again."""
    small_batches(spark)
    return secrets.redact_secrets(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to their sources' targets: a document appears as often as the mix takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text."""
    small_batches(spark)
    import public_tokenizers

    out = bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, verify=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL can express neither the language model nor the overlap of all pairs of texts; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with scratch() as keep:  # what a stage wrote on its way goes once its result is there, and so does the stage before
            out = keep(stage(spark, docs, sf_dir))
        drop(docs)
        docs = out
    return docs
