"""The corpus pipeline: five operators one after another, each on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. A driver writes each stage's rows and reads them again for the next; :func:`run`
does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, decontaminate, dedup, quality, secrets
from colloquy.llm.shared import cut, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays."""
    return dedup.drop_duplicates(docs, share=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows it."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit) and their number."""
    return bpe.encode(docs).select("doc_id", "lang", "source", "n_chars", F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", mask_secrets),
    ("bpe encoding", tokenize),
]

#: A fitted classifier and near-duplicate groups are beyond SQL; tests hold the stages against plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
