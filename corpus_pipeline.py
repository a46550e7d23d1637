"""The corpus pipeline: every stage is written as Parquet and reread by the next.

Language identification drops what it rejects, exact and near deduplication keep one
document of each group, mixing draws the sources to their targets, and byte-level BPE
turns the mix into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtable.llm.bpe import encode_documents
from voxtable.llm.exact_dedup import drop_exact_duplicates
from voxtable.llm.language_id import keep_identified
from voxtable.llm.mixing import mix_documents
from voxtable.llm.near_dedup import drop_near_duplicates
from voxtable.plans.storage import READ_ROWS, ROW_GROUP, arrow_batches, staged


def _lean(spark: SparkSession) -> None:
    """Texts are long rows: readers and writers of the pipeline's session hold fewer of them at a time."""
    spark.conf.set(READ_ROWS, "512")
    spark.conf.set("parquet.block.size", str(ROW_GROUP))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, similarity of 0.8 or more."""
    _lean(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    _lean(spark)
    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    with arrow_batches(spark):
        return staged(encoded, "pipeline-tokens")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("byte_bpe", tokens)]

#: No SQL has the seeded draws of the mix or the token ranks; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
