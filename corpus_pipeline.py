"""A corpus from raw documents: quality rules, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
`documents`; the last returns the tokens. Null and empty texts fail the quality rules; an empty table passes through
every stage; extra columns of `documents` stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import exact_dedup, mixing, pieces, quality_rules, simhash
from lattica.llm.common import fresh_path, remove_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their lines above the limits."""
    return quality_rules.kept_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, cut by seeded merge dropout."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokens),
]

#: Two stages (fingerprints of seeded 64-bit hashes, merge dropout) have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again, the one before removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
