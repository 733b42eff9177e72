"""Folds and bounded samples of labelled documents, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import own_columns


def fold(doc_id: Column, folds: int, held: int) -> Column:
    """True for held-out ids: crc32 of the id as text, modulo `folds`, is `held`. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row an id; null ids, null labels and ids with contradicting labels are left out."""
    known = own_columns(labels, doc_id="doc_id", label=label).filter("doc_id is not null and label is not null")
    return known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")


def sampled(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` ids, those with the least seeded hashes."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
