"""Mixing sources to target weights (native).

Words are summed per source, targets and repetition rates follow from the weights, and each document is taken
floor(rate) times plus once more with probability frac(rate), decided by a hash of its id.

Defined results: a null text has size 0; a null source is a source of its own and the last in order; rows that
repeat an id share its draw; an empty table gives an empty result; extra columns pass through `mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD, cut, own_columns, ranked, unused

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    All sizes are shared by weight; a target stops at cap times its source's size and the excess is shared anew by
    weight. That is a water level L with sum(min(cap * size, L * weight)) = total: with the sources in order of
    size / weight those at their cap come first, and the level is the one after the first source that isn't capped.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = ranked(per, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("row_index") % len(weights) + 1).cast("int"))
    weighed = order.select("source", "source_size", weight.cast("long").alias("weight"))
    by_fill = ranked(weighed.withColumn("_fill", F.col("source_size") / F.col("weight")), [F.col("_fill"), F.col("source").asc_nulls_last()], ("source_size", "weight"))
    by_fill = cut(by_fill)
    total, heavy = by_fill.agg(F.sum("source_size"), F.sum("weight")).first()
    level = 0.0
    if total:
        left, open_weight = total - cap * F.col("before_source_size"), heavy - F.col("before_weight")
        first = F.when(left * F.col("weight") <= cap * F.col("source_size") * open_weight, F.col("row_index"))
        level = by_fill.agg(F.min_by(left / open_weight, first)).first()[0]
    share = F.least((cap * F.col("source_size")).cast("double"), F.lit(float(level)) * F.col("weight"))
    return by_fill.select("source", "source_size", share.alias("target"))


def copies(doc_id: Column, source_size: Column, target: Column, cap: int = CAP, seed: str = SEED) -> Column:
    rate = F.least(F.coalesce(target / F.nullif(source_size, F.lit(0)), F.lit(0.0)), F.lit(float(cap)))
    return (F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken. Texts are read once."""
    sizes = cut(own_columns(docs, doc_id=doc_id, source=source, text=text).select("doc_id", "source", word_count(F.col("text")).alias("size")))
    goal = targets(sizes, weights, cap).withColumnRenamed("source", "_source")
    n = copies(F.col("doc_id"), F.col("source_size"), F.col("target"), cap, seed)
    return sizes.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", n.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of `docs`, each as often as it is taken, with the columns of `docs`."""
    slim = own_columns(docs, source=source, text=text).select("source", word_count(F.col("text")).alias("size"))
    m_source, m_size, m_target, m_n, m_k = unused(docs, "source", "size", "target", "n", "k")
    goal = targets(slim, weights, cap).select(F.col("source").alias(m_source), F.col("source_size").alias(m_size), F.col("target").alias(m_target))
    n = copies(F.col(f"`{doc_id}`"), F.col(m_size), F.col(m_target), cap, seed)
    joined = docs.join(goal, F.col(f"`{source}`").eqNullSafe(F.col(m_source)))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    counted = joined.select(*keep, n.cast("int").alias(m_n)).filter(F.col(m_n) > 0)
    return counted.select(*keep, F.explode(F.sequence(F.lit(1), F.col(m_n))).alias(m_k)).drop(m_k)
