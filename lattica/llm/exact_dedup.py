"""Exact deduplication by content sort (native).

Normalised texts are range-partitioned by sampled splitters, sorted externally, and each text is compared in full with
its neighbour: adjacent equals form a run, whose best row stays. Splitters are pairs (first characters, hash of the
row), so that many copies of one text spread over several ranges; only texts whose first characters are those of a
splitter can lie in two ranges, and only their runs, one row a range, are merged afterwards.

Defined results: a null text counts as empty, and all empty texts are equal; a null id comes after all others; rows
that repeat id and text belong to one group, in which exactly one row is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import cut, joined_rows, one_each, own_columns, shuffle_partitions, text_key, without_white

#: Characters of a text that splitters hold.
PREFIX = 48
#: Sampled rows for each range, and the most ranges (so the driver holds at most RANGES * SAMPLES short strings).
SAMPLES = 16
RANGES = 16384


def _splitters(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Bounds of `ranges` ranges, from a uniform sample (the rows with the least hashes) of (prefix, salt)."""
    sample = keys.orderBy(F.xxhash64("salt", F.lit(1)), "salt", "prefix").limit(ranges * SAMPLES).collect()
    keys = sorted((r.prefix.encode(), r.salt) for r in sample)
    bounds = {keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else set()
    return [(prefix.decode(), salt) for prefix, salt in sorted(bounds)]


def _sorted_bounds(bounds: list[tuple[str, int]]) -> Column:
    """The bounds as one constant array."""
    return F.from_json(F.lit(json.dumps([{"p": p, "s": s} for p, s in bounds])), "array<struct<p:string,s:bigint>>")


def _range_of(prefix: Column, salt: Column, bounds: list[tuple[str, int]]) -> Column:
    """How many of the sorted bounds lie below (prefix, salt), by binary search."""
    if not bounds:
        return F.lit(0)
    array, key = _sorted_bounds(bounds), F.struct(prefix.alias("p"), salt.alias("s"))

    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        open_, below = at["lo"] < at["hi"], F.get(array, mid) < key
        return F.struct(F.when(open_ & below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(at["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step)["lo"]


def _cut_through(prefix: Column, range_: Column, bounds: list[tuple[str, int]]) -> Column:
    """Whether a bound has this prefix; if one has, then one of the two next to the row."""
    if not bounds:
        return F.lit(False)
    array = _sorted_bounds(bounds)
    return F.coalesce(F.get(array, range_)["p"] == prefix, F.lit(False)) | F.coalesce(F.get(array, range_ - 1)["p"] == prefix, F.lit(False))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_key (of the text, a null one as empty).

    Of equal texts the one with the most code points before normalisation stays, then the smallest id.
    """
    spark = docs.sparkSession
    n = min(ranges or shuffle_partitions(spark), RANGES)
    base = own_columns(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("salt"))
    head = F.substring(without_white(F.substring("text", 1, 3 * PREFIX)), 1, PREFIX)
    bounds = _splitters(base.select(head.alias("prefix"), "salt"), n)
    keyed = base.select("doc_id", "salt", text_key(F.col("text")).alias("text_key"), F.char_length("text").alias("len"), without_white(F.col("text")).alias("norm")).withColumn("prefix", F.substring("norm", 1, PREFIX))
    ranged = keyed.withColumn("range", _range_of(F.col("prefix"), F.col("salt"), bounds).cast("int")).drop("salt")
    sorted_ = ranged.repartitionById(n, F.col("range"))
    best = [F.col("len").desc(), F.col("doc_id").asc_nulls_last()]
    run = Window.partitionBy("range", "norm").orderBy(*best)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = cut(
        sorted_.select(
            "doc_id", "text_key", "len", F.row_number().over(run).alias("place"), F.first("len").over(whole).alias("run_len"), F.first("doc_id").over(whole).alias("run_id"),
            F.count("*").over(whole).alias("run_size"), "range", _cut_through(F.col("prefix"), F.col("range"), bounds).alias("shared"), F.col("norm"),
        ).select("doc_id", "text_key", "place", "run_len", "run_id", "run_size", "range", "shared", F.sha2("norm", 256).alias("text_sha256"))
    )
    alone = runs.filter(~F.col("shared")).select("doc_id", F.col("run_id").alias("keep_id"), F.col("run_size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256", "text_key")
    parts = runs.filter(F.col("shared") & (F.col("place") == 1))
    rank = F.struct((-F.col("run_len")).alias("l"), F.col("run_id").isNull().alias("n"), F.col("run_id").alias("i"), F.col("range").alias("r"))
    merged = cut(parts.groupBy("text_sha256").agg(F.min(rank).alias("best"), F.sum("run_size").alias("group_size")))  # so that the join's hot side can be split
    joined = runs.filter("shared").select("doc_id", "text_key", "place", "range", "text_sha256").join(merged, "text_sha256")
    split = joined.select("doc_id", F.col("best.i").alias("keep_id"), "group_size", ((F.col("place") == 1) & (F.col("range") == F.col("best.r"))).alias("kept"), "text_sha256", "text_key")
    return alone.unionByName(split)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts."""
    kept = exact_groups(docs, doc_id, text, ranges).filter("kept")
    return one_each(joined_rows(docs, kept, "left_semi", doc_id, text), doc_id, text)
