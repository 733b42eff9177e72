"""Moving results between steps: ranked unions, handoffs as semi joins, merging, previews, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.errors import RequestError, Truncated
from lattica.operators.joins import unique_hydration


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; a column that parts lack is null there, one whose types differ between parts becomes text."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    parts = [p.withColumns({n: F.col(f"`{n}`").cast("string") for n in p.columns if n in mixed}) if mixed & set(p.columns) else p for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_rank(parts: list[DataFrame], order: str, limit: int) -> DataFrame:
    """The best rows of a union of (code, name, domain, sort_value): no part is cut before the union is ranked.

    Ties go by domain and code; rows without a value never rank.
    """
    if order not in ("asc", "desc"):
        raise RequestError(f"sorting is asc or desc, not {order!r}")
    every = union_all(parts).filter("sort_value is not null")
    value = F.col("sort_value").desc_nulls_last() if order == "desc" else F.col("sort_value").asc_nulls_last()
    return every.orderBy(value, "domain", "code").limit(limit)


def merge_rank_hydrate(parts: list[DataFrame], order: str, limit: int, details: DataFrame) -> DataFrame:
    """`merge_rank`, then details by (domain, code) for the rows that are left."""
    return unique_hydration(merge_rank(parts, order, limit), details, ["domain", "code"])


def capped(rows: DataFrame, most: int) -> DataFrame:
    """`rows` if there are no more than `most`; an error instead of a silent cut. Computed once: what was counted, most + 1
    rows at most, is kept and returned."""
    found = rows.limit(most + 1).cache()
    if found.count() > most:
        found.unpersist()
        raise Truncated(f"over {most} rows")
    return found


def truncated(rows: DataFrame, limit: int) -> bool:
    """Whether a result has reached its limit, so that more may exist."""
    return rows.limit(limit).count() >= limit


def handoff(rows: DataFrame, on: Column | str, groups: list[list[DataFrame]], key: str = "code") -> DataFrame:
    """`rows` whose key is in every group of key lists; within a group any list will do.

    Each group is one left semi join, so lists may be of any length.
    """
    value = F.col(on) if isinstance(on, str) else on
    out = rows.withColumn("_handoff", value)
    for lists in groups:
        keys = reduce(DataFrame.union, [x.select(F.col(key).alias("_key")) for x in lists]).filter("_key is not null")
        out = out.join(keys, F.col("_handoff") == F.col("_key"), "left_semi")
    return out.drop("_handoff")


def handoff_status(lists: list[DataFrame], any_group: bool, ranked: bool, limit: int | None) -> str:
    """ok, blocked_empty or blocked_truncated: whether a step may go on from upstream key lists.

    An empty list blocks unless another one of its group has keys; a cut list can't be ranked.
    """
    empty = [x.limit(1).count() == 0 for x in lists]
    if all(empty) if any_group else any(empty):
        return "blocked_empty"
    if ranked and limit and any(truncated(x, limit) for x in lists):
        return "blocked_truncated"
    return "ok"


def intersection(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first part whose key is in all others."""
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), parts[1:], parts[0])


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).filter("_n = 1").drop("_n")


def max_score(rows: DataFrame, key: str, score: str) -> DataFrame:
    """One row a key with its largest score (aggregated before the shuffle; ties by the whole row)."""
    others = [c for c in rows.columns if c not in (key, score)]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(score), *others)).alias("_b"))
    return best.select(*[F.col(key) if c == key else F.col(f"_b.{c}").alias(c) for c in rows.columns])


def tagged(rows: DataFrame, domain: str, step: str) -> DataFrame:
    return rows.withColumns({"_domain": F.lit(domain), "_step_id": F.lit(step)})


def public(rows: DataFrame) -> DataFrame:
    """Without the columns that are the engine's own."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def fair_preview(rows: DataFrame, domain: str, order: list[Column], budget: int = 20) -> DataFrame:
    """Up to `budget` rows, an even share of each domain first, what is left over filled in domain order.

    A window keeps `budget` rows a domain (a bounded top, computed before the shuffle's merge); only those meet, and the
    shares follow from them in the same plan.
    """
    place = F.row_number().over(Window.partitionBy(domain).orderBy(*order))
    top = rows.withColumn("_n", place).filter(F.col("_n") <= budget)
    every = Window.partitionBy()  # at most budget rows of each domain are left
    n = F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(every)
    share = F.greatest(F.floor(F.lit(budget) / n), F.lit(1))
    late = F.col("_n") > F.col("_share")
    whole = Window.orderBy(late, F.col(domain), F.col("_n"))
    placed = top.withColumn("_share", share).withColumn("_domains", n).withColumn("_place", F.row_number().over(whole))
    most = F.greatest(F.lit(budget), F.when(F.col("_share") == 1, F.col("_domains")).otherwise(0))
    return placed.filter(F.col("_place") <= most).drop("_n", "_place", "_share", "_domains")


def fold_entities(rows: DataFrame, uri: str, names: str, codes: str) -> DataFrame:
    """One row an entity: its names and codes as sorted sets and one name to show."""
    return rows.groupBy(uri).agg(F.array_sort(F.collect_set(names)).alias("names"), F.array_sort(F.collect_set(codes)).alias("codes"), F.max(names).alias("name"))
