"""Joins that a product engine needs beyond plain equality: enrichment by metric, identity across tables, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import ends_in_class, provenance_key

#: Fixed value: keys that only hold zeros, perhaps behind a country code, stand for none.
NO_KEY = r"^(?:KR)?0+$"


def metric_table(links: DataFrame, metrics: DataFrame, code: str, key: str, column: str, link_key: str = "product_id") -> DataFrame:
    """(key, column) from tall metrics (product_id, metric_code, value, is_available): the value of `code` where available.

    Two hops become one table to enrich with, filtered to one metric before the join.
    """
    own = metrics.filter(F.col("metric_code") == code).select(link_key, F.when(F.col("is_available"), F.col("value")).alias(column))
    return links.select(link_key, key).join(own, link_key).select(key, column)


def metric_columns(metrics: DataFrame, codes: list[str], entity: str = "product_id") -> DataFrame:
    """One row an entity, one column a metric code, by a pivot over known codes (one shuffle)."""
    value = F.when(F.col("is_available"), F.col("value"))
    return metrics.filter(F.col("metric_code").isin(codes)).groupBy(entity).agg(*[F.max(F.when(F.col("metric_code") == c, value)).alias(c) for c in codes])


def keyed(left: DataFrame, right: DataFrame, equal: list[str], null_safe: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which nulls of the `null_safe` keys meet; still hashed, not a loop."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in (*equal, *null_safe) else F.col(c) for c in right.columns])
    on = [F.col(c) == F.col(f"_r_{c}") for c in equal] + [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in null_safe]
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in (*equal, *null_safe)])


def nested_sets(rows: DataFrame, bridge: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """`rows` with a sorted array of the distinct bridge values of each key; never null. Only keys of `rows` are aggregated."""
    sets = bridge.join(rows.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))
    return rows.join(sets, key, "left").withColumn(name, F.coalesce(name, F.array().cast(sets.schema[name].dataType)))


def unique_hydration(ranked: DataFrame, details: DataFrame, keys: list[str]) -> DataFrame:
    """`ranked` with the details of each key that has exactly one row; null details otherwise.

    Details are reduced to the ranked keys first, so late materialisation reads them for few rows only.
    """
    columns = [c for c in details.columns if c not in keys]
    few = details.join(ranked.select(*keys), keys, "left_semi")  # adaptive execution broadcasts the keys if they are few
    one = few.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max(F.struct(F.lit(0).alias("_"), F.col(c).alias("v"))).alias(c) for c in columns])
    picked = one.select(*keys, *[F.when(F.col("_n") == 1, F.col(f"{c}.v")).alias(c) for c in columns])
    return ranked.join(picked, keys, "left")


def unique_label(values: DataFrame, value: str, labels: DataFrame, label: str, uri: str) -> DataFrame:
    """`values` with the one individual that carries a value as a label; null where none or several do."""
    one = labels.groupBy(F.col(label).alias("_label")).agg(F.countDistinct(uri).alias("_n"), F.max(uri).alias("_uri"))
    return values.join(one, F.col(value) == F.col("_label"), "left").withColumn(uri, F.when(F.col("_n") == 1, F.col("_uri"))).drop("_label", "_n", "_uri")


def identity_probe(domains: dict[str, tuple[DataFrame, str, str]], names: list[str], most: int = 2) -> DataFrame:
    """(wanted, domain, code, name): up to `most` products of each domain that a name equals; two say it is ambiguous."""
    wanted = F.array(*[F.struct(F.lit(n).alias("wanted"), F.lit(n.replace(" ", "").lower()).alias("key")) for n in names])
    parts = []
    for domain, (table, code, title) in domains.items():
        own = table.select(F.lit(domain).alias("domain"), F.col(code).cast("string").alias("code"), F.col(title).alias("name"))
        own = own.withColumn("_w", F.explode(F.filter(wanted, lambda w: w["key"] == F.lower(F.replace("name", F.lit(" "), F.lit("")))))).select("_w.wanted", "domain", "code", "name")
        parts.append(own)
    found = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("wanted", "domain").orderBy("code"))
    return found.withColumn("_n", place).filter(F.col("_n") <= most).drop("_n")


def valid_key(c: Column) -> Column:
    c = F.trim(c)
    return F.coalesce((c != "") & ~c.rlike(NO_KEY), F.lit(False))


def cross_market(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of two markets that are one product: equal trimmed keys, none empty. Names prove nothing."""
    own = left.withColumn("_key", F.trim(F.col(left_key))).filter(valid_key(F.col("_key")))
    other = right.withColumn("_other", F.trim(F.col(right_key)))
    return own.join(other, F.col("_key") == F.col("_other")).drop("_other").withColumnRenamed("_key", "matched_key")


def same_fund(funds: DataFrame, title: str, classes: list[str], keys: list[str]) -> DataFrame:
    """One row: `status` and the keys, for named share classes of a fund.

    Each class must be one row; all keys must be valid; then equal keys are one parent fund.
    """
    tagged = [F.when(ends_in_class(F.col(title), c), F.lit(c)) for c in classes]
    rows = funds.withColumn("_class", F.explode(F.filter(F.array(*tagged), lambda x: x.isNotNull())))
    bad = F.when(reduce(lambda a, b: a & b, [valid_key(F.col(k).cast("string")) for k in keys]), 0).otherwise(1)
    counted = rows.groupBy().agg(F.count("*").alias("rows"), F.countDistinct("_class").alias("classes"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.countDistinct(F.concat_ws("\1", *keys)).alias("distinct"), *[F.min(k).alias(k) for k in keys])
    status = F.when((F.col("rows") != len(classes)) | (F.col("classes") != len(classes)), "not_unique").when(F.col("bad") > 0, "key_missing").when(F.col("distinct") == 1, "same").otherwise("different")
    return counted.select(status.alias("status"), *[F.when(status == "same", F.col(k)).alias(k) for k in keys])


def provenance(rows: DataFrame, key: str, columns: list[str], documents: DataFrame, shortest_ticker: int = 3, gram: int = 2) -> DataFrame:
    """`rows` with the document that vouches for each: a value equals its ticker, else its ISIN, else name and value
    contain one another, longest name first.

    Distinct values are matched, then joined back. Containment is a join on blocks: whichever text is the shorter one, all
    its `gram`-character pieces are in the longer, so also the piece that fewest documents' names have; candidates that
    share it are verified.
    """
    long = rows.select(key, F.explode(F.array(*[F.trim(F.col(c).cast("string")) for c in columns])).alias("_v")).filter(F.length("_v") > 0)
    values = long.select("_v").distinct()
    docs = documents.select("document", F.upper(F.trim("ticker")).alias("_t"), F.upper(F.trim("isin")).alias("_i"), provenance_key(F.col("name")).alias("_n"))
    upper = values.withColumn("_u", F.upper("_v")).withColumn("_k", provenance_key(F.col("_v")))
    ticker = upper.filter(F.length("_v") >= shortest_ticker).join(docs, F.col("_u") == F.col("_t")).select("_v", F.lit(1).alias("_p"), F.lit(0).alias("_l"), "document")
    isin = upper.join(docs, F.col("_u") == F.col("_i")).select("_v", F.lit(2).alias("_p"), F.lit(0).alias("_l"), "document")
    found = _containing(upper.filter((F.length("_v") >= 4) & (F.length("_k") > 0)).select("_v", "_k"), docs.filter(F.length("_n") > 0).select("document", "_n"), gram)
    name = found.select("_v", F.lit(3).alias("_p"), (-F.length("_n")).alias("_l"), "document")
    best = ticker.union(isin).union(name).groupBy("_v").agg(F.min(F.struct("_p", "_l", "document")).alias("_b"))
    by_key = long.join(best, "_v").groupBy(key).agg(F.min("_b").alias("_b"))
    return rows.join(by_key.select(key, F.col("_b.document").alias("document"), F.element_at(F.array(F.lit("ticker"), F.lit("isin"), F.lit("name")), F.col("_b._p")).alias("matched_by")), key, "left")


def _containing(values: DataFrame, docs: DataFrame, gram: int) -> DataFrame:
    """(_v, document, _n) where the key _k of a value contains the name _n of a document or is contained in it."""
    pieces = lambda c: F.when(F.length(c) >= gram, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - gram + 1), lambda i: F.substr(c, i, F.lit(gram))))).otherwise(F.array(c))
    short = F.length("_n") < gram
    every = docs.select("document", "_n", F.explode(pieces(F.col("_n"))).alias("_g"))
    common = every.groupBy("_g").agg(F.count("*").alias("_c"))
    rare = every.join(common, "_g").groupBy("document", "_n").agg(F.min(F.struct("_c", "_g")).alias("_r")).select("document", "_n", F.col("_r._g").alias("_g"))
    asked = values.select("_v", "_k", F.explode(pieces(F.col("_k"))).alias("_g"))
    within = asked.join(rare.filter(~short), "_g").filter(F.col("_k").contains(F.col("_n")))
    letters = values.select("_v", "_k", F.explode(F.array_distinct(F.split("_k", ""))).alias("_g")).join(rare.filter(short), "_g").filter(F.col("_k").contains(F.col("_n")))
    least = asked.join(common, "_g", "left").groupBy("_v", "_k").agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("_c"), "_g")).alias("_r")).filter("_r._c > 0").select("_v", "_k", F.col("_r._g").alias("_g"))
    around = least.join(every, "_g").filter(F.col("_n").contains(F.col("_k")))
    tiny = values.filter(F.length("_k") < gram).select("_v", "_k", F.col("_k").alias("_g")).join(docs.select("document", "_n", F.explode(F.array_distinct(F.split("_n", ""))).alias("_g")), "_g").filter(F.col("_n").contains(F.col("_k")))
    columns = ["_v", "document", "_n"]
    return within.select(*columns).union(letters.select(*columns)).union(around.select(*columns)).union(tiny.select(*columns)).distinct()
