"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none (local tests) a folder of this machine is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="lattica-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lattica-{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder: lost executors cost no recomputation of what is above."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def without_white(text: Column) -> Column:
    """`text` less its white space; byte searches, no regular expression."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, **of: str) -> DataFrame:
    """Just the columns that an operator reads, under the operator's own names.

    Extra columns, whatever their names, can't clash with an operator's own after this.
    """
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in of.items()])


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names made of `stems` that no column of `df` has, whatever its case."""
    taken = "".join(sorted({c.lower() for c in df.columns}))
    mark = "_"
    while any(f"{mark}{s}" in taken for s in stems):
        mark += "_"
    return [f"{mark}{s}" for s in stems]


def ranked(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `row_index` (0-based place in the total order) and `before_<c>`: the sum of c over all earlier rows.

    Rows are range-partitioned and numbered inside their partition; only one row a partition (count and sums)
    meets in one task, so the input may have any number of rows. Partition numbers are fixed by a checkpoint.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    nil = lambda c: F.coalesce(c, F.lit(0))
    local = placed.select("*", (F.row_number().over(inside) - 1).alias("_at"), *[nil(F.sum(c).over(upto)).alias(f"_s_{c}") for c in sums])
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[nil(F.sum(c)).alias(f"_t_{c}") for c in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = parts.select("_part", nil(F.sum("_n").over(earlier)).alias("_o"), *[nil(F.sum(f"_t_{c}").over(earlier)).alias(f"_o_{c}") for c in sums])
    out = local.join(offsets, "_part")
    return out.select(*df.columns, (F.col("_o") + F.col("_at")).alias("row_index"), *[(F.col(f"_o_{c}") + F.col(f"_s_{c}")).alias(f"before_{c}") for c in sums])


def text_key(text: Column) -> Column:
    """With the id, what tells a document's row from others; equal rows share it, and a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1))


def joined_rows(docs: DataFrame, decisions: DataFrame, how: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` joined (left_semi or left_anti) with decisions (doc_id, text_key) on id and text, null ids included."""
    k_id, k_text = unused(docs, "id", "text")
    keyed = decisions.select(F.col("doc_id").alias(k_id), F.col("text_key").alias(k_text))
    return docs.join(keyed, F.col(f"`{doc_id}`").eqNullSafe(F.col(k_id)) & (text_key(F.col(f"`{text}`")) == F.col(k_text)), how)


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of those that repeat id and text. It follows a join on both, whose partitioning it shares."""
    (nth,) = unused(docs, "nth")
    same = Window.partitionBy(F.col(f"`{doc_id}`"), text_key(F.col(f"`{text}`"))).orderBy(F.lit(0))
    return docs.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).drop(nth)
