"""Derived fields for output. Each is struct(value, status, detail): a view never filters and says why it has no value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.functions.text import share_class
from lattica.functions.values import is_open_end, stored_day, years_bucket

# Fixed value: remaining years of bonds, half open, and the label of bonds past their day.
MATURITIES = [(None, 1.0, "1년미만"), (1.0, 3.0, "1-3년"), (3.0, 5.0, "3-5년"), (5.0, 10.0, "5-10년"), (10.0, None, "10년이상")]
MATURED = "만기경과"
NO_VALUE = "값 미확보"


def _field(value: Column, status: Column, detail: Column | None = None) -> Column:
    return F.struct(F.when(status == "available", value.cast("string")).alias("value"), status.alias("status"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def input_status(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """The first of: a column not selected, a null, an empty text; else available."""
    if any(c not in rows.columns for c in columns):
        return F.lit("not_selected")
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))
    empty = reduce(lambda a, b: a | b, [F.trim(F.col(c).cast("string")) == "" for c in columns], F.lit(False))
    return F.when(nulls, "null").when(empty, "empty").otherwise("available")


def unsupported(reason: str) -> Column:
    return _field(F.lit(None), F.lit("derivation_unavailable"), F.lit(reason))


def rating_order(scale: list[str]) -> Column:
    return _field(F.lit(" < ".join(scale)), F.lit("available"))


def raw_rating(rows: DataFrame, column: str) -> Column:
    return _field(F.col(column) if column in rows.columns else F.lit(None), input_status(rows, (column,)))


def rating(rows: DataFrame, column: str) -> Column:
    """A rating without the mark of its middle notch (AA0 is AA)."""
    value = F.regexp_replace(F.trim(F.col(column)), r"^([A-D]+)0$", "$1") if column in rows.columns else F.lit(None)
    return _field(value, input_status(rows, (column,)))


def rating_individual(rows: DataFrame, column: str, labels: DataFrame, name: str, axis: str = "CreditRating") -> DataFrame:
    """`rows` with the one individual of the rating scale that a stored rating names, as "label (uri)"; labels are (axis, label, uri).

    The label shown is the first of the individual's own; a rating that no individual or several have is unresolved.
    """
    own = labels.filter(F.col("axis") == axis)
    shown = own.groupBy("uri").agg(F.min("label").alias("_shown"))
    one = own.groupBy("label").agg(F.countDistinct("uri").alias("_n"), F.max("uri").alias("uri")).join(shown, "uri").select(F.col("label").alias("_label"), "_n", "uri", "_shown")
    found = rows.join(one, F.trim(F.col(column)) == F.col("_label"), "left") if column in rows.columns else rows.withColumns({c: F.lit(None) for c in ("_n", "uri", "_shown")})
    known = F.coalesce(F.col("_n") == 1, F.lit(False))
    status = input_status(rows, (column,))
    value = F.concat("_shown", F.lit(" ("), "uri", F.lit(")"))
    return found.withColumn(name, _field(F.when(known, value), F.when((status == "available") & ~known, "unresolved").otherwise(status))).drop("_label", "_n", "uri", "_shown")


def return_series(rows: DataFrame, columns: tuple[str, ...], periods: tuple[str, ...]) -> Column:
    """Periods with their values; a column that isn't there and a null differ."""
    parts = [F.concat(F.lit(f"{p}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL")) if c in rows.columns else F.lit("no column")) for c, p in zip(columns, periods, strict=True)]
    some = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns if c in rows.columns], F.lit(False))
    return _field(F.concat_ws(", ", *parts), F.when(some, "available").otherwise("null"))


def listing(start: Column, end: Column, basis: Column) -> Column:
    """Whether a product is listed on a day: from its start, until before its end; an open end never comes."""
    first, last, day = stored_day(start), stored_day(end), stored_day(basis)
    known = first.isNotNull() & day.isNotNull() & (last.isNotNull() | is_open_end(end))
    listed = (first <= day) & (F.coalesce(is_open_end(end), F.lit(False)) | (day < last))
    return _field(listed, F.when(known, "available").otherwise("null"))


def identity_keys(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE))) for c in columns if c in rows.columns]
    return _field(F.concat_ws(", ", *parts), F.lit("available" if parts else "not_selected"))


def maturity(due: Column, basis: Column) -> Column:
    days = F.datediff(stored_day(due), stored_day(basis))
    return _field(years_bucket(days, MATURITIES, MATURED), F.when(days.isNull(), "null").otherwise("available"))


def classification(rows: DataFrame, labels: DataFrame, axes: tuple[tuple[str, str], ...], key: str, name: str) -> DataFrame:
    """`rows` with a view of what individual each source value is on each axis; `labels` are (axis, label, uri)."""
    kept = [(c, a) for c, a in axes if c in rows.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(c).alias("column"), F.col(c).alias("value")) for c, a in kept]))
    long = rows.select(key, pairs.alias("x")).select(key, "x.axis", "x.column", "x.value")
    one = labels.groupBy("axis", "label").agg(F.countDistinct("uri").alias("_n"), F.max("uri").alias("uri"))
    found = long.join(one, (long["axis"] == one["axis"]) & (long["value"] == one["label"]), "left").select(long[key], long["axis"], "value", F.when(F.col("_n") == 1, F.col("uri")).otherwise("unresolved").alias("uri"))
    text = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("axis", F.concat_ws("=", "axis", "uri").alias("t")))), lambda x: x["t"]))
    every = F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)) == 0
    views = found.groupBy(key).agg(text.alias("_t"), every.alias("_all"))
    return rows.join(views, key, "left").withColumn(name, _field(F.col("_t"), F.when(F.col("_all"), "available").otherwise("null"))).drop("_t", "_all")


def share_class_view(rows: DataFrame, column: str) -> Column:
    found = share_class(F.col(column))
    return _field(found, F.when(found.isNull(), "null").otherwise("available"))


def derive(rows: DataFrame, name: str, view, scale: list[str] | None = None, labels: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """`rows` with the output view `name` of a catalog."""
    i = view.inputs
    if view.kind == "classification":
        if labels is None or key is None:
            raise RequestError(f"{name}: an axis needs its labels")
        return classification(rows, labels, view.axes, key, name)
    if view.kind == "rating" and labels is not None:
        return rating_individual(rows, i[0], labels, name)
    column = {
        "unsupported": lambda: unsupported(view.reason),
        "rating_order": lambda: rating_order(scale or []),
        "raw_rating": lambda: raw_rating(rows, i[0]),
        "rating": lambda: rating(rows, i[0]),
        "return_series": lambda: return_series(rows, i, view.periods),
        "listing": lambda: listing(*map(F.col, i)),
        "identity_keys": lambda: identity_keys(rows, i),
        "maturity": lambda: maturity(*map(F.col, i)),
        "share_class": lambda: share_class_view(rows, i[0]),
    }.get(view.kind)
    if column is None:
        raise RequestError(f"{name}: an ambiguous or unknown view {view.kind!r}")
    return rows.withColumn(name, column())
