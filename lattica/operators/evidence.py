"""Field-level evidence: a value, null, empty, zero that means missing, restricted, invalid and never queried all differ."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import squeezed, public_label
from lattica.functions.values import guarded_number

# What a column's rule on zeros says.
RESTRICTED, ZERO_MISSING = "사용 금지", ("값 없음", "is_available=false")


def field_status(c: Column, kind: str, rule: str = "") -> Column:
    """available, null, empty, invalid (NaN or infinite), restricted or zero_unavailable."""
    text = c.cast("string")
    out = F.when(c.isNull(), "null")
    if kind == "string":
        out = out.when(F.trim(text) == "", "empty")
    if kind in ("double", "float"):
        out = out.when(F.isnan(c) | (F.abs(c) == float("inf")), "invalid")
    if RESTRICTED in rule:
        return out.otherwise("restricted")
    if kind != "boolean" and "0" in rule and any(x in rule for x in ZERO_MISSING):
        out = out.when(guarded_number(c) == 0, "zero_unavailable")
    return out.otherwise("available")


def contract(rows: DataFrame, key: str, fields: list[dict]) -> DataFrame:
    """(key, field, value, status, column, unit): one row for each row and requested field.

    A field is {field, column (one in `rows`, or None), rule, unit}, or {field, view} for an output view; a field of two columns or none is unmapped, one
    whose column isn't in `rows` not_selected. Equal fields but for white space and case are asked once.
    """
    kinds, seen, items = dict(rows.dtypes), set(), []
    for f in fields:
        label = "".join(f["field"].split()).casefold()
        if label in seen:
            continue
        seen.add(label)
        column = f.get("column")
        if view := f.get("view"):  # a derived field carries its own status
            value, status = F.col(f"`{view}`.value"), F.col(f"`{view}`.status")
        elif column is None or isinstance(column, (list, tuple)):
            value, status, column = F.lit(None), F.lit("unmapped"), None
        elif column not in kinds:
            value, status = F.lit(None), F.lit("not_selected")
        else:
            own = F.col(f"`{column}`")
            status = field_status(own, kinds[column], f.get("rule", ""))
            value = F.when(status != "invalid", own.cast("string"))
        items.append(F.struct(F.lit(f["field"]).alias("field"), value.cast("string").alias("value"), status.alias("status"), F.lit(column).cast("string").alias("column"), F.lit(f.get("unit", "")).alias("unit")))
    return rows.select(key, F.explode(F.array(*items)).alias("x")).select(key, "x.*")


def status_histogram(long: DataFrame) -> DataFrame:
    return long.groupBy("status").agg(F.count("*").alias("n"))


def evidence_gate(rows: DataFrame, core: list[str]) -> DataFrame:
    """One row (status, rows, missing): ok only if every row has all of `core` (when, and from where); one gap voids all."""
    gap = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in core]) if core else F.lit(True)
    counted = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(gap, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("missing"))
    return counted.select(F.when(F.col("rows") == 0, "empty").when(F.col("missing") > 0, "abstain_evidence_missing").otherwise("ok").alias("status"), "rows", "missing")


def with_graph_evidence(rows: DataFrame, code: str, edges: DataFrame, edge_code: str, fields: list[str], name: str = "evidence") -> DataFrame:
    """`rows` with the list of edge properties (weights, days) that belong to each product."""
    lists = edges.groupBy(F.col(edge_code).alias("_code")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return rows.join(lists, F.col(code) == F.col("_code"), "left").drop("_code")


def counters(rows: DataFrame, limit: int, shown: int) -> dict:
    """How many rows a step has, how many of them are shown, and whether its limit may have cut it."""
    n = rows.limit(limit).count()
    return {"retrieved_rows": n, "displayed_rows": min(n, shown), "coverage_truncated": n >= limit}


def shown_value(c: Column, kind: str) -> Column:
    """A value as text for display: booleans as words, structures as JSON, line ends escaped."""
    if kind == "boolean":
        return F.when(c, "true").otherwise("false")
    if kind.startswith(("struct", "array", "map")):
        return F.to_json(c)
    return F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def rendered(long: DataFrame, key: str) -> DataFrame:
    """(key, text): the contract's fields of each row as lines "label: value" or "label: (status)"."""
    line = F.concat(public_label(F.col("field")), F.lit(": "), F.when(F.col("status") == "available", F.concat_ws(" ", F.col("value"), F.nullif(F.col("unit"), F.lit("")))).otherwise(F.concat(F.lit("("), F.col("status"), F.lit(")"))))
    lines = F.array_sort(F.collect_list(F.struct(squeezed(F.col("field")).alias("k"), line.alias("l"))))
    return long.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


def line(rows: DataFrame, row) -> str:
    """One shown row as "column: value" parts; nulls are left out."""
    return " · ".join(f"{c}: {row[c]}" for c in rows.columns if row[c] is not None)


def context(steps: list[dict]) -> str:
    """What was retrieved, a line a step: dataset, day, number of rows or why there are none."""
    return "\n".join(f"{s['dataset']} · {s.get('as_of') or 'no date'} · {s['rows'] if s.get('status', 'ok') == 'ok' else s['status']}" for s in steps)


def answer(question_id: str, question: str, retrieved: str, trace: list[str], text: str) -> str:
    """The final record, as JSON."""
    return json.dumps({"question_id": question_id, "question": question, "retrieved_context": retrieved, "think_trace": "\n".join(trace), "answer": text}, ensure_ascii=False)
