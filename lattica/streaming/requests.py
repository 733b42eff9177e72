"""Filters and projection of a request over a stream of a domain's rows, through the same compiler as over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lattica.errors import RequestError
from lattica.plans.catalog import Catalog
from lattica.plans.compile import Compiled, Compiler


def compile_stream(catalog: Catalog, stream: DataFrame, request: dict, tables: dict[str, DataFrame] | None = None) -> Compiled:
    """A request without sort or named entity over a stream; enrichments join the stream with tables as they stand."""
    if request.get("sort") or request.get("entity"):
        raise RequestError("a stream has no end to sort, and no rows to tell a name by")
    d = catalog[request["domain"]]
    return Compiler(catalog, {**(tables or {}), d.table: stream}).compile(request)
