"""Graph stores: one behind an HTTP endpoint as a data source, and the choice of the first store that answers.

A store that can't be opened or reached is unavailable and the next one is asked; a store that answers with nothing is
an answer. Wrong queries and results over a limit are errors of the request, no reason to ask another store.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from lattica.errors import Unavailable
from lattica.sources.io import assert_reading_graph, with_retries

TIMEOUT, PAGE = 60.0, 10_000
PASSING = (ConnectionError, TimeoutError, urllib.error.URLError)


def asked(endpoint: str, query: str, timeout: float = TIMEOUT, attempts: int = 3) -> dict:
    """The JSON results of a reading query, asked again while the endpoint fails in passing (429 and 5xx included)."""
    request = urllib.request.Request(endpoint, assert_reading_graph(query).encode(), {"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json"})

    def call() -> dict:
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise ConnectionError(f"{endpoint}: {e.code}") from e
            raise

    return with_retries(call, attempts, transient=PASSING)


class _Predicate(InputPartition):
    pass


class SparqlReader(DataSourceReader):
    """A partition a predicate, read in pages in a total order; a predicate that is filtered for is the only one asked."""

    def __init__(self, options: dict):
        self.endpoint, self.page = options["endpoint"], int(options.get("page", PAGE))
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.wanted: set[str] | None = set(json.loads(options["predicates"])) if "predicates" in options else None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("p",):
                among = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = among if self.wanted is None else self.wanted & among
            elif not isinstance(f, IsNotNull):  # nothing here is null
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.wanted is None:
            found = asked(self.endpoint, "SELECT DISTINCT ?p WHERE { ?s ?p ?o }", self.timeout)
            self.wanted = {b["p"]["value"] for b in found["results"]["bindings"]}
        return [_Predicate(p) for p in sorted(self.wanted)] or [_Predicate(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p, at = partition.value, 0
        if p is None or any(c in p for c in "<>\"{}|^`\\ \n"):
            return
        while True:
            query = f"SELECT ?s ?o WHERE {{ ?s <{p}> ?o }} ORDER BY ?s ?o LIMIT {self.page} OFFSET {at}"
            rows = asked(self.endpoint, query, self.timeout)["results"]["bindings"]
            yield from ((b["s"]["value"], p, b["o"]["value"]) for b in rows)
            if len(rows) < self.page:
                return
            at += self.page


class SparqlDataSource(DataSource):
    """Format "sparql": triples (s, p, o) of an endpoint. Options: endpoint, predicates (a JSON list), page, timeout."""

    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return "s string, p string, o string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SparqlReader(self.options)


def read_sparql(spark: SparkSession, endpoint: str, **options: str) -> DataFrame:
    """Triples of a remote graph; filters on `p` become what is asked for.

    The filter that is always there has Spark ask the source's reader anew for each plan; a plan without filters would take
    what the last one with filters planned.
    """
    spark.dataSource.register(SparqlDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sparql").options(endpoint=endpoint, **options).load().filter("s is not null")


def remote_alive(endpoint: str, timeout: float = TIMEOUT) -> bool:
    """Whether an endpoint answers at all; raises what `first_available` takes for unavailable."""
    return bool(asked(endpoint, "ASK { ?s ?p ?o }", timeout, attempts=1).get("boolean"))


def first_available(stores: dict[str, Callable[[], object]]) -> Callable[[], object]:
    """A callable that opens the first of named stores that can be opened; `Unavailable` names why none could."""

    def opened():
        why = []
        for name, store in stores.items():
            try:
                return store()
            except (OSError, *PASSING, AnalysisException) as e:  # no such path, no connection
                why.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        raise Unavailable("no graph store answers: " + "; ".join(why or ["none is configured"]))

    return opened
