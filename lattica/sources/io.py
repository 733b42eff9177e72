"""Tables in and out: registered views with guarded SQL, JDBC, CSV, JSON sidecars, triples, schema snapshots."""

from __future__ import annotations

import hashlib
import json
import re
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import ContractError, RequestError, Truncated
from lattica.operators.federate import capped

MOST_ROWS = 10_000
#: Statements of graph queries that read, and what they may not hold.
GRAPH_READING = ("select", "ask", "construct", "describe")
GRAPH_BARRED = ("insert", "delete", "load", "clear", "drop", "create", "add", "move", "copy", "service", "with")


def stripped(sql: str) -> str:
    """A statement without comments, dollar quotes, texts and quoted names."""
    return re.sub(r"/\*.*?\*/|--[^\n]*|\$(\w*)\$.*?\$\1\$|'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`[^`]*`", " ", sql, flags=re.S)


#: Nodes of a parsed statement that do something else than read, by their class.
COMMANDS = r"Command|^Insert|^Create|^Drop|^Alter|^Replace|^Delete|^Update|^Merge|^Truncate|^Add|^Rename|^Set|^Reset|^Cache|^Uncache|^Refresh|^Load|^Describe|^Show|^Repair|^Recover|^Analyze|^Comment|^Call|^Execute|^Compound|^Use|Write|^Unresolved(?:Procedure|DbObject)"


def assert_reading(sql: str, spark: SparkSession | None = None) -> str:
    """`sql` if it is one statement that only reads, as Spark's own parser sees it: names of columns don't matter."""
    plain = stripped(sql).strip().rstrip(";").strip()
    if ";" in plain:
        raise RequestError("one statement at a time")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except Exception as e:  # the parser's own exceptions, whatever their class
        raise RequestError("not a statement: " + str(e).strip().splitlines()[0]) from None
    todo = [parsed]
    while todo:
        node = todo.pop()
        if re.search(COMMANDS, node.nodeName()):
            raise RequestError(f"only reading statements are run, not {node.nodeName()}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sql


def assert_reading_graph(query: str, only: tuple[str, ...] = ("select", "ask")) -> str:
    plain = re.sub(r"#[^\n]*|\"[^\"]*\"|'[^']*'|<[^>]*>", " ", query)
    body = re.sub(r"^\s*((prefix|base)\b[^\n]*\n?\s*)*", "", plain, flags=re.I).lstrip().lower()
    if not body.startswith(tuple(w for w in GRAPH_READING if w in only)):
        raise RequestError(f"a graph query starts with {' or '.join(only)}")
    if found := [w for w in GRAPH_BARRED if re.search(rf"\b{w}\b", body)]:
        raise RequestError(f"a graph query doesn't hold {found[0]!r}")
    return query


def run_sql(spark: SparkSession, sql: str, args: dict | list | None = None, most: int | None = MOST_ROWS) -> DataFrame:
    """A reading statement over registered views, values as parameters; more than `most` rows are an error."""
    rows = spark.sql(assert_reading(sql, spark), args=args)
    return rows if most is None else capped(rows, most)


def register(tables: dict[str, DataFrame]) -> None:
    """Tables as views; dots in names become underscores."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name.replace(".", "_"))


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A relational table; `partition` (column, lower, upper, number) reads it in parallel. The connection that finds the
    schema is tried again while it fails in passing."""
    options = {"column": partition[0], "lowerBound": partition[1], "upperBound": partition[2], "numPartitions": partition[3]} if partition else {}

    def call() -> DataFrame:
        try:
            return spark.read.jdbc(url, table, properties=properties, **options)
        except Exception as e:
            if re.search("Connection (?:refused|reset)|timed? ?out|CommunicationsException|SQLTransient", str(e)):
                raise ConnectionError(str(e).splitlines()[0]) from e
            raise

    return with_retries(call)


def read_tables(spark: SparkSession, env: dict[str, str], names: list[str], views: dict[str, DataFrame] | None = None, properties: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables by the way that is configured: over JDBC if `env` names a database, else the session's views or those given."""
    url = dsn_from_env(env)
    if url:
        return {n: read_jdbc(spark, url, n, {**({"user": env["PGUSER"]} if "PGUSER" in env else {}), **({"password": env["PGPASSWORD"]} if "PGPASSWORD" in env else {}), **(properties or {})}) for n in names}
    register(views or {})
    return {n: spark.table(n.replace(".", "_")) for n in names}


def dsn_from_env(env: dict[str, str]) -> str | None:
    """The JDBC address that the usual PostgreSQL variables name; None without a database, which means: registered views."""
    if url := env.get("DATABASE_URL"):
        return re.sub(r"^postgres(ql)?://(?:[^@/]*@)?", "jdbc:postgresql://", url)
    if base := env.get("PGDATABASE"):
        return f"jdbc:postgresql://{env.get('PGHOST', 'localhost')}:{env.get('PGPORT', '5432')}/{base}"
    return None


def with_retries(call, attempts: int = 4, first: float = 0.5, most: float = 30.0, transient=(ConnectionError, TimeoutError), sleep=time.sleep):
    """What `call` returns, asked again after growing waits while it fails for passing reasons; other errors pass at once.

    An error may carry `retry_after` (seconds), which is waited for up to `most`.
    """
    for i in range(attempts):
        try:
            return call()
        except transient as e:
            if i + 1 == attempts:
                raise
            sleep(min(most, getattr(e, "retry_after", None) or first * 2**i))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """The company master, from CSV with a header (a byte order mark is no part of the first name)."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=False)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


SIDECAR = "ticker string, isin string, name string, document string, as_of string, url string, holdings_count bigint"


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Provenance documents from JSON: a list of them, or an object whose `entries` has one by key. A file that isn't there
    or isn't JSON is an empty table, not an error."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], SIDECAR)
    text = spark.read.text(path, wholetext=True)
    keyed = F.map_values(F.from_json("value", f"struct<entries:map<string,struct<{_struct(SIDECAR)}>>>")["entries"])
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_struct(SIDECAR)}>>")).otherwise(keyed)
    return text.select(F.explode(rows).alias("x")).select("x.*")


def _struct(schema: str) -> str:
    return ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in schema.split(", "))


TRIPLES = "s string, p string, o string, kind string, lang string"


def triples_table(spark: SparkSession, triples: list[tuple]) -> DataFrame:
    return spark.createDataFrame(triples, TRIPLES)


#: Options of parquet files with many names that share beginnings: those are written by what they differ in, not in dictionaries.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#s": "false", "parquet.enable.dictionary#key": "false", "maxRecordsPerFile": str(1 << 19)}


def write_triples(triples: DataFrame, path: str, rebalanced: bool = True) -> None:
    """By predicate, so that a pattern reads one directory; large predicates are split, small ones stay one file.

    Not `rebalanced`, triples are written by the tasks that have them, without an exchange."""
    (triples.hint("rebalance", "p") if rebalanced else triples).write.mode("overwrite").options(**COMPACT).partitionBy("p").parquet(path)


# --- schema snapshots


def snapshot(tables: dict[str, DataFrame], release: str = "") -> dict:
    """Tables, columns and types with a fingerprint, and when they were taken."""
    schema = {t: {f.name: f.dataType.simpleString() for f in df.schema} for t, df in sorted(tables.items())}
    digest = hashlib.sha256(json.dumps(schema, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    return {"release_id": release or digest[:16], "fetched_at": datetime.now(UTC).isoformat(), "fingerprint": digest, "tables": schema}


def catalog_snapshot(spark: SparkSession, databases: list[str] | None = None, release: str = "", most: int = MOST_ROWS) -> dict:
    """A snapshot of the session's catalog: tables and views of databases with their columns. More than `most` entries are
    refused, since a cut list would look like a schema."""
    wanted = databases or [spark.catalog.currentDatabase()]
    tables, n = {}, 0
    for d in wanted:
        for t in spark.catalog.listTables(d):
            name = ".".join([*(t.namespace or []), t.name])
            tables[name] = spark.table(name)
            n += len(tables[name].columns)
            if n > most:
                raise Truncated(f"over {most} columns: the schema would be cut")
    return snapshot(tables, release)


def stable_snapshot(read, release) -> dict:
    """A snapshot between two equal releases; a redeployment while reading is an error."""
    before = release()
    found = snapshot(read(), before)
    if release() != before:
        raise ContractError("the release changed while the schema was read")
    return found


def save_snapshot(spark: SparkSession, found: dict, path: str) -> None:
    rows = [(found["release_id"], found["fetched_at"], found["fingerprint"], json.dumps(found["tables"], ensure_ascii=False))]
    spark.createDataFrame(rows, "release_id string, fetched_at string, fingerprint string, tables string").coalesce(1).write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str) -> dict | None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    row = spark.read.json(path).first()
    return {"release_id": row.release_id, "fetched_at": row.fetched_at, "fingerprint": row.fingerprint, "tables": json.loads(row.tables)}


class SnapshotCache:
    """A snapshot kept in the process for `seconds`, or until the release changes."""

    def __init__(self, take, release, seconds: float = 3600, clock=time.monotonic):
        self.take, self.release, self.seconds, self.clock, self.held = take, release, seconds, clock, None

    def get(self) -> dict:
        now, release = self.clock(), self.release()
        if self.held is None or now - self.held[0] > self.seconds or self.held[1] != release:
            self.held = (now, release, self.take())
        return self.held[2]


def contract_gaps(found: dict, wanted: dict[str, set[str]]) -> list[str]:
    """All wanted tables and columns that a snapshot lacks."""
    out = []
    for table, columns in wanted.items():
        have = found["tables"].get(table)
        out += [table] if have is None else [f"{table}.{c}" for c in sorted(columns - have.keys())]
    return sorted(out)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
