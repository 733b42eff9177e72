"""Graph plans as joins: typed plans are validated against the ontology and folded into joins from a seed.

Triples are a DataFrame (s, p, o); each edge of a plan filters one predicate, so a store partitioned by predicate reads
just what the plan names. Names are normalised once, when a graph is stored, into an index by level and key, so that an
entity is looked up by equality in one bucket of it. Directions of predicates are never flipped.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.functions.text import key, key_of, nfkc, organisation, organisation_key, segment_keys, spaced_key
from lattica.operators.ontology import LABEL, SKOS, Fragment, Ontology
from lattica.session import shared_dir
from lattica.sources.io import COMPACT, write_triples
from lattica.sources.turtle import RDF

TYPE = RDF + "type"
MOST_EDGES, MOST_OUTPUTS, MOST_ROWS, CANDIDATES = 8, 12, 500, 20
# The last day of data; node classes whose edges carry evidence, and the properties it is read from.
CUTOFF = "2026-08-24"
EVIDENCE_CLASSES = ("Holding", "MetricSnapshot", "SubsidiaryRelation", "Risk")
EVIDENCE = {"as_of": "asOf", "source": "sourceId", "document": "supportedBy", "document_title": "documentTitle", "document_publisher": "documentPublisher", "document_date": "documentPublishedDate", "document_quote": "documentQuote"}
# Name and code properties of classes, and the classes that a role is looked up in.
NAMES = {
    ("Company", "Organization", "Issuer", "AssetManager"): (("organizationName",), "corpCode"),
    ("ETF", "ETN", "Product", "Bond", "PublicFund", "ShareClass"): (("productName", "productShortName"), "productCode"),
    ("Security",): (("rdfs:label",), "securityCode"),
    ("Theme",): (("themeName", "rdfs:label"), "themeName"),
    ("Industry",): (("rdfs:label",), "rdfs:label"),
    ("Document",): (("documentTitle",), "sourceId"),
}
ROLES = {
    "company": ("Company", "Security", "Organization"),
    "issuer": ("Issuer", "Company", "Organization"),
    "manager": ("AssetManager", "Organization"),
    "product": ("ETF", "PublicFund", "Bond", "ETN", "Product"),
    "share_class": ("ShareClass", "PublicFund"),
    "ticker": ("ETF", "ETN", "Security", "Product"),
    "theme": ("Theme",),
    "index": ("Security",),
}
ANY_ROLE = ("Product", "Company")
ORGANISATIONS = ("Company", "Organization", "Issuer", "AssetManager")
SUFFIXES = ("ETF", "ETN", "펀드", "채권")
#: Levels at which a name is looked up, surest first, and the buckets of the index.
LEVELS, PARTIAL, BUCKETS = ("exact", "organisation", "key", "segment"), "partial", 16
#: Triples whose predicates are looked through for repeats together (a predicate with more is looked through alone), and the
#: bits of the tables that narrow what is exchanged (at most BITS / 64 rows each).
LARGE, BITS = 1 << 22, 1 << 25
# Securities known under several codes, by the names they are asked for.
REVIEWED_SECURITIES = {
    ("캠브리콘", "cambricon"): ("cambricon", ("688256 C1 EQUITY", "688256 C1 Equity", "688256 CH", "688256 CH Equity", "CNE1000041R8")),
}


@dataclass(frozen=True)
class Edge:
    subject: str
    predicate: str
    object: str


@dataclass(frozen=True)
class Output:
    node: str
    property: str
    alias: str
    optional: bool = False


@dataclass(frozen=True)
class Plan:
    """Nodes (id to class), edges, outputs and a limit. The node "seed" is the entity that was asked about."""

    nodes: dict[str, str]
    edges: tuple[Edge, ...]
    outputs: tuple[Output, ...]
    limit: int = 100


@dataclass
class Entity:
    """A resolved node; `candidates` are the distinct entities found at the level that decided."""

    status: str  # resolved, ambiguous or not_found
    uri: str | None = None
    cls: str | None = None
    level: str | None = None
    candidates: list[str] = field(default_factory=list)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind, and partitioned writes don't sort while few files are open."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": str(len(LEVELS) * BUCKETS)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def kept(rows: DataFrame) -> DataFrame:
    """`rows` computed once, in the folder that driver and executors share."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/lattica-rows-{uuid.uuid4().hex}"
    with _tidy(spark):
        rows.write.options(**COMPACT).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _place(hashed: Column) -> tuple[Column, Column]:
    """Word and bit of a hash in a table of BITS bits."""
    at = F.pmod(hashed, F.lit(BITS))
    return F.floor(at / 64).cast("int"), (at % 64).cast("int")


def _bits(hashes: DataFrame, *more: Column) -> DataFrame:
    """(_word, _bits) with a bit set for each value of the column _h: at most BITS / 64 rows, whatever comes in."""
    word, bit = _place(F.col("_h"))
    return hashes.withColumns({"_word": word, "_bit": bit}).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"), *more)


def _marked(rows: DataFrame, hashed: Column, bits: DataFrame, how: str) -> DataFrame:
    """Rows whose bit is set (how: left_semi) or isn't (left_anti). A set bit may be another hash's, one that isn't set is certain."""
    word, bit = _place(hashed)
    return rows.join(F.broadcast(bits), (word == F.col("_word")) & (F.call_function("getbit", F.col("_bits"), bit) == 1), how)


class _Narrowed:
    """Rows of a plan on their way through joins with predicates of a graph, of which only what may meet the rows is exchanged.

    Graphs of any size take this way. Before a join by a new node the rows are computed and kept, and a table of bits of their
    keys is broadcast. Rows only lose keys later on, so the bits of a column hold for all joins that follow; each join then
    settles what is left.
    """

    def __init__(self, rows: DataFrame):
        self.rows, self.bits = rows, {}

    def __call__(self, rows: DataFrame, node: str, facts: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """`rows`, maybe kept, and those of `facts` whose column may be among the rows' nodes."""
        if node not in self.rows.columns:
            self.rows, self.bits = kept(rows), {}
            rows = self.rows
        if node not in self.bits:
            self.bits[node] = _bits(self.rows.select(F.xxhash64(node).alias("_h")))
        return rows, _marked(facts, F.xxhash64(column), self.bits[node], "left_semi")


class Graph:
    def __init__(self, triples: DataFrame, ontology: Ontology, index: DataFrame | None = None, counts: dict[str, int] | None = None):
        self.triples, self.ontology = triples, ontology
        self._index, self._counts = index, counts

    # --- the store

    def store(self, path: str) -> None:
        """Triples (each once) by predicate, names by level and bucket of their keys, and how many triples each predicate has."""
        spark = self.triples.sparkSession
        with _tidy(spark):
            write_triples(self._once(path), f"{path}/triples", rebalanced=False)
            stored = Graph(spark.read.parquet(f"{path}/triples"), self.ontology)
            stored.index().write.mode("overwrite").options(**COMPACT).partitionBy("level", "bucket").parquet(f"{path}/names")
            stored.triples.groupBy("p").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")

    def _rows_by_predicate(self) -> dict[str, int]:
        return {r.p: r.n for r in self.triples.groupBy("p").agg(F.count("*").alias("n")).collect()}  # a row a predicate

    def _once(self, path: str) -> DataFrame:
        """The triples, each once, of which only those that may be repeated are exchanged, in graphs of any size.

        Hashes go first, one group of predicates after the other; those that come twice leave a bit. A triple without one is
        there once; among the others equal ones are found by their texts. A null predicate goes with the empty one.
        """
        triples, spark, predicate, counts = self.triples, self.triples.sparkSession, F.coalesce(F.col("p"), F.lit("")), Counter()
        for p, n in self._rows_by_predicate().items():
            counts[p or ""] += n
        if not counts:
            return triples
        codes = {p: i % 256 for i, p in enumerate(sorted(counts))}  # the last 8 bits of a hash; a shared one does no harm
        code = F.element_at(F.create_map(*[F.lit(x) for item in codes.items() for x in item]), predicate)
        hashed = F.shiftleft(F.xxhash64("s", "o"), 8).bitwiseOR(code.cast("long"))
        groups, room = [], 0
        for p in sorted(counts, key=counts.get):
            if not groups or counts[p] > room:
                groups, room = [*groups, []], LARGE
            groups[-1].append(p)
            room -= counts[p]
        for group in groups:
            twice = triples.filter(predicate.isin(group)).select(hashed.alias("_h")).repartition("_h").groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h")
            _bits(twice, F.collect_set(F.col("_h").bitwiseAND(255)).alias("_codes")).write.mode("append").parquet(f"{path}/repeats")
        found = spark.read.parquet(f"{path}/repeats")
        doubted = {r.c for r in found.select(F.explode("_codes").alias("c")).distinct().collect()}  # 256 at most
        doubted = [p for p in counts if codes[p] in doubted]
        if not doubted:
            return triples
        bits = found.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
        some = triples.filter(predicate.isin(doubted))
        return reduce(DataFrame.union, [triples.filter(~predicate.isin(doubted)), _marked(some, hashed, bits, "left_anti"), _marked(some, hashed, bits, "left_semi").distinct()])

    @classmethod
    def stored(cls, spark: SparkSession, path: str, ontology: Ontology) -> "Graph":
        """A graph that `store` wrote."""
        counts = {r.p: r.n for r in spark.read.parquet(f"{path}/counts").collect()}  # a row a predicate
        return cls(spark.read.parquet(f"{path}/triples"), ontology, spark.read.parquet(f"{path}/names"), counts)

    def uri(self, name: str) -> str:
        return self.ontology.expand(name if ":" in name else f"{self.ontology.prefix}:{name}")

    def uris(self, predicate: str) -> list[str]:
        """Of a predicate, or of alternatives set off by |."""
        return [self.uri(p) for p in predicate.split("|")]

    def edges(self, predicate: str) -> DataFrame:
        """(s, o) of one predicate, or of alternatives set off by |."""
        wanted = self.uris(predicate)
        return self.triples.filter(F.col("p").isin(wanted) if len(wanted) > 1 else F.col("p") == wanted[0]).select("s", "o")

    def below(self, cls: str) -> list[str]:
        """A class and those below it."""
        return sorted(self.ontology.descendants(self.uri(cls)) | {self.uri(cls)})

    def members(self, cls: str) -> DataFrame:
        """Nodes of a class or one below it; a node of several such classes comes several times."""
        return self.triples.filter((F.col("p") == TYPE) & F.col("o").isin(self.below(cls))).select("s")

    def count(self) -> int:
        return sum(self.counts().values())

    def counts(self) -> dict[str, int]:
        """How many triples each predicate has: one job for all, none where the store knows."""
        if self._counts is None:
            self._counts = self._rows_by_predicate()
        return self._counts

    def filled(self, predicate: str) -> bool:
        """Whether any triple has the predicate."""
        return any(map(self.counts().get, self.uris(predicate)))

    def exists(self, uri: str, cls: str) -> bool:
        return bool(self.members(cls).filter(F.col("s") == uri).take(1))

    # --- plans

    def problems(self, plan: Plan, entity: Entity, fragment: Fragment | None = None) -> list[str]:
        """All that is wrong with a plan; nothing runs while there is any."""
        o, out = self.ontology, []
        nodes = {i: self.uri(c) for i, c in plan.nodes.items()}
        for i, c in nodes.items():
            if not re.fullmatch(r"[A-Za-z]\w{0,39}", i):
                out.append(f"node {i!r}: not a name")
            if c not in o.classes:
                out.append(f"node {i}: no class {o.compact(c)}")
            elif fragment and c not in fragment.classes:
                out.append(f"node {i}: {o.compact(c)} is outside the fragment")
        if "seed" not in nodes:
            out.append("no seed")
        elif entity.cls and not o.compatible(self.uri(entity.cls), frozenset([nodes["seed"]])):
            out.append(f"the seed is not a {o.compact(nodes['seed'])}")
        if not plan.outputs:
            out.append("no outputs")
        elif all(x.node == "seed" and self.uri(x.property) == LABEL for x in plan.outputs):
            out.append("the seed's own label answers nothing")
        if not plan.edges and len(nodes) > 1:
            out.append("no edges")
        if len(plan.edges) > MOST_EDGES or len(plan.outputs) > MOST_OUTPUTS:
            out.append(f"over {MOST_EDGES} edges or {MOST_OUTPUTS} outputs")
        linked = {i: set() for i in nodes}
        for e in plan.edges:
            if e.subject not in nodes or e.object not in nodes:
                out.append(f"edge {e.predicate}: unknown node")
                continue
            linked[e.subject].add(e.object)
            linked[e.object].add(e.subject)
            out += self._misfit(e.predicate, "object", nodes[e.subject], nodes[e.object], fragment)
        reached, todo = {"seed"}, ["seed"]
        while todo:
            fresh = linked.get(todo.pop(), set()) - reached
            reached |= fresh
            todo += fresh
        if lost := sorted(nodes.keys() - reached):
            out.append(f"not linked to the seed: {lost}")
        taken = set(nodes)
        for x in plan.outputs:
            if x.node not in nodes:
                out.append(f"output {x.alias}: unknown node")
                continue
            if x.alias in taken or not re.fullmatch(r"[A-Za-z]\w{0,39}", x.alias):
                out.append(f"output {x.alias!r}: not a free name")
            taken.add(x.alias)
            if self.uri(x.property) == LABEL:
                continue
            bad = self._misfit(x.property, "datatype", nodes[x.node], None, fragment)
            out += bad or ([] if self.filled(x.property) else [f"output {x.alias}: {x.property} has no values"])
        if isinstance(plan.limit, bool) or not isinstance(plan.limit, int) or not 1 <= plan.limit <= MOST_ROWS:
            out.append(f"the limit is 1 to {MOST_ROWS}")
        return list(dict.fromkeys(out))

    def _misfit(self, name: str, kind: str, subject: str, target: str | None, fragment: Fragment | None) -> list[str]:
        o, p = self.ontology, self.ontology.properties.get(self.uri(name))
        if p is None:
            return [f"no property {name}"]
        out = [] if p.kind == kind else [f"{name} is a {p.kind} property"]
        if fragment and p.uri not in fragment.properties:
            out.append(f"{name} is outside the fragment")
        if not o.compatible(subject, p.domains):
            out.append(f"{name} doesn't start at {o.compact(subject)}")
        if target and not o.compatible(target, p.ranges):
            out.append(f"{name} doesn't lead to {o.compact(target)}")
        return out

    def run(self, plan: Plan, entity: Entity, fragment: Fragment | None = None, evidence: bool = True, cutoff: str = CUTOFF, capped: bool = True, where=None) -> tuple[DataFrame, list[str]]:
        """Rows of a valid plan (distinct outputs and evidence) and the evidence columns.

        `where` (rows to a condition) holds before anything is cut. With `capped` the first limit + 1 rows in the order of
        their outputs, so that a cut shows; else all of them.
        """
        if bad := self.problems(plan, entity, fragment):
            raise RequestError("; ".join(bad))
        rows = self.triples.sparkSession.range(1).select(F.lit(entity.uri).cast("string").alias("seed"))
        bound, left, narrowed = {"seed"}, list(plan.edges), _Narrowed(rows)
        while left:
            e = next(x for x in left if x.subject in bound or x.object in bound)
            left.remove(e)
            pairs = self.edges(e.predicate).toDF("_s", "_o")
            ends = [(n, c) for n, c in ((e.subject, "_s"), (e.object, "_o")) if n in bound]
            rows, pairs = narrowed(rows, ends[0][0], pairs, ends[0][1])
            rows = rows.join(pairs, reduce(lambda a, b: a & b, [F.col(n) == F.col(c) for n, c in ends]))
            for n, c in ((e.subject, "_s"), (e.object, "_o")):
                if n not in bound:
                    rows, bound = rows.withColumn(n, F.col(c)), bound | {n}
            rows = rows.drop("_s", "_o")
        for n, c in plan.nodes.items():
            if self.uri(c) in map(self.uri, ("ETF", "ETN", "PublicFund")):
                rows, members = narrowed(rows, n, self.members(c), "s")
                rows = rows.join(members.withColumnRenamed("s", n), n, "left_semi")
        for x in plan.outputs:
            rows, values = narrowed(rows, x.node, self.edges(x.property), "s")
            rows = rows.join(values.toDF(x.node, x.alias), x.node, "left" if x.optional else "inner")
        held = []
        for n, c in plan.nodes.items() if evidence else ():
            if self.uri(c) in map(self.uri, EVIDENCE_CLASSES):
                rows, held = self._with_evidence(rows, n, cutoff, narrowed), [*held, *[f"{n}_{label}" for label in EVIDENCE]]
        found = rows.select(*[x.alias for x in plan.outputs], *held)
        found = (found if where is None else found.filter(where(found))).distinct()
        return self.cut(plan, found) if capped else found, held

    def cut(self, plan: Plan, rows: DataFrame) -> DataFrame:
        """The first limit + 1 of a plan's rows, in the order of their columns, so that a cut shows."""
        return rows.orderBy(*rows.columns).limit(plan.limit + 1)

    def _with_evidence(self, rows: DataFrame, node: str, cutoff: str, narrowed: _Narrowed) -> DataFrame:
        """`rows` with the evidence of a node: one scan of the properties that the store has, one of those of documents.

        Of several values the largest counts; a node all of whose days are after the cut-off loses its rows.
        """
        own = {label: p for label, p in EVIDENCE.items() if not label.startswith("document_")}
        documents = {label: p for label, p in EVIDENCE.items() if label not in own}
        day = F.col("_p") == self.uri(EVIDENCE["as_of"])
        late = (F.count(F.when(day, 1)) > 0) & (F.count(F.when(day & (F.col("_o") <= cutoff), 1)) == 0)
        rows = self._pivoted(rows, node, {f"{node}_{label}": p for label, p in own.items()}, narrowed, ~day | (F.col("_o") <= cutoff), late).filter("not _late").drop("_late")
        return self._pivoted(rows, f"{node}_document", {f"{node}_{label}": p for label, p in documents.items()}, narrowed)

    def _pivoted(self, rows: DataFrame, owner: str, wanted: dict[str, str], narrowed: _Narrowed, taken: Column | None = None, late: Column | None = None) -> DataFrame:
        """`rows` (each once) with a column for each wanted property of a node: the largest value that `taken` allows."""
        there = [self.uri(p) for p in wanted.values() if self.filled(p)]
        if not there:
            return rows.withColumns({c: F.lit(None).cast("string") for c in wanted} | ({"_late": F.lit(False)} if late is not None else {}))
        facts = self.triples.filter(F.col("p").isin(there)).select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
        rows, facts = narrowed(rows, owner, facts, "_s")
        joined = rows.join(facts, F.col(owner) == F.col("_s"), "left")
        value = F.col("_o") if taken is None else F.when(taken, F.col("_o"))
        columns = [F.max(F.when(F.col("_p") == self.uri(p), value)).alias(c) for c, p in wanted.items()]
        return joined.groupBy(*rows.columns).agg(*columns, *([late.alias("_late")] if late is not None else []))

    def sources(self, plan: Plan) -> list[tuple[str, str, str]]:
        """(property, table, column) that the ontology notes for what a plan reads, for plans without evidence nodes."""
        used = dict.fromkeys([self.uri(e.predicate) for e in plan.edges] + [self.uri(x.property) for x in plan.outputs])
        return [(self.ontology.compact(u), t, c) for u in used if u in self.ontology.properties for t, c in self.ontology.properties[u].source]

    def codes(self, plan: Plan, rows: DataFrame) -> DataFrame:
        """The product codes among a plan's outputs: what it hands on to tables."""
        aliases = [x.alias for x in plan.outputs if self.uri(x.property) == self.uri("productCode")]
        if not aliases:
            raise RequestError("the plan has no product code")
        return reduce(DataFrame.union, [rows.select(F.col(a).alias("code")) for a in aliases]).filter("code is not null").distinct()

    # --- entities

    def names(self, cls: str) -> tuple[str, str]:
        for classes, (names, code) in NAMES.items():
            if cls in classes:
                return "|".join(names), code
        raise RequestError(f"no names are known for {cls}")

    def name_index(self, cls: str) -> DataFrame:
        """(s, value, kind) of a class: names, labels, alternative labels and codes of its members, each once."""
        return self._named(cls).join(self.members(cls), "s", "left_semi").distinct()

    def _named(self, cls: str) -> DataFrame:
        names, code = self.names(cls)
        by_name = self.edges("|".join(dict.fromkeys([*names.split("|"), "rdfs:label", SKOS + "altLabel"])))
        return by_name.withColumn("kind", F.lit("name")).union(self.edges(code).withColumn("kind", F.lit("code"))).withColumnRenamed("o", "value")

    def segment_index(self, cls: str) -> DataFrame:
        """(segment, s): the keys of all runs of segments of a class's names, to look labels up without a scan."""
        own = self.name_index(cls).filter("kind = 'name'").select("s", nfkc(F.col("value")).alias("value"))
        return own.select("s", F.explode(segment_keys(F.col("value"))).alias("segment")).distinct()

    def index(self) -> DataFrame:
        """(family, level, bucket, key, s, path): all names under each level's key; a name's single segments lead to its path.

        A family is a line of NAMES. Linear in the names: a run of segments is found by its first and checked in the path, which
        other levels don't have. Nothing is exchanged: a name gives each row once, two names of a node may give the same.
        """
        if self._index is not None:
            return self._index
        parts = []
        for family, classes in enumerate(NAMES):
            own = self._named(classes[0]).select("s", "value", "kind", nfkc(F.col("value")).alias("form"))
            named, whole = F.col("kind") == "name", ~F.col("form").contains("/")
            path = F.when(named, F.concat(F.lit("/"), F.when(whole, key_of(F.col("form"))).otherwise(F.array_join(F.filter(F.transform(F.split("form", "/"), key_of), lambda x: x != ""), "/")), F.lit("/")))
            spaced = spaced_key(F.col("form"))
            single = [("exact", F.col("value")), ("exact", F.when(spaced != F.col("value"), spaced)), ("key", key_of(F.col("value")))]
            single += [("organisation", F.when(named, organisation_key(F.col("form"))))] if classes[0] in ORGANISATIONS else []
            segments = F.when(named & whole, F.array(F.struct(F.lit("segment").alias("level"), F.nullif(key_of(F.col("form")), F.lit("")).alias("key")))).when(named, F.transform(F.array_distinct(F.filter(F.split(path, "/"), lambda x: x != "")), lambda x: F.struct(F.lit("segment").alias("level"), x.alias("key"))))
            every = F.concat(F.array(*[F.struct(F.lit(n).alias("level"), k.alias("key")) for n, k in single]), F.coalesce(segments, F.array().cast("array<struct<level:string,key:string>>")))
            parts.append(own.select(F.lit(family).alias("family"), "s", path.alias("path"), F.explode(every).alias("x")).select("family", "x.level", "x.key", "s", F.when(F.col("x.level") == "segment", F.col("path")).alias("path")))
        return reduce(DataFrame.union, parts).filter("key is not null").withColumn("bucket", (F.crc32(F.col("key").cast("binary")) % BUCKETS).cast("int"))

    def _probes(self, texts: list[tuple[int, str, str]], partial: bool, suffixes: tuple[str, ...]) -> list[tuple]:
        """(place, number, cls, family, level, key, run) in order of preference for texts (number, text, cls): as they are, then without a type word."""
        out: list[tuple] = []
        for number, text, cls in texts:
            self.names(cls)
            family = next(i for i, classes in enumerate(NAMES) if cls in classes)
            text = " ".join(text.split())
            for wanted in dict.fromkeys([text, *(text.removesuffix(x).strip() for x in suffixes if text.endswith(x))]):
                if not wanted:
                    continue
                run = key(wanted).strip("/")
                levels = [("exact", wanted, None), ("exact", wanted.lower(), None), ("organisation", organisation(wanted), None), ("key", key(wanted), None), ("segment", run.split("/")[0], f"/{run}/"), *([(PARTIAL, None, key(wanted))] if partial else [])]
                for level, k, r in levels:
                    if level != "organisation" or cls in ORGANISATIONS:
                        same = level == "exact" and k != wanted  # both forms of a level count alike
                        out.append((out[-1][0] if same else len(out), number, cls, family, level, k, r))
        return out

    def matches(self, texts: list[tuple[int, str, str]], partial: bool = False, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, list[tuple]]:
        """(number, place, s): the nodes that the texts (number, text, cls) name, and the probes that places stand for."""
        probes = self._probes(texts, partial, suffixes)
        index, asked = self.index(), self.triples.sparkSession.createDataFrame(probes, "place int, number int, cls string, family int, level string, wanted string, run string")
        keys = sorted({p[5] for p in probes if p[5] is not None})
        buckets = sorted({zlib.crc32(k.encode()) % BUCKETS for k in keys})
        index = index.filter(F.col("family").isin(sorted({p[3] for p in probes})))  # other families' names aren't read
        equal = index.filter(F.col("level").isin(sorted({p[4] for p in probes} - {PARTIAL})) & F.col("bucket").isin(buckets) & F.col("key").isin(keys)).withColumnRenamed("level", "_level").withColumnRenamed("family", "_family")
        found = equal.join(F.broadcast(asked), (F.col("_family") == F.col("family")) & (F.col("_level") == F.col("level")) & (F.col("key") == F.col("wanted")) & (F.col("run").isNull() | F.col("path").contains(F.col("run")))).select("number", "place", "cls", "s")
        for place, number, cls, family, level, _, run in probes:  # containment needs all keys of the family
            if level == PARTIAL:
                inside = index.filter((F.col("level") == "key") & (F.col("family") == family) & F.col("key").contains(run))
                found = found.union(inside.select(F.lit(number).alias("number"), F.lit(place).alias("place"), F.lit(cls).alias("cls"), "s"))
        classes = [(c, o) for c in sorted({p[2] for p in probes}) for o in self.below(c)]
        types = self.triples.filter((F.col("p") == TYPE) & F.col("o").isin(sorted({o for _, o in classes}))).select(F.col("s").alias("_s"), "o")
        kinds = self.triples.sparkSession.createDataFrame(classes, "_cls string, _o string")
        typed = found.join(types, F.col("s") == F.col("_s")).join(F.broadcast(kinds), (F.col("cls") == F.col("_cls")) & (F.col("o") == F.col("_o")))
        return typed.select("number", "place", "s").distinct(), probes

    def resolved(self, texts: list[tuple[int, str, str]], partial: bool = False, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
        """(number, level, uri, entities) for each text (number, text, cls) that names anything: the first level that finds
        any, how many entities it finds, and the one if it is one. One plan for all texts."""
        found, probes = self.matches(texts, partial, suffixes)
        levels = F.create_map(*[x for place, level in {p[0]: p[4] for p in probes}.items() for x in (F.lit(place), F.lit(level))])
        first = found.withColumn("_first", F.min("place").over(Window.partitionBy("number"))).filter("place = _first")
        every = first.groupBy("number", "place").agg(F.count("*").alias("entities"), F.min("s").alias("uri"))
        return every.select("number", levels[F.col("place")].alias("level"), F.when(F.col("entities") == 1, F.col("uri")).alias("uri"), "entities")

    def resolve(self, text: str, cls: str, partial: bool = False, suffixes: tuple[str, ...] = SUFFIXES) -> Entity:
        """The entity that a text names, by the first level that finds any: equal, organisation form, key or segment,
        (if asked for) contained, and the same without a type word at the end. Several entities at a level are ambiguous."""
        return self._first([(0, text, cls)], partial, suffixes)[0]

    def _first(self, texts: list[tuple[int, str, str]], partial: bool = False, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Entity, int | None]:
        """What the first of the texts that names anything names, and its number: one job for all of them."""
        texts = [t for t in texts if t[1].strip()]
        if not texts:
            return Entity("not_found"), None
        found, probes = self.matches(texts, partial, suffixes)
        rows = found.orderBy("place", "s").limit(CANDIDATES + 1).collect()
        if not rows:
            return Entity("not_found", cls=texts[-1][2]), None
        best = [r.s for r in rows if r.place == rows[0].place]
        _, number, cls, _, level, _, _ = next(p for p in probes if p[0] == rows[0].place)
        return Entity("resolved" if len(best) == 1 else "ambiguous", best[0] if len(best) == 1 else None, cls, level, best[:CANDIDATES]), number

    def seed(self, mentions: list[tuple[str, str]]) -> tuple[Entity, list[tuple[str, str, str]]]:
        """The first of (text, role) mentions that resolves or is ambiguous in its role's classes, and what was tried."""
        pairs = [(text, cls) for text, role in mentions for cls in ROLES.get(role, ANY_ROLE)]
        found, number = self._first([(i, text, cls) for i, (text, cls) in enumerate(pairs)])
        last = len(pairs) if number is None else number + 1
        return found, [(text, cls, found.status if i == number else "not_found") for i, (text, cls) in enumerate(pairs[:last])]

    # --- themes

    def theme_members(self, facets: list[str], limit: int | None = None) -> DataFrame:
        """(code, name, matched_theme) of products with every facet: the theme of that very name, else all that contain it.

        One plan: facets to themes by the surest level that finds any, themes to products, products counted by facet.
        The theme is the first facet's.
        """
        found, _ = self.matches([(i, x, "Theme") for i, x in enumerate(facets)], partial=True)
        surest = found.withColumn("_first", F.min("place").over(Window.partitionBy("number"))).filter("place = _first").select("number", F.col("s").alias("o"))
        linked = self.edges("relatedToTheme").join(surest, "o").join(self.edges("themeName").toDF("o", "theme"), "o", "left")
        every = linked.groupBy("s").agg(F.countDistinct("number").alias("_n"), F.min(F.when(F.col("number") == 0, F.col("theme"))).alias("matched_theme")).filter(F.col("_n") == len(facets))
        rows = every.join(self.edges("productCode").toDF("s", "code"), "s").join(self.edges("productShortName").toDF("s", "name"), "s", "left")
        one = rows.groupBy("code").agg(F.min(F.struct(F.coalesce("matched_theme", F.lit("")).alias("matched_theme"), "name")).alias("x")).select("code", "x.name", "x.matched_theme")
        return one.orderBy("code").limit(limit) if limit else one

    def holders_of(self, codes: tuple[str, ...], label_part: str = "") -> DataFrame:
        """(etf_code, security_code) of products holding securities under any of several reviewed codes, each pair once."""
        securities = self.edges("securityCode").filter(F.col("o").isin(list(codes))).toDF("security", "security_code")
        if label_part:
            securities = securities.join(self.edges("rdfs:label").filter(F.lower("o").contains(label_part.lower())).toDF("security", "_l"), "security", "left_semi")
        holdings = self.edges("holdingSecurity").toDF("holding", "security").join(securities, "security")
        etfs = self.edges("hasHolding").toDF("etf", "holding").join(holdings, "holding").join(self.edges("productCode").toDF("etf", "etf_code"), "etf")
        return etfs.select("etf_code", "security_code").distinct()


def reviewed_security(text: str) -> tuple[str, tuple[str, ...]] | None:
    """(part of the label, codes) of a security that is known under several codes, for `holders_of`."""
    wanted = key(text)
    return next((v for names, v in REVIEWED_SECURITIES.items() if wanted in names), None)


# --- plans that need no generator


def _within(limit: int) -> int:
    return min(max(limit, 1), MOST_ROWS)


# The classes, properties and output names of the plans below.
CHILD_OF_SEED = (Edge("seed", "hasSubsidiary", "relation"), Edge("relation", "subsidiaryCompany", "child"))
HELD_SECURITY = (Edge("holding", "holdingSecurity", "security"), Edge("etf", "hasHolding", "holding"))
PRODUCT = (Output("etf", "productCode", "etf_code"), Output("etf", "productShortName", "etf_name"))
WEIGHT = Output("holding", "weight", "weight", optional=True)
CHILD_NAME = Output("child", "organizationName", "child_name")


def subsidiaries(limit: int = 100) -> Plan:
    outputs = (CHILD_NAME, Output("child", "corpCode", "child_corp_code", optional=True), Output("relation", "ownershipPct", "ownership_pct", optional=True))
    return Plan({"seed": "Company", "relation": "SubsidiaryRelation", "child": "Company"}, CHILD_OF_SEED, outputs, _within(limit))


def holders(limit: int = MOST_ROWS, target: str = "ETF", security_seed: bool = False) -> Plan:
    """Products that hold securities of a company, or a security itself."""
    if security_seed:
        return Plan({"seed": "Security", "holding": "Holding", "etf": target}, (Edge("holding", "holdingSecurity", "seed"), HELD_SECURITY[1]), (*PRODUCT, WEIGHT), _within(limit))
    nodes = {"seed": "Company", "security": "Security", "holding": "Holding", "etf": target}
    return Plan(nodes, (Edge("security", "issuedByCompany", "seed"), *HELD_SECURITY), (*PRODUCT, WEIGHT), _within(limit))


def subsidiary_holders(limit: int = MOST_ROWS) -> Plan:
    nodes = {"seed": "Company", "relation": "SubsidiaryRelation", "child": "Company", "security": "Security", "holding": "Holding", "etf": "ETF"}
    return Plan(nodes, (*CHILD_OF_SEED, Edge("security", "issuedByCompany", "child"), *HELD_SECURITY), (CHILD_NAME, *PRODUCT, WEIGHT), _within(limit))


def theme_products(limit: int = MOST_ROWS) -> Plan:
    return Plan({"seed": "Theme", "etf": "ETF"}, (Edge("etf", "relatedToTheme", "seed"),), PRODUCT, _within(limit))


# Words that stand for a relation and for a kind of product.
RELATION_WORDS = {"subsidiary_of": "owns", "has_subsidiary": "owns", "자회사": "owns", "holds": "holds", "holding": "holds", "held_by": "holds", "편입": "holds", "보유": "holds"}
KIND_WORDS = {"펀드": "PublicFund", "fund": "PublicFund", "publicfund": "PublicFund"}
#: The plan for what a chain of relations says, by (its relations, class of the seed, kind of product); "" is any.
READY = (
    ({"owns", "holds"}, "", "ETF", lambda limit: subsidiary_holders(max(limit, 100))),
    ({"owns", "holds"}, "", "", subsidiaries),
    ({"owns"}, "", "", subsidiaries),
    ({"holds"}, "Company", "ETF", lambda limit: holders(max(limit, 100))),
    ({"holds"}, "Company", "PublicFund", lambda limit: holders(max(limit, 100), "PublicFund")),
    ({"holds"}, "Security", "ETF", lambda limit: holders(max(limit, 100), "ETF", security_seed=True)),
    ({"holds"}, "Security", "PublicFund", lambda limit: holders(max(limit, 100), "PublicFund", security_seed=True)),
)


def ready_plan(relations: list[str], target: str, seed_class: str = "Company", limit: int = 100) -> Plan | None:
    """The plan for a chain of relations to a kind of product, if there is one; holdings without a kind are those of ETFs."""
    said, target = {RELATION_WORDS.get(r.casefold()) for r in relations} - {None}, target.casefold()
    kind = KIND_WORDS.get(target, "ETF" if "etf" in target or (not target and "holds" in said) else None)
    return next((make(limit) for of, seed, product, make in READY if of == said and seed in ("", seed_class) and product in ("", kind)), None)


def cleaned(plan: Plan) -> Plan:
    """A plan with usable names for nodes and outputs; classes and predicates stay as they are."""
    used: set[str] = set()

    def name(text: str, fallback: str) -> str:
        base = re.sub(r"\W", "_", text, flags=re.A).strip("_")[:36] or fallback
        base = base if base[0].isalpha() else f"n_{base}"
        out, k = base, 2
        while out in used:
            out, k = f"{base}_{k}", k + 1
        used.add(out)
        return out

    ids = {i: "seed" if i == "seed" else None for i in plan.nodes}
    used.add("seed")
    ids = {i: v or name(i, "node") for i, v in ids.items()}
    outputs = tuple(Output(ids.get(x.node, x.node), x.property, name(x.alias, "value"), x.optional) for x in plan.outputs)
    return Plan({ids[i]: c for i, c in plan.nodes.items()}, tuple(Edge(ids.get(e.subject, e.subject), e.predicate, ids.get(e.object, e.object)) for e in plan.edges), outputs, plan.limit)


def generated_plan(graph: Graph, entity: Entity, fragment: Fragment, generator, attempts: int = 3) -> Plan:
    """A plan from a generator (a callable that takes the problems so far), asked again while its plans have any."""
    problems: list[str] = []
    for _ in range(attempts):
        plan = cleaned(generator(problems))
        problems = graph.problems(plan, entity, fragment)
        if not problems:
            return plan
    raise RequestError("no valid plan: " + "; ".join(problems))
