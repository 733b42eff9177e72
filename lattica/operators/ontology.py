"""The ontology (classes, properties, labels) on the driver: it is a few hundred rows, read once."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.sources.turtle import RDF, Triple

# Namespaces.
RDFS, OWL, SKOS = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#"
LABEL = RDFS + "label"


@dataclass(frozen=True)
class Property:
    uri: str
    kind: str  # object or datatype
    domains: frozenset[str]
    ranges: frozenset[str]
    label: str = ""
    comment: str = ""
    source: tuple[tuple[str, str], ...] = ()  # (table, column)


@dataclass
class Fragment:
    """The part of an ontology that a plan may use."""

    seeds: list[str]
    classes: list[str]
    properties: list[str]
    hits: list[tuple[str, int]] = field(default_factory=list)


def _words(text: str) -> set[str]:
    return {w for w in re.findall(r"\w+", text.casefold()) if len(w) > 1}


class Ontology:
    def __init__(self, triples: list[Triple], namespace: str, prefix: str = "fp"):
        self.namespace, self.prefix = namespace, prefix
        self.of: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o, _, _ in triples:
            self.of[s][p].append(o)
        kinds = {s: set(v[RDF + "type"]) for s, v in self.of.items()}
        self.classes = {s for s, k in kinds.items() if OWL + "Class" in k and not s.startswith("_:")}
        self.parents = {c: {p for p in self.of[c][RDFS + "subClassOf"] if p in self.classes} for c in self.classes}
        self.properties = {}
        for s, k in kinds.items():
            kind = "object" if OWL + "ObjectProperty" in k else "datatype" if OWL + "DatatypeProperty" in k else None
            if kind:
                v = self.of[s]
                tables, columns = v[namespace + "sourceTable"], v[namespace + "sourceColumn"]
                self.properties[s] = Property(s, kind, self._classes_in(v[RDFS + "domain"]), self._classes_in(v[RDFS + "range"]), " ".join(v[LABEL]), " ".join(v[RDFS + "comment"]), tuple(zip(tables, columns)))
        self.individuals = {s: sorted(k & self.classes) for s, k in kinds.items() if k & self.classes and s not in self.classes}
        self._closure: dict[str, frozenset[str]] = {}

    # --- names

    def expand(self, name: str) -> str:
        return self.namespace + name[len(self.prefix) + 1 :] if name.startswith(self.prefix + ":") else LABEL if name == "rdfs:label" else name

    def compact(self, uri: str) -> str:
        return f"{self.prefix}:{uri[len(self.namespace):]}" if uri.startswith(self.namespace) else uri

    # --- classes

    def _classes_in(self, values: list[str]) -> frozenset[str]:
        """Named classes of domain or range values; a union stands for its members."""
        out = set()
        for v in values:
            if v.startswith("_:"):
                rest = next(iter(self.of[v][OWL + "unionOf"]), RDF + "nil")
                while rest != RDF + "nil":
                    out |= self._classes_in(self.of[rest][RDF + "first"])
                    rest = next(iter(self.of[rest][RDF + "rest"]), RDF + "nil")
            else:
                out.add(v)
        return frozenset(out)

    def ancestors(self, cls: str) -> frozenset[str]:
        """A class and all it is a subclass of (reflexive, transitive; cycles are harmless)."""
        if cls not in self._closure:
            found, todo = {cls}, [cls]
            while todo:
                for p in self.parents.get(todo.pop(), ()):
                    if p not in found:
                        found.add(p)
                        todo.append(p)
            self._closure[cls] = frozenset(found)
        return self._closure[cls]

    def descendants(self, cls: str) -> set[str]:
        return {c for c in self.classes if cls in self.ancestors(c)}

    def compatible(self, cls: str, among: frozenset[str]) -> bool:
        """Whether a class is one of, below or above one of `among` (anything if `among` is empty)."""
        return not among or any(a in self.ancestors(cls) or cls in self.ancestors(a) for a in among)

    def closure_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, a) for c in sorted(self.classes) for a in sorted(self.ancestors(c))], "cls string, ancestor string")

    def label_table(self, spark: SparkSession) -> DataFrame:
        """(axis, label, uri) of individuals: labels and alternative labels by local class name."""
        rows = [(c[len(self.namespace) :] if c.startswith(self.namespace) else c, label, i) for i, classes in self.individuals.items() for c in classes for label in {*self.of[i][LABEL], *self.of[i][SKOS + "altLabel"]}]
        return spark.createDataFrame(sorted(rows), "axis string, label string, uri string")

    def named(self, axis: str, label: str) -> list[str]:
        """The individuals of a class that have a label."""
        return [i for i, classes in self.individuals.items() if self.expand(f"{self.prefix}:{axis}") in classes and label in {*self.of[i][LABEL], *self.of[i][SKOS + "altLabel"]}]

    def source_values(self, axis: str, label: str) -> list[str]:
        """All labels of the one individual of a class that `label` names, for a membership test in source spelling."""
        found = self.named(axis, label)
        if len(found) != 1:
            raise RequestError(f"{label!r} names {len(found)} individuals of {axis}")
        return sorted({*self.of[found[0]][LABEL], *self.of[found[0]][SKOS + "altLabel"]})

    # --- fragments

    def class_hits(self, text: str, k: int = 4) -> list[tuple[str, int]]:
        """The classes whose labels, comments and aliases share most with a text: shared words count 2, a label 5, an alias 3."""
        wanted, plain, scored = _words(text), text.casefold().replace(" ", ""), []
        for c in self.classes:
            v = self.of[c]
            labels, aliases = v[LABEL], v[SKOS + "altLabel"]
            score = 2 * len(wanted & _words(" ".join([*labels, *v[RDFS + "comment"], *aliases])))
            score += 5 * sum(x.casefold().replace(" ", "") in plain for x in labels) + 3 * sum(x.casefold().replace(" ", "") in plain for x in aliases)
            if score:
                scored.append((c, score))
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:k]

    def fragment(self, text: str, seeds: list[str] | None = None, hops: int = 2, required: frozenset[str] = frozenset(), most_classes: int = 12, most_properties: int = 36) -> Fragment:
        """Classes and properties within 1 to 3 hops of the seed and hit classes, the most telling first, within limits."""
        if not 1 <= hops <= 3:
            raise RequestError("a fragment has 1 to 3 hops")
        hits = self.class_hits(text)
        start = [c for c in dict.fromkeys([self.expand(x) for x in seeds or ()] + [c for c, _ in hits]) if c in self.classes]
        if not start:
            raise RequestError("the text names no class")
        wanted = text.casefold().replace(" ", "")
        worth = {u: 20 * (u in required) + 10 * bool(p.domains & set(start)) + sum(w in wanted for w in _words(p.label + " " + p.comment)) for u, p in self.properties.items()}
        classes, edge, chosen = list(start), list(start), []
        for _ in range(hops):
            near = [u for u, p in self.properties.items() if any(self.compatible(c, p.domains | p.ranges) for c in edge)]
            near.sort(key=lambda u: (-worth[u], u))
            reached = []
            for u in near[:most_properties]:
                if u not in chosen and len(chosen) < most_properties:
                    chosen.append(u)
                reached += [c for c in sorted(self.properties[u].domains | self.properties[u].ranges) if c in self.classes and c not in classes and c not in reached]
            edge = reached[: max(0, most_classes - len(classes))]
            classes += edge
            if not edge:
                break
        own = set(classes)
        for u in sorted(self.properties):
            p = self.properties[u]
            if len(chosen) < most_properties and u not in chosen and p.domains & own and (p.kind == "datatype" or u in required):
                chosen.append(u)
                classes += [c for c in sorted(p.ranges & self.classes) if c not in classes]
        return Fragment(start, sorted(classes), sorted(chosen), hits)


def closure_by_rounds(edges: DataFrame, most: int = 50) -> DataFrame:
    """(a, b): the reflexive-transitive closure of (a, b) edges, for hierarchies too large for the driver. Paths double each round."""
    nodes = edges.select("a").union(edges.select("b")).distinct()
    paths = edges.union(nodes.select("a", F.col("a").alias("b"))).distinct()
    size = -1
    for _ in range(most):
        paths = paths.alias("x").join(paths.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").distinct().checkpoint()
        now = paths.count()
        if now == size:
            return paths
        size = now
    raise RequestError(f"the hierarchy is deeper than 2^{most}")
