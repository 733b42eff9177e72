"""The semantic catalog: what concepts of a domain mean in columns, and how their values compare."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from lattica.errors import ContractError, RequestError
from lattica.functions.text import squeeze

KINDS = ("numeric", "categorical", "ordinal", "flag", "date", "text", "boolean")


@dataclass(frozen=True)
class Enrichment:
    """A table joined on the left, one row a key. `columns` maps the names it gives to its own columns."""

    table: str
    key: str
    base_key: str


@dataclass(frozen=True)
class Attribute:
    """One concept: its column, the kind of its values, and what a request may say about them."""

    name: str
    column: str
    kind: str = "text"
    values: tuple[str, ...] = ()  # closed set (categorical) or scale from worst to best (ordinal)
    true: str | None = None  # stored codes of a flag or boolean
    false: str | None = None
    true_words: tuple[str, ...] = ()
    false_words: tuple[str, ...] = ()
    unit: str | None = None
    organisation: bool = False
    join: str | None = None
    zero_missing: bool = False
    as_of: tuple[str, ...] = ()
    currency: tuple[str, str] | None = None  # column and code that an amount in that currency implies
    description: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise RequestError(f"unknown kind of value: {self.kind}")


@dataclass(frozen=True)
class Subtype:
    column: str
    operator: str
    value: str


@dataclass(frozen=True)
class SalePolicy:
    """What "on sale" means: a filter on a column, or none with a reason."""

    reason: str
    column: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class OutputView:
    """A derived field that is shown, never filtered or sorted by."""

    kind: str
    inputs: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    periods: tuple[str, ...] = ()
    axes: tuple[tuple[str, str], ...] = ()
    reason: str = ""


@dataclass(frozen=True)
class Guard:
    """A filter that holds unless a request says something about its column: kinds of product in one table."""

    column: str
    default: str
    other: str


@dataclass(frozen=True)
class Domain:
    name: str
    table: str
    code: str
    title: str
    identity: tuple[str, ...]
    attributes: dict[str, Attribute]
    aliases: dict[str, str] = field(default_factory=dict)
    enrichments: dict[str, Enrichment] = field(default_factory=dict)
    subtypes: dict[str, Subtype] = field(default_factory=dict)
    sale: SalePolicy = SalePolicy("no policy is registered")
    views: dict[str, OutputView] = field(default_factory=dict)
    guard: Guard | None = None
    class_column: str | None = None

    def resolve(self, concept: str, described: dict[str, str] | None = None) -> Attribute:
        """The attribute a concept names: exactly, as an alias, without white space and case, or by a column's own
        description if just one column has it. Descriptions never override the catalog."""
        for names in (self.attributes, self.aliases):
            if concept in names:
                return replace(self.attributes[names[concept] if names is self.aliases else concept], name=concept)
        wanted = squeeze(concept)
        found = {a.column: a for n, a in self.attributes.items() if squeeze(n) == wanted}
        found |= {self.attributes[t].column: self.attributes[t] for n, t in self.aliases.items() if squeeze(n) == wanted}
        if not found:
            columns = {c for c, text in (described or {}).items() if squeeze(text) == wanted}
            by_column = {a.column: a for a in self.attributes.values()}
            found = {c: by_column.get(c) or Attribute(concept, c) for c in columns}
        if len(found) != 1:
            raise RequestError(f"{self.name}: {concept!r} names {'no column' if not found else 'several columns'}")
        return replace(next(iter(found.values())), name=concept)

    def fields(self, concept: str) -> list[str]:
        """A requested field, or the two it joins with a middle dot or slash if both are known."""
        for mark in ("·", "/"):
            parts = [p.strip() for p in concept.split(mark)]
            if len(parts) == 2 and not self.knows(concept) and all(map(self.knows, parts)):
                return parts
        return [concept]

    def knows(self, concept: str) -> bool:
        if self.view(concept):
            return True
        try:
            self.resolve(concept)
        except RequestError:
            return False
        return True

    def view(self, concept: str) -> tuple[str, OutputView] | None:
        wanted = squeeze(concept)
        for name, view in self.views.items():
            if wanted in {squeeze(x) for x in (name, *view.aliases)}:
                return name, view
        return None

    def subtype(self, value: str) -> Subtype | None:
        return self.subtypes.get(value)

    def columns(self) -> set[str]:
        """Every column of the domain's own table that the catalog refers to."""
        own = {self.code, self.title, *self.identity}
        own |= {a.column for a in self.attributes.values() if not a.join}
        own |= {s.column for s in self.subtypes.values()} | {c for v in self.views.values() for c in v.inputs}
        own |= {e.base_key for e in self.enrichments.values()}
        return own | {x for x in (self.sale.column, self.guard and self.guard.column, self.class_column) if x}


class Catalog:
    """Domains by name, and the check that tables have what they refer to."""

    def __init__(self, domains: Iterable[Domain]):
        self.domains = {d.name: d for d in domains}

    def __getitem__(self, name: str) -> Domain:
        if name not in self.domains:
            raise RequestError(f"unknown domain: {name!r}")
        return self.domains[name]

    def missing(self, tables: dict[str, DataFrame], domains: Iterable[str] | None = None) -> list[str]:
        """All columns and tables that the catalog refers to and the tables lack."""
        out = []
        for name in domains or self.domains:
            d = self[name]
            wanted = {d.table: d.columns()}
            for alias, e in d.enrichments.items():
                given = {a.column for a in d.attributes.values() if a.join == alias}
                wanted.setdefault(e.table, set()).update(given | {e.key})
            for table, columns in wanted.items():
                have = set(tables[table].columns) if table in tables else None
                out += [f"table {table}"] if have is None else [f"{table}.{c}" for c in sorted(columns - have)]
        return sorted(set(out))

    def assert_contract(self, tables: dict[str, DataFrame], domains: Iterable[str] | None = None) -> None:
        if gone := self.missing(tables, domains):
            raise ContractError("the catalog refers to what isn't there: " + ", ".join(gone))
