"""A structured request over one domain to a lazy DataFrame with lineage.

Rules apply in a fixed order and fail closed: an empty value, an unknown category, a range over text or an unknown
subtype is an error. Whatever was tested or sorted by is projected too, so that a result can be audited.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.functions import literals
from lattica.functions.text import ends_in_class, organisation_variants, plain_organisation, squeeze, unspaced
from lattica.functions.values import guarded_number, rank_on, zero_as_null
from lattica.plans.catalog import Attribute, Catalog, Domain

# Labels of audit columns, and words for true and false.
TESTED, SORTED, AS_OF = "조건근거({})", "정렬근거({})", "출처기준일({})"
TRUE_WORDS = ("true", "1", "y", "yes", "가능", "참")
FALSE_WORDS = ("false", "0", "n", "no", "불가", "거짓")
COMPARISONS = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__", ">": "__gt__", "<": "__lt__", "neq": "__ne__"}


@dataclass
class Compiled:
    """`rows` is lazy; `lineage` says for each output column what it is; `notes` are assumptions made."""

    domain: str
    rows: DataFrame
    lineage: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)


class Compiler:
    def __init__(self, catalog: Catalog, tables: dict[str, DataFrame], described: dict[str, dict[str, str]] | None = None, ontology=None):
        self.catalog, self.tables, self.described, self.ontology = catalog, tables, described or {}, ontology

    # --- columns

    def attribute(self, domain: Domain, concept: str) -> Attribute:
        if view := domain.view(concept):
            raise RequestError(f"{view[0]} is shown, it can't be filtered or sorted by")
        return domain.resolve(concept, self.described.get(domain.name))

    @staticmethod
    def column(a: Attribute) -> Column:
        return F.col(f"{a.join or 'base'}.{a.column}")

    def typed(self, a: Attribute, domain: Domain) -> Column:
        """A column as its kind compares and sorts; a stored number needs no parsing and stays fit for pushdown."""
        c = self.column(a)
        if a.kind in ("numeric", "date", "boolean"):
            c = c if self.numeric(a, domain) else guarded_number(c)
            return zero_as_null(c) if a.zero_missing else c
        return c

    def numeric(self, a: Attribute, domain: Domain) -> str | None:
        """The stored type of a column if it is a number."""
        table = self.tables[domain.enrichments[a.join].table if a.join else domain.table]
        kind = dict(table.dtypes).get(a.column, "string")
        return kind if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal") else None

    def sorting(self, a: Attribute, domain: Domain) -> Column:
        if a.kind == "ordinal":
            return rank_on(self.column(a), list(a.values))
        if a.kind in ("numeric", "date"):
            return self.typed(a, domain)
        raise RequestError(f"{a.name} has no order to sort by")

    # --- predicates

    def predicate(self, a: Attribute, operator: str, value: object, upper: object = None, domain: Domain | None = None) -> Column:
        c = self.column(a)
        if value is None or (isinstance(value, (str, list, tuple)) and not value) or not str(value).strip():
            raise RequestError(f"{a.name}: a condition without a value")
        if self.ontology and domain and operator in ("eq", "ne", "neq") and (labels := self._spellings(a, value, domain)):
            return c.isin(labels) if operator == "eq" else ~c.isin(labels)
        if a.kind in ("flag", "boolean") or set(a.values) == {"Y", "N"}:
            if (found := self._flag(a, c, operator, value)) is not None:
                return found
        if operator == "in":
            values = list(value) if isinstance(value, (list, tuple, set)) else str(value).split(",")
            values = [str(v).strip() for v in values]
            if not all(values):
                raise RequestError(f"{a.name}: an empty value in a list")
            return c.cast("string").isin(values)
        if a.kind == "categorical" and a.values and operator in ("eq", "ne", "neq"):
            same = [v for v in a.values if squeeze(v) == squeeze(value)]
            if len(same) != 1:
                raise RequestError(f"{a.name}: {value!r} is not one of {list(a.values)}")
            mark = domain.subtype(same[0]) if domain else None
            if mark and mark.operator == "contains" and mark.column == a.column:  # a mark within the title, not the title itself
                return c.contains(mark.value) if operator == "eq" else ~c.contains(mark.value)
            return c == same[0] if operator == "eq" else c != same[0]
        if a.kind == "ordinal":
            labels = literals.on_scale(list(a.values), {"neq": "ne"}.get(operator, operator), value, upper)
            return c.isin(labels) if labels else F.lit(False)
        if a.organisation:
            if operator not in ("eq", "contains"):
                raise RequestError(f"{a.name}: names of organisations are equal or contained")
            own = plain_organisation(c)
            names = {squeeze(v).replace("주식회사", "").replace("(주)", "").replace("㈜", "") for v in organisation_variants(value)}
            return reduce(or_, [own.contains(n) if operator == "contains" else own == n for n in sorted(names)])
        if operator == "contains":
            return unspaced(c.cast("string")).contains(str(value).replace(" ", "").lower())
        if a.kind in ("numeric", "date"):
            kind, own = self.numeric(a, domain), self.typed(a, domain)

            def literal(v):
                if a.kind == "date":
                    return int(literals.day(v))
                v = literals.number(v, a.unit)
                return float(v) if kind in ("double", "float") else int(v) if kind and v == v.to_integral_value() else v

            if operator == "between":
                if upper is None or not str(upper).strip():
                    raise RequestError(f"{a.name}: a range without an upper end")
                return own.between(F.lit(literal(value)), F.lit(literal(upper)))
            if operator in COMPARISONS:
                return getattr(own, COMPARISONS[operator])(F.lit(literal(value)))
        elif operator in ("eq", "ne", "neq"):
            return getattr(c, COMPARISONS[operator])(str(value))
        elif operator in COMPARISONS or operator == "between":
            raise RequestError(f"{a.name}: text has no order")
        raise RequestError(f"{a.name}: unknown operator {operator!r}")

    def _spellings(self, a: Attribute, value: object, domain: Domain) -> list[str]:
        """All source spellings of the one individual that a value names on the column's ontology axis; none if the axis
        knows no such label. A label of several individuals is an error: which one is meant can't be told."""
        axis = next((x for v in domain.views.values() if v.kind == "classification" for c, x in v.axes if c == a.column), None)
        return self.ontology.source_values(axis, str(value)) if axis and self.ontology.named(axis, str(value)) else []

    @staticmethod
    def _flag(a: Attribute, c: Column, operator: str, value: object) -> Column | None:
        """Equality with the stored code; `ne` asks for the other known code, so neither null nor a stray code is taken for it."""
        word = squeeze(value)
        yes, no = (a.true, a.false) if a.kind in ("flag", "boolean") else ("Y", "N")
        truth = True if word in (*TRUE_WORDS, *map(squeeze, a.true_words)) else False if word in (*FALSE_WORDS, *map(squeeze, a.false_words)) else None
        if a.kind == "flag":
            if operator != "eq" or truth is None:
                raise RequestError(f"{a.name}: a flag is true or false")
            return c.cast("string") == yes if truth else c.cast("string") != yes
        if truth is None:
            return None
        if operator not in ("eq", "ne", "neq"):
            raise RequestError(f"{a.name}: true and false have no order")
        code = yes if truth == (operator == "eq") else no
        return guarded_number(c) == F.lit(int(code)) if a.kind == "boolean" else F.trim(c) == code

    def identity(self, d: Domain, base: DataFrame, name: str) -> Column:
        """Rows that a name identifies: equal in an identity column; only if no row at all is, those whose title contains it.

        Whether any row is equal is a subquery of the plan, no job before it. On a stream nobody can know, so a title that
        contains the name will do.
        """
        if not str(name).strip():
            raise RequestError("an entity without a name")
        needle = str(name).replace(" ", "").lower()
        inside = F.coalesce(unspaced(F.col(f"base.{d.title}").cast("string")).contains(needle), F.lit(False))
        if base.isStreaming:
            return inside
        equal = reduce(or_, [F.coalesce(unspaced(F.col(f"base.{c}").cast("string")) == needle, F.lit(False)) for c in d.identity])
        own = base.select(*[F.col(c).alias(f"_probe_{i}") for i, c in enumerate(d.identity)])
        anyone = own.filter(reduce(or_, [unspaced(F.col(c).cast("string")) == needle for c in own.columns])).select(F.lit(1)).exists()
        return equal | (~anyone & inside)

    # --- requests

    def compile(self, request: dict, merge: bool = False, limit: bool = True) -> Compiled:
        """Rows of one domain. With `merge` the common shape code, name, domain, sort_value for a union of domains.

        Whatever in conditions, kinds and sort can't be resolved blocks, all of it named in one error; a field to show that
        can't be is left out with a note.

        A request holds domain, and any of: entity, subtypes, conditions (attribute, operator, value, value_2, group, domain),
        fields, sort (attribute, order, limit), on_sale, class_suffixes.
        """
        d = self.catalog[request["domain"]]
        base = self.tables[d.table]
        notes, terms, groups, tested, joins, touched = [], [], {}, [], set(), set()

        def use(a: Attribute) -> Attribute:
            if a.join:
                joins.add(a.join)
            touched.add(a.column)
            return a

        problems: list[str] = []
        for condition in request.get("conditions", ()):
            if condition.get("domain") not in (None, "", d.name):
                continue  # it is another domain's
            try:
                a = use(self.attribute(d, condition["attribute"]))
                term = self.predicate(a, condition.get("operator", "eq"), condition.get("value"), condition.get("value_2"), d)
            except RequestError as e:
                problems.append(str(e))
                continue
            tested.append(a)
            if a.currency and str(condition.get("value", "")).strip().lower().endswith(literals.DOLLAR_NAMES[0::2]):
                terms.append(F.col(f"base.{a.currency[0]}") == a.currency[1])
                tested.append(Attribute(a.currency[0], a.currency[0]))
                notes.append(f"{a.name}: an amount in {a.currency[1]} is compared with rows in that currency; nothing is converted")
            groups.setdefault(condition["group"], []).append(term) if condition.get("group") else terms.append(term)
        terms += [reduce(or_, g) for g in groups.values()]
        for value in request.get("subtypes", ()):
            rule = d.subtype(value)
            if rule is None:
                if not request.get("entity"):
                    problems.append(f"{d.name}: unknown kind {value!r}")
                    continue
                notes.append(f"{d.name}: kind {value!r} couldn't be verified for a named product")
                continue
            own = next((a for a in d.attributes.values() if a.column == rule.column), Attribute(value, rule.column))
            if rule.operator == "contains":
                terms.append(F.col(f"base.{rule.column}").contains(rule.value))
            elif own.kind in ("numeric", "date"):
                terms.append(self.predicate(own, rule.operator, rule.value, domain=d))
            else:
                terms.append(F.trim(F.col(f"base.{rule.column}")) == rule.value)
            tested.append(use(own))
        if request.get("on_sale"):
            if d.sale.column:
                terms.append(F.col(f"base.{d.sale.column}").cast("string") == d.sale.value)
                tested.append(Attribute(d.sale.column, d.sale.column))
            notes.append(f"{d.name}: {d.sale.reason}")
        if request.get("entity"):
            terms.append(self.identity(d, base, request["entity"]))
        if suffixes := request.get("class_suffixes"):
            if not d.class_column or not request.get("entity"):
                raise RequestError("class suffixes need a fund's name")
            terms.append(reduce(or_, [ends_in_class(F.col(f"base.{d.class_column}"), s) for s in suffixes]))
        if d.guard and d.guard.column not in touched:
            kind = d.guard.other if any(d.guard.other in str(s).upper() for s in request.get("subtypes", ())) else d.guard.default
            terms.append(F.col(f"base.{d.guard.column}") == kind)
            notes.append(f"{d.name}: only {kind}")

        sort, order, sort_value = request.get("sort"), [], None
        if sort and sort.get("domains") and d.name not in sort["domains"]:
            sort = None
        if sort:
            try:
                a = use(self.attribute(d, sort["attribute"]))
                sort_value, direction = self.sorting(a, d), str(sort.get("order") or "asc").lower()
                if direction not in ("asc", "desc"):
                    raise RequestError(f"sorting is asc or desc, not {direction!r}")
            except RequestError as e:
                problems.append(str(e))
        if problems:
            raise RequestError("; ".join(dict.fromkeys(problems)))
        if sort:
            terms.append(sort_value.isNotNull())
            order = [getattr(sort_value, f"{direction}_nulls_last")(), F.col(f"base.{d.code}").asc_nulls_last()]

        outputs: list[tuple[str, Attribute]] = []
        if not merge:
            for concept in [f for x in request.get("fields", ()) for f in d.fields(x)]:
                if view := d.view(concept):
                    outputs += [(c, Attribute(c, c)) for c in view[1].inputs]
                else:
                    try:
                        outputs.append((concept, use(self.attribute(d, concept))))
                    except RequestError as e:
                        notes.append(f"not shown: {e}")
            outputs = [("name", Attribute("name", d.title)), ("code", Attribute("code", d.code)), *outputs]
            if sort:
                outputs.append((SORTED.format(sort["attribute"]), a))
            outputs += [(TESTED.format(t.name), t) for t in tested]
            have = set(base.columns)
            for c in sorted({c for _, o in outputs for c in o.as_of}):
                if c in have:
                    outputs.append((AS_OF.format(c), Attribute(c, c)))
                else:
                    notes.append(f"{d.name}: no column {c!r} to date values by")

        self.catalog.assert_contract(self.tables, [d.name])
        rows = base.alias("base")
        for alias in sorted(joins):
            e = d.enrichments[alias]
            rows = rows.join(self.tables[e.table].alias(alias), F.col(f"base.{e.base_key}") == F.col(f"{alias}.{e.key}"), "left")
        if terms:
            rows = rows.filter(reduce(and_, terms))
        lineage = []
        if merge:
            if sort_value is None:
                raise RequestError(f"{d.name}: a union is ranked by something")
            return Compiled(d.name, rows.select(F.col(f"base.{d.code}").cast("string").alias("code"), F.col(f"base.{d.title}").cast("string").alias("name"), F.lit(d.name).alias("domain"), sort_value.cast("double").alias("sort_value")), [], notes, [])
        seen, selected = set(), []
        for label, o in outputs:
            if label in seen:
                continue
            seen.add(label)
            about = {"attribute": o.name, "column": f"{d.enrichments[o.join].table if o.join else d.table}.{o.column}", "unit": o.unit or "", "as_of": list(o.as_of), "zero_missing": o.zero_missing}
            selected.append(self.column(o).alias(label, metadata=about))
            lineage.append({"key": label, **about})
        if order:
            rows = rows.orderBy(*order)
            n = literals.row_limit(sort.get("limit")) if limit else None
            rows = rows.limit(n) if n else rows
        return Compiled(d.name, rows.select(*selected), lineage, notes, order)
