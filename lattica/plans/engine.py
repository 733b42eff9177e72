"""Requests end to end: a route's steps over tables, a graph and vectors, then evidence by field, previews and a record.

Rows stay lazy. What has to be decided from data before the next step (whether an entity is one, whether a step has rows
and evidence for each, whether a search has hits) takes one job a decision.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.errors import RequestError
from lattica.functions import literals
from lattica.functions.text import organisation_key
from lattica.functions.values import guarded_number
from lattica.operators import evidence, federate, joins, vector, views
from lattica.operators.graph import Entity, Graph, generated_plan, ready_plan, reviewed_security
from lattica.plans import wording
from lattica.plans.catalog import Catalog, Domain
from lattica.plans.compile import COMPARISONS, Compiler
from lattica.plans.planner import Route, Step, plan, ready
from lattica.session import shared_dir

#: Core evidence of a relation: when, and from where.
CORE = ("_as_of", "_source")
SHOWN = 20


@dataclass
class Outcome:
    """What a step gave: rows (lazy) or the reason why there are none.

    `codes` and `names` are what it hands on, whole; `count` is known where a decision needed it; `shown` is how many of
    the rows a plan's limit lets through, if that is fewer.
    """

    step: Step
    status: str
    rows: DataFrame | None = None
    codes: DataFrame | None = None
    names: DataFrame | None = None
    lineage: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    count: int | None = None
    shown: int | None = None


@dataclass
class Answer:
    """All of a request: its route and outcomes, rows of every step, evidence by field, a fair preview, and the record."""

    route: Route
    outcomes: dict[str, Outcome]
    rows: DataFrame | None
    contracts: dict[str, DataFrame]
    preview: DataFrame | None
    abstained: list[str]
    context: str
    record: str


class Engine:
    """`graph` may be a callable that gives the first store that answers (`sources.stores.first_available`).

    For documents: `chunks` (embedded), `bridge` (document_id, product_id), `embed` (text to vector), `states` (coverage by
    product), `documents` (for policy questions), `hints` (words to sections).
    """

    def __init__(self, catalog: Catalog, tables: dict[str, DataFrame], graph: Graph | None = None, chunks: DataFrame | None = None, bridge: DataFrame | None = None, embed=None, *, states: DataFrame | None = None, documents: DataFrame | None = None, hints: dict[str, str] | None = None, ontology=None, generator=None, described: dict | None = None, floor: float = vector.FLOOR):
        self.compiler, self.catalog, self.ontology = Compiler(catalog, tables, described, ontology), catalog, ontology
        self._graph_of, self.chunks, self.bridge, self.embed = graph, chunks, bridge, embed
        self.states, self.documents, self.hints, self.generator, self.floor = states, documents, hints or {}, generator, floor

    @property
    def graph(self) -> Graph | None:
        if callable(self._graph_of):
            self._graph_of = self._graph_of()
        return self._graph_of

    def run(self, intent: dict, today: date | None = None, question: str = "") -> tuple[Route, dict[str, Outcome], DataFrame | None]:
        """The route, each step's outcome, and the rows of all table and graph steps together (None if there are none)."""
        route, done = plan(intent, today, question), {}
        while todo := ready(route.steps, set(done)):
            for step in todo:
                try:
                    done[step.id] = {"tables": self._tables, "graph": self._graph, "vectors": self._vectors}[step.engine](step, route, done)
                except RequestError as e:
                    done[step.id] = Outcome(step, "invalid", notes=[str(e)])
        merged = self._merged(route, done)
        parts = [federate.tagged(o.rows, o.step.domain or o.step.engine, o.step.id) for o in done.values() if o.status == "ok" and o.rows is not None and o.step.engine != "vectors" and o.step.id not in route.merged]
        return route, done, federate.union_all([*parts, *([merged] if merged is not None else [])]) if parts or merged is not None else None

    # --- handing on

    def _upstream(self, step: Step, route: Route, done: dict[str, Outcome]) -> tuple[str, list[list[tuple[str, DataFrame]]]]:
        """What graph steps before a step hand on, by group, as (kind, list), and whether it may go on.

        Lists are whole, so a ranking over them is one over all candidates.
        """
        names = [d for d in step.depends_on if d.startswith("graph_")]
        groups = [[n for n in names if n in g] for g in route.alternatives]
        groups = [g for g in groups if g] + [[n] for n in names if not any(n in g for g in route.alternatives)]
        lists = []
        for g in groups:
            of = [done[n] for n in g]
            good = [o for o in of if o.status == "ok"]
            if any(o.status not in ("ok", "empty") for o in of):  # an alternative that isn't known may hold what is missing
                return "blocked_upstream", []
            if not good:
                return "blocked_empty", []
            have = [("codes", o.codes) if o.codes is not None else ("names", o.names) for o in good if o.codes is not None or o.names is not None]
            if not have:
                return "blocked_upstream", []
            lists.append(have)
        return "ok", lists

    @staticmethod
    def _issuer(d: Domain) -> str | None:
        """The domain's own column of organisations, by which names of companies restrict it."""
        return next((a.column for a in d.attributes.values() if a.organisation and not a.join), None)

    def _restricted(self, d: Domain, lists: list[list[tuple[str, DataFrame]]]) -> DataFrame:
        rows, issuer = self.compiler.tables[d.table], self._issuer(d)
        for group in lists:
            codes, names = [x for k, x in group if k == "codes"], [x for k, x in group if k == "names"]
            if names and not issuer:
                raise RequestError(f"{d.name}: names of companies restrict nothing here")
            if codes and names:
                by_name = federate.handoff(rows, organisation_key(F.col(issuer)), [names]).select(F.col(d.code).cast("string").alias("code"))
                rows = federate.handoff(rows, d.code, [[*codes, by_name]])
            else:
                rows = federate.handoff(rows, d.code if codes else organisation_key(F.col(issuer)), [codes or names])
        return rows

    # --- steps

    def _tables(self, step: Step, route: Route, done: dict[str, Outcome]) -> Outcome:
        if step.payload.get("lookup"):
            tables = {d.name: (self.compiler.tables[d.table], d.code, d.title) for d in self.catalog.domains.values() if d.table in self.compiler.tables}
            found = joins.identity_probe(tables, [step.payload["entity"]])
            return Outcome(step, "ok", None, found.select("code"), notes=[f"lookup of {step.payload['entity']!r}"])
        status, lists = self._upstream(step, route, done)
        if status != "ok":
            return Outcome(step, status)
        d = self.catalog[step.domain]
        compiler = self.compiler
        if lists:
            compiler = Compiler(self.catalog, {**compiler.tables, d.table: self._restricted(d, lists)}, compiler.described, compiler.ontology)
        request = dict(step.payload)
        entities = request.pop("entities", None) or [request.pop("entity", None)]
        merge = step.id in route.merged
        every = [compiler.compile({**request, **({"entity": e} if e else {})}, merge=merge) for e in entities]
        rows = every[0].rows if len(every) == 1 else federate.union_all([f.rows for f in every]).distinct()
        if not merge:
            rows = self._viewed(d, rows, request)
        notes = list(dict.fromkeys(n for f in every for n in f.notes))
        return Outcome(step, "ok", rows, rows.select(F.col("code").cast("string").alias("code")), None, every[0].lineage, notes)

    def _viewed(self, d: Domain, rows: DataFrame, request: dict) -> DataFrame:
        """`rows` with the output views among the requested fields; a view never filters."""
        for concept in request.get("fields", ()):
            if found := d.view(concept):
                name, view = found
                scale = next((list(a.values) for a in d.attributes.values() if a.kind == "ordinal"), [])
                labels = self.ontology.label_table(rows.sparkSession) if self.ontology and view.kind in ("classification", "rating") else None
                rows = views.derive(rows, name, view, scale, labels, "code")
        return rows

    def _merged(self, route: Route, done: dict[str, Outcome]) -> DataFrame | None:
        """The ranked union of the merged steps, then the requested fields of the rows that are left."""
        parts = [done[s] for s in route.merged if done[s].status == "ok"]
        if not parts:
            return None
        sort = parts[0].step.payload["sort"]
        order, limit = sort.get("order", "asc"), literals.row_limit(sort.get("limit")) or SHOWN
        details = []
        for o in parts:
            if fields := [f for f in o.step.payload.get("fields", ()) if self.catalog[o.step.domain].knows(f)]:
                own = self.compiler.compile({"domain": o.step.domain, "fields": fields, "subtypes": o.step.payload.get("subtypes", ())}, limit=False)
                details.append(own.rows.select(F.lit(o.step.domain).alias("domain"), F.col("code").cast("string").alias("code"), *[f"`{f}`" for f in dict.fromkeys(x for f in fields for x in self.catalog[o.step.domain].fields(f)) if f in own.rows.columns]))
        rows = [o.rows for o in parts]
        return federate.merge_rank_hydrate(rows, order, limit, federate.union_all(details)) if details else federate.merge_rank(rows, order, limit)

    def _graph(self, step: Step, route: Route, done: dict[str, Outcome]) -> Outcome:
        if self.graph is None:
            return Outcome(step, "unavailable")
        links = step.payload["relations"]
        role, text = links[0].get("entity_role") or "product", links[0]["object_entity"]
        looked_up = [r.code for d in step.depends_on if done[d].codes is not None for r in done[d].codes.distinct().limit(2).collect()]
        if len(looked_up) > 1:  # two products of that name: neither is meant surely
            return Outcome(step, "abstain_entity_ambiguous", notes=[f"{text} names {', '.join(looked_up)}"])
        if role == "theme":
            return self._decided(step, self.graph.theme_members(links[0].get("facets") or [text]).orderBy("code"), [], None, "code")
        security = reviewed_security(text)
        if security and ready_plan([links[0]["relation"]], "", "Security"):
            label, codes = security
            return self._decided(step, self.graph.holders_of(codes, label), [], None, "etf_code", [f"{text}: known under {len(codes)} codes"])
        entity, tried = self.graph.seed([(x, role) for x in (*looked_up, text)])  # a lookup's code is surer than a name
        if entity.status != "resolved":
            return Outcome(step, "abstain_entity_" + entity.status, notes=[f"{t} as {c}: {s}" for t, c, s in tried])
        chosen = ready_plan([x["relation"] for x in links], str(links[-1].get("subject_domain") or ""), entity.cls) or self._generated(entity, links)
        if chosen is None:
            return Outcome(step, "abstain_schema_unresolved")
        wanted = step.payload.get("constraints", ())
        where = (lambda rows: self._constraints(wanted, rows)) if wanted else None
        rows, held = self.graph.run(chosen, entity, capped=False, where=where)
        codes = next((x.alias for x in chosen.outputs if x.property == "productCode"), None)
        notes = [f"evidence: {', '.join(held)}" if held else "; ".join(f"{p} from {t}.{c}" for p, t, c in self.graph.sources(chosen))]
        out = self._decided(step, rows, [c for c in held if c.endswith(CORE)], chosen.limit, codes, notes)
        if out.status == "ok":
            rows = out.rows
            named = [x.alias for x in chosen.outputs if x.property == "organizationName"]
            if named and not codes:
                every = [F.col(a) for a in named] + ([F.lit(text)] if any(x.get("with_root") for x in links) else [])
                out.names = rows.select(F.explode(F.array(*every)).alias("name")).select(organisation_key(F.col("name")).alias("code"))
            out.rows = rows.orderBy(*[x.alias for x in chosen.outputs]).limit(chosen.limit)
        return out

    def _generated(self, entity: Entity, links: list[dict]):
        """A plan from the generator, within the part of the ontology that the relations' words reach."""
        if self.generator is None:
            return None
        fragment = self.graph.ontology.fragment(" ".join(str(x["relation"]) for x in links), [self.graph.uri(entity.cls)])
        return generated_plan(self.graph, entity, fragment, self.generator)

    def _decided(self, step: Step, rows: DataFrame, core: list[str], limit: int | None, codes: str | None, notes: list[str] | None = None) -> Outcome:
        """A graph step's outcome: one job counts its rows and what evidence they lack; one gap voids the step.

        Rows are kept in the shared folder, since the gate, what is handed on and what is shown all read them.
        """
        shared_dir(rows.sparkSession)
        rows = rows.checkpoint()
        gate = evidence.evidence_gate(rows, core).first()
        status = "empty" if not gate["rows"] else gate.status if core else "ok"
        if status != "ok":
            return Outcome(step, status, notes=[*(notes or []), *([f"{gate.missing} of {gate['rows']} rows lack {', '.join(core)}"] if gate["rows"] else [])], count=gate["rows"])
        handed = rows.select(F.col(codes).cast("string").alias("code")).filter("code is not null") if codes else None
        cut = limit if limit and gate["rows"] > limit else None
        return Outcome(step, "ok", rows, handed, None, [], [*(notes or []), *([f"{cut} of {gate['rows']} rows are shown; all are handed on"] if cut else [])], gate["rows"], cut)

    @classmethod
    def _constraints(cls, conditions: list[dict], rows: DataFrame) -> Column:
        out = F.lit(True)
        for c in conditions:
            out = out & cls._constraint(c, rows)
        return out

    @staticmethod
    def _constraint(condition: dict, rows: DataFrame) -> Column:
        """A condition on a relation, over the output or evidence column it names: numbers as numbers, else as text."""
        name = condition["attribute"]
        if name not in rows.columns:
            raise RequestError(f"the relation has no {name!r}")
        operator = COMPARISONS.get(condition.get("operator", "eq"))
        if operator is None:
            raise RequestError(f"unknown operator {condition.get('operator')!r}")
        try:
            return getattr(guarded_number(F.col(name)), operator)(F.lit(literals.number(condition["value"], "percent")))
        except RequestError:
            return getattr(F.col(name), operator)(str(condition["value"]))

    def _vectors(self, step: Step, route: Route, done: dict[str, Outcome]) -> Outcome:
        if step.payload.get("policy"):
            return self._policy(step)
        if self.chunks is None or self.embed is None:
            return Outcome(step, "abstain_vector_unavailable")
        before = [done[d] for d in step.depends_on if not done[d].step.payload.get("lookup")]
        codes = [o.codes for o in before if o.status == "ok" and o.codes is not None]
        if before and not codes:  # documents of other products are no substitute
            return Outcome(step, "unresolved_product_scope")
        chunks, scoped, histogram = self.chunks, None, {}
        if codes and self.bridge is not None:
            scope = federate.union_all(codes).withColumnRenamed("code", "product_id")
            known = self.bridge.select(F.col("product_id").cast("string").alias("product_id")).distinct().join(scope, "product_id", "left_semi")
            covered = vector.coverage(known, self.states) if self.states is not None else known.withColumn("status", F.lit("matched"))
            histogram = {r.status: r.n for r in vector.coverage_histogram(covered).collect()}
            scoped = sum(histogram.values())
            if not scoped:
                return Outcome(step, "no_product_match")
            chunks = vector.in_scope(chunks, self.bridge.withColumn("product_id", F.col("product_id").cast("string")), scope)
        topics = step.payload["topics"]
        sections = vector.sections_for([*topics, *step.payload.get("fields", ())], self.hints) or None
        raw = vector.search(chunks, [self.embed(t) for t in topics], vector.MOST_HITS, self.bridge, sections, floor=-1.0)
        found = raw.groupBy("section_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("score") >= self.floor, 1)).alias("good")).collect()  # a row a section of 60 hits at most
        good = sum(r.good for r in found)
        status = vector.search_status(scoped, histogram, good, sum(r.n for r in found), bool(sections))
        gone = [s for s in sections or () if not any(r.section_type == s and r.good for r in found)]
        notes = [*([f"{scoped} products in scope, {histogram.get('matched', 0)} with documents"] if scoped is not None else []), *([f"no hit in {', '.join(gone)}"] if gone else [])]
        return Outcome(step, status, raw.filter(F.col("score") >= self.floor) if status == "ok" else None, notes=notes, count=good)

    def _policy(self, step: Step) -> Outcome:
        """Official documents on a subject, by its words: products have no part in it."""
        if self.documents is None or self.chunks is None:
            return Outcome(step, "abstain_vector_unavailable")
        parts = [vector.phrase_search(self.documents, self.chunks, t, step.payload["kinds"]) for t in step.payload["subjects"]]
        rows = federate.union_all(parts).distinct() if parts else None
        n = rows.count() if rows is not None else 0  # MOST_HITS rows a subject
        return Outcome(step, "ok" if n else "no_official_document", rows, count=n)

    # --- answers

    def answer(self, intent: dict, question: str = "", today: date | None = None, question_id: str = "", shown: int = SHOWN) -> Answer:
        """A whole request: what the question's words settle, the steps, evidence by field for each table step, a preview, a record."""
        today = today or date.today()
        intent = wording.restored(intent, question, today) if question else intent
        route, done, rows = self.run(intent, today, question)
        contracts = {o.step.id: evidence.contract(o.rows, "code", self._asked(o)) for o in done.values() if o.status == "ok" and o.step.engine == "tables" and o.rows is not None and o.step.id not in route.merged}
        gone = abstentions(route, done)
        preview, texts, counted = None, [], {}
        if rows is not None:
            own = rows if "_domain" in rows.columns else rows.withColumn("_domain", F.lit("merged"))
            own = own.withColumn("_domain", F.coalesce("_domain", F.lit("merged")))
            first = [F.col(c) for c in own.columns if c in ("sort_value",)]
            preview = federate.fair_preview(own, "_domain", [*[c.desc_nulls_last() for c in first], *[F.col(f"`{c}`") for c in own.columns if not c.startswith("_") and c != "sort_value" and dict(own.dtypes)[c] in ("string", "bigint", "int", "double")]], shown)
            counted = {r["_domain"]: r.n for r in own.groupBy("_domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
            texts = [evidence.line(federate.public(preview), r) for r in federate.public(preview).collect()]  # `shown` rows, one a domain at least
        for o in done.values():  # documents by their quotes: MOST_HITS hits a topic or subject
            if o.step.engine == "vectors" and o.rows is not None and "chunk_text" in o.rows.columns:
                scored = o.rows if "score" in o.rows.columns else o.rows.withColumn("score", F.lit(0.0))
                quoted = vector.quotes(scored, "chunk_text").orderBy(F.desc("score"), "chunk_id").select("document_id", "quote").collect()
                texts += [f"[{r.document_id}] {r.quote}" for r in quoted if r.quote]
        steps = [{"dataset": o.step.domain or o.step.engine, "as_of": today.isoformat(), "status": o.status, "rows": o.count if o.count is not None else counted.get(o.step.domain or o.step.engine, counted.get("merged", 0))} for o in done.values()]
        context = evidence.context(steps)
        text = "\n".join([*texts, *gone]) or "no answer"
        trace = [*route.notes, *[f"{o.step.id}: {n}" for o in done.values() for n in o.notes]]
        return Answer(route, done, rows, contracts, preview, gone, context, evidence.answer(question_id, question, context, trace, text))

    def _asked(self, o: Outcome) -> list[dict]:
        """The requested fields of a table step, each with its column in the rows; fields without one are unmapped."""
        d, have = self.catalog[o.step.domain], set(o.rows.columns)
        fields = [f for x in o.step.payload.get("fields", ()) for f in d.fields(x)] or [c for c in o.rows.columns if c not in ("code",)]
        units = {x["key"]: x for x in o.lineage}
        out = []
        for f in fields:
            about = units.get(f, {})
            view = d.view(f)
            column = f if f in have else None
            out.append({"field": f, "column": None if view else column if column or not d.knows(f) else f, "rule": "0 = 값 없음" if about.get("zero_missing") else "", "unit": about.get("unit", "")} | ({"view": view[0]} if view and view[0] in have else {}))
        return out


def abstentions(route: Route, done: dict[str, Outcome]) -> list[str]:
    """Why a request, or a part of it, has no answer: blockers first, then each step that gave none."""
    return list(route.blockers) + [f"{o.step.id}: {o.status}" + (f" ({'; '.join(o.notes)})" if o.notes else "") for o in done.values() if o.status != "ok"]


def rows_shown(steps: int, budget: int = SHOWN) -> int:
    """How many rows each of so many steps may show."""
    return max(1, budget // max(steps, 1))
