"""Planning, requests end to end, sources, search statuses, views and evidence."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lattica.catalogue_queries import CATALOG, NAMESPACE, TYPE, fixture_graph
from lattica.errors import ContractError, RequestError, Truncated
from lattica.operators import evidence, federate, joins, vector, views
from lattica.operators.graph import Graph
from lattica.plans import planner
from lattica.plans.engine import Engine
from lattica.session import table
from lattica.sources import io, stores

TODAY = date(2026, 8, 24)


# --- planning


def test_relations_in_order():
    a, b, c = {"id": "a", "object_entity": "X"}, {"id": "b", "object_ref": "a"}, {"id": "c", "object_ref": "b"}
    assert [r["id"] for r in planner.relation_order([c, b, a])] == ["a", "b", "c"]
    assert [r["id"] for r in planner.chain([c, b, a], "c")] == ["a", "b", "c"]
    assert planner.terminal_relations([a, b, c]) == ([c], ["a", "b"])
    for bad in ([{"id": "a", "object_ref": "b"}, {"id": "b", "object_ref": "a"}], [{"id": "a", "object_ref": "z"}], [a, a]):
        with pytest.raises(RequestError):
            planner.relation_order(bad)


def test_steps_and_waves():
    intent = {
        "product_domain": [{"domain": "국내ETF", "subtype": "레버리지"}, {"domain": "국내ETF", "subtype": ["액티브"]}, {"domain": "해외ETF"}],
        "relations": [{"id": "r", "relation": "holds", "object_entity": "X", "subject_domain": "etf", "entity_role": "company"}],
        "conditions": [{"attribute": "AUM", "operator": "이상", "value": " 1조원 "}, {"attribute": "보수", "operator": "<", "value": "1", "domain": "해외ETF"}],
        "sort": {"attribute": "1일수익률", "order": "내림차순", "limit": 5}, "output_requirements": {"narrative_topics": ["전략"], "fields": []},
    }
    route = planner.plan(intent, TODAY)
    assert planner.waves(route.steps) == [["graph_r"], ["tables_국내ETF", "tables_해외ETF"], ["vectors"]]
    assert route.merged == ["tables_국내ETF", "tables_해외ETF"]
    own = next(s for s in route.steps if s.id == "tables_국내ETF").payload
    assert own["subtypes"] == ["레버리지", "액티브"] and own["conditions"] == [{"attribute": "AUM", "operator": "gte", "value": "1조원"}] and own["sort"]["order"] == "desc"
    mixed = planner.plan(intent | {"sort": {"attribute": "AUM", "order": "desc", "limit": 5}}, TODAY)
    assert mixed.merged == [] and any("currencies" in n for n in mixed.notes)


def test_alternatives_chains_and_blockers():
    relations = [{"id": "d", "relation": "holds", "object_entity": "X", "subject_domain": "etf"}, {"id": "s", "relation": "자회사", "object_entity": "X", "subject_domain": "company"}, {"id": "e", "relation": "holds", "object_ref": "s", "subject_domain": "etf"}]
    route = planner.plan({"product_domain": [{"domain": "국내ETF"}], "relations": relations, "any_relation": True}, TODAY)
    assert route.alternatives == [["graph_d", "graph_e"]] and any("s runs inside" in n for n in route.notes)
    assert planner.plan({"full_years": [2026], "relations": [{"id": "x"}]}, TODAY).blockers == ["the year 2026 isn't over", "relation x has no object"]
    looked = planner.plan({"product_domain": [{"domain": "펀드"}], "relations": [{"id": "q", "relation": "holds", "object_entity": "P", "entity_role": "product", "subject_domain": "펀드"}]}, TODAY)
    assert [s.id for s in looked.steps] == ["lookup_q", "graph_q", "tables_펀드"]
    with pytest.raises(RequestError):
        planner.waves([planner.Step("a", "tables", ["b"]), planner.Step("b", "tables", ["a"])])


# --- requests end to end


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "part", "lineitem", "customer", "supplier")}
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"), F.col("label").cast("string").alias("section_type"), "embedding")
    bridge = tables["lineitem"].select(F.col("l_orderkey").alias("document_id"), F.col("l_orderkey").cast("string").alias("product_id"))
    return Engine(CATALOG, tables, fixture_graph(spark, sf_dir), chunks, bridge, embed=lambda topic: [0.1 * len(topic)] * 64)


def test_tables_after_a_graph(engine):
    intent = {"product_domain": [{"domain": "orders"}], "relations": [{"id": "r", "relation": "holds", "object_entity": "NATION_3", "entity_role": "company", "subject_domain": "etf"}], "conditions": [{"attribute": "priority", "operator": "gte", "value": "2-HIGH"}]}
    intent["relations"][0]["subject_domain"] = "anything"
    route, done, rows = engine.run(intent, TODAY)
    assert done["graph_r"].status == "abstain_schema_unresolved"  # nothing holds anything of that kind
    intent["relations"][0]["subject_domain"] = ""
    route, done, rows = engine.run(intent, TODAY)
    codes = {int(r.code) for r in done["graph_r"].codes.collect()}
    got = [r for r in done["tables_orders"].rows.collect()]
    assert codes and {r.code for r in got} <= codes and all(r["조건근거(priority)"] in ("2-HIGH", "1-URGENT") for r in got)
    assert rows.select("_domain").distinct().count() == 2 and "_domain" not in federate.public(rows).columns


def test_all_holders_are_ranked(spark, engine):
    """300 holders, more than a plan's limit: the best of all of them, not of some."""
    ns = NAMESPACE
    triples = [("c", TYPE, ns + "Company"), ("c", ns + "organizationName", "Big"), ("s", TYPE, ns + "Security"), ("s", ns + "issuedByCompany", "c")]
    for i in range(300):
        triples += [(f"e{i}", TYPE, ns + "ETF"), (f"e{i}", ns + "productCode", str(i)), (f"e{i}", ns + "productShortName", f"E{i}"), (f"e{i}", ns + "hasHolding", f"h{i}"), (f"h{i}", ns + "holdingSecurity", "s"), (f"h{i}", ns + "asOf", "2026-01-01"), (f"h{i}", ns + "sourceId", "x"), (f"h{i}", ns + "weight", str(i))]
    orders = spark.createDataFrame([(i, float(i), "F", "1-URGENT", 1) for i in range(400)], "o_orderkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, o_custkey long")
    own = Engine(CATALOG, {**engine.compiler.tables, "orders": orders}, Graph(spark.createDataFrame(triples, "s string, p string, o string"), engine.graph.ontology))
    intent = {"product_domain": [{"domain": "orders"}], "relations": [{"id": "r", "relation": "holds", "object_entity": "Big", "entity_role": "company"}], "sort": {"attribute": "price", "order": "desc", "limit": 3}}
    _, done, _ = own.run(intent, TODAY)
    assert [r.code for r in done["tables_orders"].rows.collect()] == [299, 298, 297]
    assert (done["graph_r"].count, done["graph_r"].shown, done["graph_r"].rows.count()) == (300, 100, 100)
    undated = Engine(CATALOG, own.compiler.tables, Graph(spark.createDataFrame([t for t in triples if t[:2] != ("h7", ns + "asOf")], "s string, p string, o string"), engine.graph.ontology))
    _, done, _ = undated.run(intent, TODAY)
    assert [o.status for o in done.values()] == ["abstain_evidence_missing", "blocked_upstream"] and "1 of 300" in done["graph_r"].notes[-1]


def test_unknown_entities_and_values_stop_a_step(engine):
    _, done, _ = engine.run({"product_domain": [{"domain": "orders"}], "relations": [{"id": "r", "relation": "holds", "object_entity": "NOWHERE", "entity_role": "company"}]}, TODAY)
    assert done["graph_r"].status == "abstain_entity_not_found" and done["tables_orders"].status == "blocked_upstream"
    _, done, _ = engine.run({"product_domain": [{"domain": "orders"}], "conditions": [{"attribute": "priority", "operator": "eq", "value": "9-LATER"}]}, TODAY)
    assert done["tables_orders"].status == "invalid" and "9-LATER" in done["tables_orders"].notes[0]


def test_merged_domains_and_documents(engine):
    intent = {"product_domain": [{"domain": "customers"}, {"domain": "suppliers"}], "sort": {"attribute": "balance", "order": "desc", "limit": 7}, "output_requirements": {"narrative_topics": ["a", "bb"]}}
    route, done, rows = engine.run(intent, TODAY)
    got = [r.sort_value for r in rows.collect()]
    assert route.merged == ["tables_customers", "tables_suppliers"] and len(got) == 7 and got == sorted(got, reverse=True)
    assert done["vectors"].status == "low_confidence" and done["vectors"].rows is None  # hits, none near enough


# --- federation


def test_handoff_statuses(spark):
    some, none = spark.createDataFrame([("a",), ("b",)], "code string"), spark.createDataFrame([], "code string")
    assert [federate.handoff_status(x, any_, ranked, 2) for x, any_, ranked in (([some, none], True, False), ([some, none], False, False), ([none], True, False), ([some], False, True), ([some], False, False))] == ["ok", "blocked_empty", "blocked_empty", "blocked_truncated", "ok"]
    with pytest.raises(Truncated):
        federate.capped(some, 1)
    assert evidence.counters(some, 2, 1) == {"retrieved_rows": 2, "displayed_rows": 1, "coverage_truncated": True}


def test_unions_of_different_types(spark):
    a, b = spark.createDataFrame([(1, 2.5)], "k int, v double"), spark.createDataFrame([("x", True)], "v string, w boolean")
    assert {tuple(r) for r in federate.union_all([a, b]).collect()} == {(1, "2.5", None), (None, "x", True)}


def test_previews_are_fair(spark):
    df = spark.createDataFrame([(d, i) for d, n in (("a", 100), ("b", 3), ("c", 1)) for i in range(n)], "d string, i int")
    got = federate.fair_preview(df, "d", [F.col("i")], 20).groupBy("d").count().collect()
    assert {r.d: r["count"] for r in got} == {"a": 16, "b": 3, "c": 1}


def test_joins_with_missing_keys(spark):
    a, b = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int"), spark.createDataFrame([(None, "n"), ("x", "m")], "k string, w string")
    assert {(r.v, r.w) for r in joins.keyed(a, b, [], ["k"]).collect()} == {(1, "n"), (2, "m")}
    funds = spark.createDataFrame([("F Class A", "m1", "000"), ("F Class C", "m1", "7")], "n string, m string, k string")
    assert [joins.same_fund(funds, "n", c, keys).first().status for c, keys in ((["A", "C"], ["m"]), (["A", "C"], ["m", "k"]), (["A", "Z"], ["m"]))] == ["same", "key_missing", "not_unique"]
    assert joins.cross_market(spark.createDataFrame([("KR000",), (" ",), (None,)], "a string"), "a", spark.createDataFrame([("KR000",), ("",)], "b string"), "b").count() == 0


# --- search, views, evidence


def test_search_statuses():
    s = vector.search_status
    assert [s(0, {}, 0, 0, True), s(2, {"unavailable": 2}, 0, 0, True), s(2, {"unknown": 2}, 0, 0, True), s(None, {}, 3, 3, True), s(None, {}, 0, 2, True), s(1, {"matched": 1}, 0, 0, True), s(None, {}, 0, 0, False)] == ["no_product_match", "no_official_document", "no_document", "ok", "low_confidence", "topic_not_covered", "no_hit"]
    assert vector.sections_for(["투자 전략", "위험 요인"], {"전략": "strategy", "위험": "risk", "보수": "fee"}) == ["strategy", "risk"]


def test_cosine_guards(spark):
    from lattica.functions.values import cosine

    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,)], "v array<float>")
    assert [r.c for r in df.select(cosine(F.col("v"), [2.0, 0.0]).alias("c")).collect()] == [1.0, None, None, None]
    with pytest.raises(RequestError):
        vector.top_k(df, [], 5)


def test_embedding_join_needs_model_and_dimension(spark):
    chunks = spark.createDataFrame([("c1", "h", "m", None), ("c2", "h", "other", None)], "chunk_id string, content_hash string, embedding_model string, model_revision string")
    vectors = spark.createDataFrame([("h", "m", None, 2, [1.0, 2.0]), ("h", "m", "r", 2, [3.0, 4.0])], "content_hash string, embedding_model string, model_revision string, embedding_dim int, embedding array<float>")
    assert [(r.chunk_id, r.embedding) for r in vector.embedded(chunks, vectors, "m", 2).collect()] == [("c1", [1.0, 2.0])]


def test_views(spark):
    df = spark.createDataFrame([("20240101", "99991231", "20240601", "AA0", "펀드 Class A"), ("20240101", "20240601", "20240601", "BBB-", "펀드"), ("0", "20240601.0", "20240601", None, "")], "s string, e string, d string, r string, n string")
    got = df.select(views.listing(F.col("s"), F.col("e"), F.col("d")).alias("l"), views.rating(df, "r").alias("r"), views.maturity(F.col("e"), F.col("d")).alias("m"), views.share_class_view(df, "n").alias("c"), views.identity_keys(df, ("r", "n", "zz")).alias("k")).collect()
    assert [r.l.value for r in got] == ["true", "false", None] and [r.l.status for r in got] == ["available", "available", "null"]
    assert [r.r.value for r in got] == ["AA", "BBB-", None] and [r.c.value for r in got] == ["A", None, None]
    assert [r.m.value for r in got] == [None, "1년미만", "1년미만"] and got[2].k.value == f"r={views.NO_VALUE}, n="
    assert df.select(views.unsupported("why").alias("u"), views.rating_order(["C", "A"]).alias("o")).first().asDict(True) == {"u": {"value": None, "status": "derivation_unavailable", "detail": "why"}, "o": {"value": "C < A", "status": "available", "detail": None}}
    assert views.raw_rating(df, "gone") is not None
    with pytest.raises(RequestError):
        views.derive(df, "x", type("V", (), {"kind": "ambiguous", "inputs": ()})())


def test_contract_and_rendering(spark):
    df = spark.createDataFrame([(1, float("nan"), True), (2, 0.0, False)], "k int, v double, b boolean")
    long = evidence.contract(df, "k", [{"field": "v (x)", "column": "v", "rule": "0 = 값 없음", "unit": "%"}, {"field": "b", "column": "b", "rule": "0 = 값 없음"}])
    assert {(r.k, r.field): r.status for r in long.collect()} == {(1, "v (x)"): "invalid", (1, "b"): "available", (2, "v (x)"): "zero_unavailable", (2, "b"): "available"}
    assert evidence.rendered(long, "k").filter("k = 2").first().text == "b: false\nv: (zero_unavailable)"
    assert {r.status: r.n for r in evidence.status_histogram(long).collect()}["available"] == 2
    assert evidence.evidence_gate(df.limit(0), ["v"]).first().status == "empty" and evidence.evidence_gate(df, []).first().status == "abstain_evidence_missing"
    assert '"answer": "x"' in evidence.answer("1", "q", evidence.context([{"dataset": "d", "rows": 3}, {"dataset": "e", "rows": 0, "status": "blocked"}]), ["t"], "x")
    assert df.select(evidence.shown_value(F.col("b"), "boolean"), evidence.shown_value(F.lit("a\nb"), "string")).first()[1] == "a\\nb"


# --- sources


def test_reading_statements_only():
    for good in ("select 1", "WITH a AS (SELECT 1) SELECT * FROM a;", "select 'drop table x'", "select 1 -- delete\n", "select replace(a, 'b', 'c') from t", "(select 1)"):
        assert io.assert_reading(good)
    for bad in ("drop table x", "select 1; select 2", "with a as (select 1) insert into t select * from a", "", "update t set a = 1", "explain drop table x"):
        with pytest.raises(RequestError):
            io.assert_reading(bad)
    assert io.assert_reading_graph("PREFIX fp: <http://x#>\nSELECT ?a WHERE { ?a fp:drop ?b }".replace("fp:drop", "fp:x"))
    for bad in ("INSERT DATA { <a> <b> <c> }", "SELECT * { SERVICE <http://x> { ?a ?b ?c } }", "CONSTRUCT { ?a ?b ?c } WHERE { ?a ?b ?c }"):
        with pytest.raises(RequestError):
            io.assert_reading_graph(bad)


def test_sql_with_parameters_and_caps(spark):
    io.register({"raw.t": spark.range(5).toDF("a")})
    assert [r.a for r in io.run_sql(spark, "select a from raw_t where a >= :low order by a", {"low": 3}).collect()] == [3, 4]
    with pytest.raises(Truncated):
        io.run_sql(spark, "select * from raw_t", most=4)


def test_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿corp_code,corp_name\n001,A\n", encoding="utf-8")
    assert io.read_companies(spark, str(tmp_path / "c.csv")).first().asDict() == {"corp_code": "001", "corp_name": "A"}
    assert io.read_sidecar(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('[{"ticker": "T", "name": "N", "document": "d"}]')
    assert io.read_sidecar(spark, str(tmp_path / "s.json")).first().document == "d"
    io.write_triples(io.triples_table(spark, [("a", "p", "b", "uri", "")]), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("p = 'p'").count() == 1


def test_snapshots(spark, tmp_path):
    tables = {"t": spark.range(1).toDF("a")}
    found = io.snapshot(tables)
    io.save_snapshot(spark, found, str(tmp_path / "s"))
    assert io.load_snapshot(spark, str(tmp_path / "s")) == found and io.load_snapshot(spark, str(tmp_path / "none")) is None
    assert io.contract_gaps(found, {"t": {"a", "b"}, "u": {"x"}}) == ["t.b", "u"]
    releases = iter("aab")
    assert io.stable_snapshot(lambda: tables, lambda: next(releases))["release_id"] == "a"
    releases = iter("ab")
    with pytest.raises(ContractError):
        io.stable_snapshot(lambda: tables, lambda: next(releases))
    clock, release, taken = [0.0], ["r"], []
    cache = io.SnapshotCache(lambda: taken.append(1) or {"n": len(taken)}, lambda: release[0], 10, lambda: clock[0])
    cache.get(), cache.get()
    clock[0] = 11
    cache.get()
    release[0] = "s"
    assert cache.get() == {"n": 3}


def test_a_graph_behind_an_endpoint(spark):
    import json
    import re
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    triples = [(f"http://x/{i}", f"http://p/{i % 2}", f"v{i}") for i in range(25)]
    asked, failed = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            query = self.rfile.read(int(self.headers["Content-Length"])).decode()
            asked.append(query)
            if len(asked) == 2 and not failed:
                failed.append(1)
                self.send_response(503)
                self.end_headers()
                return
            if query.startswith("ASK"):
                out = {"boolean": True}
            elif "DISTINCT" in query:
                out = {"results": {"bindings": [{"p": {"value": p}} for p in sorted({p for _, p, _ in triples})]}}
            else:
                p, limit, offset = re.search(r"<(.*?)>.*LIMIT (\d+) OFFSET (\d+)", query).groups()
                rows = sorted((s, o) for s, q, o in triples if q == p)[int(offset) : int(offset) + int(limit)]
                out = {"results": {"bindings": [{"s": {"value": s}, "o": {"value": o}} for s, o in rows]}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        assert stores.remote_alive(url)
        found = stores.read_sparql(spark, url, page="5")
        assert {tuple(r) for r in found.collect()} == set(triples) and failed
        asked.clear()
        assert found.filter("p = 'http://p/1'").count() == 12 and not any("http://p/0" in q for q in asked)
        store = stores.first_available({"none": lambda: spark.read.parquet("/nowhere"), "remote": lambda: stores.remote_alive(url) and Graph(found, None)})
        assert store().count() == 25
    finally:
        server.shutdown()


def test_provenance_against_a_plain_reading(spark):
    import random

    rng = random.Random(5)
    word = lambda low, high: "".join(rng.choice("ABC") for _ in range(rng.randint(low, high)))
    rows = [(i, word(1, 9), rng.choice([None, "", word(3, 6)])) for i in range(120)] + [(500, None, " "), (501, "abca", "X (b)")]
    docs = [(f"d{i:02}", rng.choice([None, word(2, 4)]), rng.choice([None, word(5, 6)]), rng.choice([None, "", word(1, 7)])) for i in range(40)]

    def plain(values):
        best = []
        for v in filter(None, (x and x.strip() for x in values)):
            k = "".join(c for c in v.upper() if c not in " []()-·")
            for doc, ticker, isin, name in docs:
                n = (name or "").upper()
                if len(v) >= 3 and ticker and v.upper() == ticker:
                    best.append((1, 0, doc))
                if isin and v.upper() == isin:
                    best.append((2, 0, doc))
                if len(v) >= 4 and n and k and (n in k or k in n):
                    best.append((3, -len(n), doc))
        return min(best, default=(None, None, None))

    df, known = spark.createDataFrame(rows, "k int, a string, b string"), spark.createDataFrame(docs, "document string, ticker string, isin string, name string")
    want = {i: plain(v) for i, *v in rows}
    found = joins.provenance(df, "k", ["a", "b"], known)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.document for r in found.collect()} == {i: d for i, (_, _, d) in want.items()}


def test_an_answer_holds_quotes_and_statuses(spark, engine):
    chunks = engine.chunks.withColumn("chunk_text", F.concat(F.lit("text of "), "chunk_id"))
    own = Engine(CATALOG, engine.compiler.tables, chunks=chunks, bridge=engine.bridge, embed=lambda t: [0.1] * 64, floor=-1.0)
    out = own.answer({"product_domain": [{"domain": "orders"}], "conditions": [{"attribute": "priority", "operator": "eq", "value": "1-URGENT"}, {"attribute": "total", "operator": "gt", "value": "1"}], "output_requirements": {"narrative_topics": ["a"]}}, "why?", TODAY, "7")
    assert out.outcomes["vectors"].status == "ok" and "] text of " in out.record and not out.abstained
    assert "orders · 2026-08-24 · " in out.context and out.contracts["tables_orders"].filter("field = 'name' and status = 'available'").count() > 0
    assert own.answer({"product_domain": [{"domain": "orders"}], "full_years": [2026]}, today=TODAY).abstained == ["the year 2026 isn't over"]
