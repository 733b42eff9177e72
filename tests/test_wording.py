"""What words settle, lookups before graph steps, constraints on relations, spellings, quotes, retries."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lattica.catalogue_queries import CATALOG, NAMESPACE, fixture_graph
from lattica.errors import RequestError
from lattica.operators import graph, vector
from lattica.operators.ontology import Ontology
from lattica.plans import wording
from lattica.plans.catalog import Attribute, Catalog, Domain, OutputView
from lattica.plans.compile import Compiler
from lattica.plans.engine import Engine, abstentions, rows_shown
from lattica.session import table
from lattica.sources import io
from lattica.sources.turtle import parse

TODAY = date(2026, 8, 24)


def test_words():
    assert wording.comparators("AA- 이상 회사채, 잔존기간 3년 이하, 순자산 1,000억원 초과") == [("AA-", "gte"), ("3년", "lte"), ("1,000억원", "gt")]
    assert wording.window("최근 3개월 수익률", TODAY) == (date(2026, 5, 24), TODAY) and wording.window("최근", TODAY) is None
    assert wording.classes("Class A와 종류 C-e, S클래스") == ["A", "C-e", "S"] and wording.full_years("2026년 연간") == [2026]
    out = wording.restored({"conditions": [{"attribute": "신용등급", "operator": "eq", "value": "AA-"}]}, "SK 및 자회사, AA- 이상, 같은 펀드와 ETF", TODAY)
    assert out["conditions"][0]["operator"] == "gte" and out["any_relation"] and out["cross_market"]


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(CATALOG, {n: table(spark, sf_dir, n) for n in ("orders", "part", "lineitem", "customer", "supplier")}, fixture_graph(spark, sf_dir))


def test_constraints_hold_on_the_relation(engine):
    relation = {"id": "r", "relation": "holds", "object_entity": "NATION_3", "entity_role": "company"}
    weight = {"attribute": "weight", "operator": "gte", "value": "50000", "applies_to": "r"}
    _, done, _ = engine.run({"product_domain": [{"domain": "orders"}], "relations": [relation], "conditions": [weight]}, TODAY)
    rows = done["graph_r"].rows.collect()
    assert rows and all(float(r.weight) >= 50000 for r in rows)
    route, done, _ = engine.run({"product_domain": [{"domain": "orders"}], "relations": [relation], "conditions": [weight | {"attribute": "color"}]}, TODAY)
    assert done["graph_r"].status == "invalid" and any("color" in x for x in abstentions(route, done))
    assert rows_shown(3) == 6 and rows_shown(0) == 20


def test_lookups_hand_a_code_on(engine):
    relation = {"id": "r", "relation": "holds", "object_entity": "Supplier#000000001", "entity_role": "product", "subject_domain": "parts"}
    _, done, _ = engine.run({"product_domain": [{"domain": "parts"}], "relations": [relation]}, TODAY)
    assert [r.code for r in done["lookup_r"].codes.collect()] == ["1"] and done["graph_r"].status.startswith(("ok", "abstain"))


def test_spellings_of_a_category(spark):
    ttl = """@prefix fp: <http://example.org/fx#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .
    fp:AssetType a owl:Class . fp:eq a fp:AssetType ; rdfs:label "주식"@ko ; skos:altLabel "Equity" . fp:bd a fp:AssetType ; rdfs:label "채권"@ko ."""
    domain = Domain("d", "t", "k", "k", ("k",), {"type": Attribute("type", "a", "categorical", ("주식", "채권"))}, views={"v": OutputView("classification", ("a",), axes=(("a", "AssetType"),))})
    df = spark.createDataFrame([("1", "주식"), ("2", "Equity"), ("3", "채권"), ("4", None)], "k string, a string")
    compiler = Compiler(Catalog([domain]), {"t": df}, ontology=Ontology(parse(ttl), NAMESPACE))
    ask = lambda op: [r.code for r in compiler.compile({"domain": "d", "conditions": [{"attribute": "type", "operator": op, "value": "Equity"}]}).rows.collect()]
    assert ask("eq") == ["1", "2"] and ask("ne") == ["3"]
    with pytest.raises(RequestError):
        Compiler(Catalog([domain]), {"t": df}).compile({"domain": "d", "conditions": [{"attribute": "type", "operator": "eq", "value": "Equity"}]})


def test_quotes_share_a_documents_budget(spark):
    hits = spark.createDataFrame([("d", "a", 0.9, "x" * 200), ("d", "b", 0.8, "y" * 100), ("d", "c", 0.7, "z"), ("e", "f", 0.6, None)], "document_id string, chunk_id string, score double, t string")
    assert {r.chunk_id: len(r.quote or "") for r in vector.quotes(hits, "t").select("chunk_id", "quote").collect()} == {"a": 200, "b": 40, "c": 0, "f": 0}
    assert vector.quotes(hits.withColumn("t", F.lit("w " * 50)), "t", 1000).first().quote.count("w") == 25


def test_reviewed_securities():
    assert graph.reviewed_security("Cambricon")[0] == "cambricon" and graph.reviewed_security("other") is None


def test_retries_and_addresses():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert io.with_retries(call, sleep=waits.append) == "done" and waits == [0.5, 1.0]
    with pytest.raises(TimeoutError):
        io.with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), attempts=2, sleep=waits.append)
    with pytest.raises(ValueError):
        io.with_retries(lambda: int("x"), sleep=waits.append)
    assert io.dsn_from_env({}) is None and io.dsn_from_env({"PGDATABASE": "d"}) == "jdbc:postgresql://localhost:5432/d"
    assert io.dsn_from_env({"DATABASE_URL": "postgres://u:p@h:1/d"}) == "jdbc:postgresql://h:1/d"
